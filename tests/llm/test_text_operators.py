"""BPE, licences, media and line dedup against plain versions."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from stormgrid.llm import bpe, licenses, line_dedup, media, quality

LONG = "palabra der straße " * 4000
HARD = [None, "", " ", "a", "aaaa" * 50, "it's  we'll\r\n\t x", "<|endoftext|> a<|endoftext|>", "\u3000日本 ñ é\u0301 🙂", LONG]


def test_bpe_equals_the_tokenizers_library(spark, documents):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    rnd = random.Random(3)
    signs = [chr(c) for c in [*range(0x300), 0x4E2D, 0x661, 0x2028, 0x1F600]] + ["<|endoftext|>", " the", "  "]
    texts = HARD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    docs = documents(list(enumerate(texts)) + [(3, "a")])
    rows = bpe.digests(bpe.decode(bpe.encode(docs, path), path)).collect()
    assert len(rows) == len(texts) + 1
    library = Tokenizer.from_file(path)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_decodes_odd_ids(spark):
    df = spark.createDataFrame([(1, [50256, -5, 99999, None]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, bpe.tokenizer_path()).collect()}
    assert got == {1: "<|endoftext|>", 2: None, 3: ""}


def test_bpe_forgets_words(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    words = bpe.Vocabulary(bpe.tokenizer_path())
    first = words.encode(["one two three four five"]).to_pylist()
    assert words.encode(["six seven"]).to_pylist() and words.encode(["one two three four five"]).to_pylist() == first


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def test_licenses_find_base_places_and_edited_notices(spark, documents):
    texts = [
        *HARD,
        "GNU General Public License, gnu general public license; CC-BY cc by cc by",
        "MIT License\x00MIT  license Apache_License",
        "x gnu genral publc license y",
        "Permision is hereby granted, free of charge, to any persn obtaning a copy of it",
        "an apache licence and a mit licenses",
        "submit license",
        LONG + " the mit license " + LONG,
    ]
    docs = documents([*enumerate(texts), (0, "mit license")])
    rows = licenses.summary(licenses.scan(docs)).where("not (doc_id = 0 and n_base > 0)").collect()
    assert len(rows) == len(texts)
    labels = {r.doc_id: r.labels for r in rows}
    for r in rows:
        n, places = plain_base(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert r.first_word == (places[0][0] if places else None)
        assert r.last_word == (places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    k = len(HARD)
    assert labels[k + 2] == "gpl" and labels[k + 3] == "mit" and labels[k + 4] == "apache,mit"
    assert labels[0] == "" and "mit" in labels[k + 6]


def test_license_spans(spark):
    finder = licenses.Finder(licenses.NOTICES)
    n, hits = finder.search("one two gnu genral public license")
    assert n == 6 and [(h[1], h[2], h[3], h[4], h[5]) for h in hits] == [("gpl", 2, 4, 1, "gnu genral public license")]


def test_license_finds_fuzzy_places_before_the_best_one():
    finder = licenses.Finder([("mit license", "mit", 1)])
    for text, want in (
        ("mit licence mit license", [(0, 1), (2, 0)]),
        ("mit licence mit license mit licens", [(0, 1), (2, 0), (4, 1)]),
        ("mit licence mit licens mit license mit license", [(0, 1), (2, 1), (4, 0), (6, 0)]),
    ):
        assert [(h[2], h[4]) for h in finder.search(text)[1]] == want


def test_media_round_trip(spark, documents):
    texts = [*HARD, "x" * 575, "x" * 576, "x" * 577, "y" * (576 * 64), "y" * (576 * 64 + 1), LONG]
    docs = documents([*enumerate(texts), (1, "")])
    loaded = media.load(media.store(docs.selectExpr("*", "cast(octet_length(coalesce(text, '')) as bigint) as n_bytes")))
    rows = media.digests(loaded).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = media.pad(data)
        assert r.n_bytes == len(data) and r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_bytes % 188 == 0 and r.feature.endswith("errors=0")
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id] or "", r.media_sha256) == r.media_sha256


def test_media_sees_losses():
    stream = media.pack(media.pad(b"abc" * 40000))
    payload, stamps, access, kind, packets, errors = media.unpack(stream)
    assert payload == media.pad(b"abc" * 40000) and errors == 0 and kind == media.STREAM_TYPE
    assert [s for s, _ in stamps] == [64 * media.TICKS * k for k in range(len(stamps))]
    assert len(access) == len(stamps) and all(stream[a] == 0x47 and stream[a + 5] & 0x40 for a in access)
    with pytest.raises(media.StreamError):
        media.unpack(stream[: 188 * 10] + stream[188 * 11 :])
    with pytest.raises(media.StreamError):
        media.unpack(b"\x46" + stream[1:])
    broken = bytearray(stream)
    broken[188 * 9 + 3] ^= 3
    assert media.unpack(bytes(broken))[5] == 2


def plain_read(stream):
    """An independent reader of one program: byte by byte, without the module's functions."""
    out, size, table = {}, 188, {}
    for at in range(0, len(stream), size):
        p = stream[at : at + size]
        assert p[0] == 0x47
        pid, start, control = (p[1] & 31) << 8 | p[2], p[1] & 64, p[3] >> 4 & 3
        body = p[4 + (1 + p[4]) * (control >> 1) :] if control & 1 else b""
        if start:
            out.setdefault(pid, []).append(b"")
        if pid in out:
            out[pid][-1] += body
    section = out[0][0][1:]
    table["pmt"] = (section[10] & 31) << 8 | section[11]
    section = out[table["pmt"]][0][1:]
    table["es"] = (section[13] & 31) << 8 | section[14]
    parts, stamps = [], []
    for pes in out[table["es"]]:
        assert pes[:3] == b"\0\0\1"
        head = 9 + pes[8]
        t = pes[9:14]
        bits = "".join(f"{b:08b}" for b in t)
        stamps.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
        parts.append(pes[head:])
    return b"".join(parts), stamps


def test_an_independent_reader_reads_the_streams():
    for n in (0, 1, 575, 576, 576 * 64, 576 * 64 + 1, 300_000):
        payload = media.pad(bytes(k * 7 % 251 for k in range(n)))
        got, stamps = plain_read(media.pack(payload))
        assert got == payload and stamps == [64 * media.TICKS * k for k in range(len(stamps))]


def test_media_reads_duplicates_jumps_and_long_tables():
    stream = media.pack(media.pad(b"abc" * 40000))
    twice = stream[: 188 * 11] + stream[188 * 10 :]
    assert media.unpack(twice)[0] == media.unpack(stream)[0] and media.unpack(twice)[5] == 0
    jump = bytearray(stream)
    first = next(k for k in range(3 * 188, len(stream), 188) if jump[k + 1] & 0x40)
    jump[first + 5] |= 0x80
    for k in range(first, len(jump), 188):
        jump[k + 3] = jump[k + 3] & 0xF0 | jump[k + 3] + 5 & 15
    assert media.unpack(bytes(jump))[5] == 0
    # A program table with 250 bytes of descriptors takes two packets.
    body = bytes([0xE1, 0, 0xF0, 250]) + b"\x80" + bytes([248]) + b"z" * 248 + bytes([media.STREAM_TYPE, 0xE1, 0, 0xF0, 0])
    section = b"\0" + media._section(2, 1, body)
    head = bytes([0x47, 0x40 | media.PMT_PID >> 8, 0, 0x10]), bytes([0x47, media.PMT_PID >> 8, 0, 0x11])
    long_table = head[0] + section[:184] + (head[1] + section[184:]).ljust(188, b"\xff")
    assert media.unpack(stream[:188] + long_table + stream[376:])[0] == media.unpack(stream)[0]


def test_bad_media_give_an_error_not_an_end(spark):
    good = media.pack(media.pad(b"abc"))
    rows = [(1, good), (2, b"abc"), (3, None), (4, good[:188] * 2), (5, b""), (None, good[:200])]
    df = spark.createDataFrame(rows, "doc_id bigint, Media binary").withColumn("ERROR", F.lit(1))
    got = {r["doc_id"]: r for r in media.load(df, "Media").collect()}
    assert got[1]["error"] is None and got[1]["payload"][:3] == b"abc" and got[3]["error"] is None
    assert all(got[k]["error"] and got[k]["payload"] is None for k in (2, 4, 5, None))


def test_names_in_another_case_are_replaced(spark):
    df = spark.createDataFrame([(None, "mit license", 1, 2, 3, 4)], "doc_id bigint, text string, IDS int, HITS int, Media int, STATS int")
    for out in (bpe.encode(df, bpe.tokenizer_path()), licenses.scan(df), media.store(df), quality.featurize(df)):
        (row,) = out.select(*out.columns).collect()
        assert len({c.lower() for c in out.columns}) == len(out.columns) and row is not None


def edit_distance_places(words, notice, most):
    """(first word, last word) of every run of words within ``most`` edits of the notice."""
    found = {}
    for a in range(len(words)):
        row = list(range(len(notice) + 1))
        text = ""
        for b in range(a, len(words)):
            for c in (" " if text else "") + words[b]:
                new = [row[0] + 1]
                for j, d in enumerate(notice):
                    new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
                row = new
            text += (" " if text else "") + words[b]
            if len(text) > len(notice) + most:
                break
            if row[-1] <= most:
                found[a, b] = row[-1]
    return found


def test_fuzzy_licenses_against_plain_edit_distance():
    rng = random.Random(3)
    finder = licenses.Finder(licenses.NOTICES)
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 4)):
            notice, _, most = rng.choice(licenses.NOTICES)
            text = list(notice)
            for _ in range(rng.randrange(most + 2)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = rng.choice(["", "x", "q"])
            words += [*rng.choices(["lorem", "the", "ab"], k=rng.randrange(4)), *"".join(text).split()]
        _, hits = finder.search(" ".join(words))
        for notice, _, most in licenses.NOTICES:
            own = [(w, w + n - 1, e) for x, _, w, n, e, _ in hits if x == notice]
            near = edit_distance_places(words, notice, most)
            assert all(near.get((a, b)) is not None and near[a, b] <= e for a, b, e in own)
            # Every place overlaps a reported one.
            assert all(any(a <= d and c <= b for c, d, _ in own) for a, b in near)


def test_licenses_take_time_in_proportion():
    finder = licenses.Finder(licenses.NOTICES)
    times = []
    for n in (2000, 8000):
        start = time.perf_counter()
        assert len(finder.search("mit license " * n)[1]) >= n
        times.append(time.perf_counter() - start)
    assert times[1] < 12 * times[0] + 0.5


def test_bpe_bounds_bytes_and_reads_long_runs(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LOT_BYTES", 100)
    monkeypatch.setattr(bpe, "MOST_BYTES", 5000)
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    vocab, library = bpe.Vocabulary(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    texts = ["ab" * 3000, "x y z " * 900 + "<|endoftext|>" + "é" * 2000, " ".join(f"w{k}" for k in range(900)), "", None, "ab" * 3000]
    for _ in range(3):
        got = vocab.encode(texts).to_pylist()
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert vocab.held < 20_000


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Vocabulary(bpe.tokenizer_path().replace("byte_bpe_50k", "word_bpe_49k"))


def plain_dedup(rows, least=line_dedup.LEAST_DOCUMENTS):
    """rows: (doc_id, text), ids and texts unique together."""
    lines = []
    for doc, text in rows:
        for at, raw in enumerate([] if text is None else text.split("\n")):
            tokens = re.sub(r"[^ \t\x0B\f\r0-9]*[0-9][^ \t\x0B\f\r]*", "<*>", raw)
            lines.append((doc, at, raw, tuple(t for t in re.split(r"[ \t\x0B\f\r]+", tokens) if t)))
    long = [x for x in lines if len(" ".join(x[3]).encode()) >= line_dedup.LEAST_BYTES]
    leaves, named = {}, {}
    for x in long:
        leaves.setdefault((len(x[3]), x[3][: line_dedup.DEPTH]), set()).add(x[3])
    for (n, leaf), kinds in leaves.items():
        fields = range(line_dedup.DEPTH, n)
        shared = {}
        for k in kinds:
            by_count = sorted(fields, key=lambda p: (-sum(o[p] == k[p] for o in kinds), p))
            fixed = sorted(by_count[: line_dedup.fixed_size(n)])
            shared.setdefault((n, leaf, *((p, k[p]) for p in fixed)), []).append(k)
        for template, own in shared.items():
            for k in own:
                named[k] = template if len(own) > 1 and n > line_dedup.DEPTH + 1 else k
    places = {}
    for doc, at, _, tokens in long:
        places.setdefault(named[tokens], []).append((doc, at))
    gone = set()
    for found in places.values():
        if len({d for d, _ in found}) >= least:
            gone |= set(sorted(found)[1:])
    out = {}
    for doc, text in rows:
        own = [x for x in lines if x[0] == doc]
        kept = [x[2] for x in own if (doc, x[1]) not in gone]
        out[doc] = (len(own), len(own) - len(kept), None if text is None else "\n".join(kept))
    return out


def test_line_dedup_equals_plain(spark, documents):
    rnd = random.Random(5)
    bases = [[rnd.choice("abcdefgh") * 3 for _ in range(rnd.randint(2, 12))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a b c d\r\na b c d"), (4, "a b c d " * 500)]
    for doc in range(5, 60):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            words = list(rnd.choice(bases))
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(["x", "y1", "77", "zz"])
            lines.append(" ".join(words))
        rows.append((doc, "\n".join(lines)))
    got = line_dedup.dedup(documents(rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == plain_dedup(rows)
    assert sum(r.n_dropped for r in got) > 20
    assert got[0].size == 1 and got[0].label == 4


def test_line_dedup_drops_repeated_passages_and_leaves_others(spark, documents):
    passage = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(k, f"own text number {chr(97 + k) * 4} here\n{passage}") for k in range(10)]
    rows += [(100, "quite another document that shares nothing"), (100, "quite another document that shares nothing")]
    got = line_dedup.dedup(documents(rows)).collect()
    assert sum(passage in r.text for r in got) == 1
    assert sum(r.text == rows[-1][1] for r in got) == 2


def test_line_dedup_leaf_holds_several_templates(spark, documents):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    one = [(k, f"the following user {word()} has left the chat room today") for k in range(200)]
    two = [(1000 + k, f"the following user found {word()} in the file store below") for k in range(200)]
    prose = [(2000 + k, "the following user " + " ".join(word() for _ in range(7))) for k in range(201)]
    short = [(3000 + k, "All rights reserved, ok.") for k in range(2)] + [(3010 + k, "ok") for k in range(9)]
    unbroken = [(4000 + k, "无空格的行也会重复出现在文档中") for k in range(2)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup(documents(one + two + prose + short + unbroken)).collect()}
    dropped = lambda rows: sum(got[i] for i, _ in rows)
    assert (dropped(one), dropped(two), dropped(prose), dropped(short), dropped(unbroken)) == (199, 199, 0, 1, 1)


def test_line_dedup_with_clashing_names_and_null_ids(spark):
    line = "a line that stands in more than one document"
    data = [(None, line), (None, f"{line}\nown words of this one document"), (1, line), (1, line), (2, None)]
    names = "gone gone_hash gone_row gone_id gone_at row at leaf line n_lines".split()
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in data], schema)
    got = line_dedup.dedup(docs).collect()
    assert set(got[0].asDict()) == {*docs.columns, "n_dropped"} and all(r.line == 8 and r.gone == 0 for r in got)
    left = sorted((r.doc_id or 0, r.text or "", r.n_lines, r.n_dropped) for r in got)
    none = [x for x in left if x[0] == 0]
    assert [x for x in left if x[0] > 0] == [(1, "", 1, 1), (1, "", 1, 1), (2, "", 0, 0)]
    assert sum(x[3] for x in none) == 1 and sum(line in x[1] for x in none) == 1


@pytest.mark.parametrize("run", [lambda d: bpe.encode(d, bpe.tokenizer_path()), licenses.scan, lambda d: media.load(media.store(d)), line_dedup.dedup])
def test_empty_tables(documents, run):
    assert run(documents([])).count() == 0
