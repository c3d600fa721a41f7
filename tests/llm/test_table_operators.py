"""Quality, neighbours, sharding, Jaccard, URL filters and mixing against plain versions."""

import random
import zlib

import numpy as np
import pytest

from stormgrid.llm import jaccard, mixing, neighbours, quality, sharding, url_filters
from stormgrid.llm.graph import components


def prose(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 7))) for _ in range(n))


# --- quality


def quality_rows(n=1500):
    rnd = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        bad = rnd.random() < 0.3
        text = rnd.choice(["BUY!! NOW!! ", "spam spam spam ", "### $$$ %% "]) * rnd.randint(5, 60) if bad else prose(rnd, rnd.randint(20, 200)) + "."
        rows.append((k, text))
        labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_quality_learns_without_the_held_out_fold(spark, documents):
    rows, labels = quality_rows()
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = documents([*rows, (9000, None), (9001, ""), (None, "a null id"), (9002, "long " * 30000)])
    got = {r.doc_id: r for r in quality.score(docs, marks).collect()}
    assert len(got) == len(rows) + 4
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = {k: q for k, q, _ in labels}
    out = [k for k in truth if got[k].held_out]
    assert np.mean([got[k].predicted == truth[k] for k in out]) > 0.97
    # Labels of the held-out fold change nothing.
    turned = [(k, 1 - q if got[k].held_out else q, t) for k, q, t in labels]
    again = quality.score(docs, spark.createDataFrame(turned, "doc_id bigint, quality int, toxic int")).collect()
    assert all(abs(r.score - got[r.doc_id].score) < 1e-9 for r in again)


def test_quality_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in quality.score(documents([(1, "a b")]), none).collect()] == [0.5]
    assert quality.score(documents([]), none).count() == 0


def test_isotonic_is_the_best_monotone_fit():
    rnd = np.random.default_rng(0)
    n, k = rnd.integers(1, 9, 40).astype(float), np.zeros(40)
    k = np.floor(n * rnd.random(40))
    got = quality.isotonic(n, k)
    assert (np.diff(got) >= 0).all()
    # min-max formula
    best = [max(min(k[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(got, best)


# --- neighbours


def plain_nearest(x, ids, step, nearest):
    out = {}
    for q in sorted({i for i in ids if i % step == 0}):
        a = x[min((k for k, i in enumerate(ids) if i == q), key=lambda k: x[k].tolist())]
        found = sorted((-float((x[k] * a).sum()), ids[k]) for k in range(len(ids)) if ids[k] != q)
        out[q] = found[:nearest]
    return out


def test_neighbours_recall_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((1200, 16)).astype(np.float32)
    x[100:500] = x[100]  # a crowd of equal vectors
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [1.0, None] + [1.0] * 14, 1), (5080, [float("inf")] * 16, 1), (5100, [1.0] * 3, 1), (5120, [], 1)]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int")
    got = {}
    for r in neighbours.search(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = plain_nearest(x.astype(float), list(range(1200)), 20, 20)
    assert got.keys() == want.keys()
    assert all(sorted(v) == list(range(1, 21)) for v in got.values())
    recall = np.mean([len({i for i, _ in got[q].values()} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q in want:  # exact scores, best first, ties by id
        found = [(-s, i) for i, s in (got[q][k] for k in range(1, 21))]
        assert found == sorted(found)
        assert all(abs(s - float(x[i].astype(float) @ x[q].astype(float))) < 1e-9 for i, s in got[q].values())
    copies = [i for i, _ in (got[120][k] for k in range(1, 21)) if 100 <= i < 500]
    assert len(copies) > 10 and copies == [k for k in range(100, 121) if k != 120][: len(copies)]


@pytest.mark.parametrize("kind", ["norms", "rare", "copies"])
def test_neighbours_miss_none_on_any_rows(spark, monkeypatch, kind):
    """Rows that the codes tell apart badly: of very different norms, few far from a crowd, and near copies."""
    monkeypatch.setattr(neighbours, "ROWS", 700)
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((2500, 24))
    if kind == "norms":
        x *= np.exp(1.5 * rnd.standard_normal((2500, 1)))
    elif kind == "rare":
        x[rnd.permutation(2500)[:2300]] *= 1e-3
    else:
        x[:2000] = x[0] + 1e-3 * x[:2000]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    want = plain_nearest(x, list(range(2500)), 20, 20)
    for probes in (neighbours.PROBES, 0.1):
        got = {}
        for r in neighbours.search(df, probes=probes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: [i for _, i in found] for q, found in want.items()}


def test_neighbours_of_products_beyond_a_float(spark):
    x = np.random.default_rng(9).standard_normal((400, 8)) * 1e30
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in neighbours.search(df).collect()}
    assert got == {(q, k): i for q, found in plain_nearest(x, list(range(400)), 20, 20).items() for k, (_, i) in enumerate(found, 1)}


def test_neighbours_of_each_length_and_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, 0.0]), (2, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (3, [0.0, 0.0]), (4, None)]
    got = [tuple(r) for r in neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()]
    assert sorted(got) == [(20, 1, 1, 0.9), (20, 2, 1, 0.5), (40, 1, 2, 6.0)]


def test_neighbours_of_few_or_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [3.0, 1.0])], schema)
    assert [(r.vec_id, r.score) for r in neighbours.search(few).orderBy("rank").collect()] == [(1, 5.0), (2, 5.0)]


@pytest.mark.parametrize("n", [1, 2, 21, 25, 60])
def test_neighbours_are_never_short(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 5))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.search(df).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, n, 20):
        assert len(found.get(q, [])) == min(20, n - 1 + 3 * (q != 0)), q
    exact = [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(df, probes=1.0, shortlist=None).collect()]
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    want = []
    for q in range(0, n, 20):
        score = every @ x[q]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        want += [(q, k + 1, int(ids[i])) for k, i in enumerate(order)]
    assert sorted(exact) == sorted(want)


# --- sharding


def plain_shards(rows, shards):
    sizes = sorted((-1 if i is None else i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, before, out, counts = sum(s for *_, s in sizes), 0, [], {}
    for i, crc, size in sizes:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((None if i < 0 else i, size, crc, shard, counts.get(shard, 0)))
        counts[shard] = counts.get(shard, 0) + 1
        before += size
    return out


def test_shards_equal_plain(spark, documents):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, rnd.randint(0, 60))) for k in range(500)]
    rows += [(7, "x"), (7, "x"), (None, "null id"), (600, None), (601, ""), (602, "é" * 3000)]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_by_bytes(documents(rows)).collect()]
    key = lambda r: (r[3], r[4])
    assert sorted(got, key=key) == sorted(plain_shards(rows, 16), key=key)


def test_shards_of_few_rows(spark, documents):
    assert sharding.shard_by_bytes(documents([])).count() == 0
    assert {r.slot for r in sharding.shard_by_bytes(documents([(1, "a"), (2, "b")])).collect()} == {0}


# --- Jaccard


def plain_components(rows):
    sets = []
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= 75 * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def edited(rnd, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = prose(rnd, 1)
    return " ".join(w)


@pytest.mark.parametrize("all_pairs, block_sets, heavy", [(16, 2048, 1 << 17), (2, 3, 8)])
def test_jaccard_equals_plain(spark, documents, monkeypatch, all_pairs, block_sets, heavy):
    monkeypatch.setattr(jaccard, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    rnd = random.Random(block_sets + heavy)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "word " * 3000)]
    for base in range(6):
        text = prose(rnd, rnd.randint(8, 120))
        rows += [(len(rows) + k, edited(rnd, text, rnd.randint(0, 7))) for k in range(25)]
    passage = prose(rnd, 30)
    rows += [(len(rows) + k, prose(rnd, rnd.randint(2, 40)) + " " + passage) for k in range(40)]
    rows += [rows[30], rows[31]]
    got = sorted(tuple(r) for r in jaccard.join(documents(rows)).collect())
    assert got == plain_components(rows)
    assert len({c for *_, c in got}) < len(rows) - 30


def test_jaccard_links_near_copies_with_null_and_repeated_ids(spark, documents):
    rnd = random.Random(12)
    w = prose(rnd, 200).split()
    x = [prose(rnd, 1) + str(k) for k in range(8)]
    first = " ".join(w)
    middle = " ".join([*x[:4], *w[4:]])
    last = " ".join([*x, *w[8:]])
    far = [" ".join([*w[:-k], *(prose(rnd, 1) for _ in range(k))]) for k in (60, 120)]
    rows = [(1, first), (None, middle), (None, middle), (3, last), (None, far[0]), (7, far[1]), (7, prose(rnd, 30))]
    want = sorted(r for r in plain_components([(1000 if i is None else i, t) for i, t in rows]) if r[0] < 1000)
    got = [tuple(r) for r in jaccard.join(documents(rows)).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert (3, 196, 1) in got and got.count((None, 196, 1)) == 2


def test_jaccard_links_very_long_texts(spark, documents):
    words = [str(k) for k in range(2_500_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(words[:1_000_000]))]
    got = sorted(tuple(r) for r in jaccard.join(documents(rows)).collect())
    assert got == [(1, 2_499_996, 1), (2, 2_499_996, 1), (3, 999_996, 3)]


def templated(rnd, n):
    """Documents of five out of twenty passages: many shared shingles, hardly a link."""
    passages = [prose(rnd, 40) for _ in range(20)]
    return [(k, " ".join(rnd.sample(passages, 5)) + " " + prose(rnd, 5)) for k in range(n)]


def checked_pairs(spark, documents, monkeypatch, rows):
    counts, write = [], jaccard.materialize

    def counted(df, label):
        out = write(df, label)
        counts.append(out.count() if label == "jaccard-pairs" else 0)
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    jaccard.join(documents(rows)).collect()
    monkeypatch.undo()
    return sum(counts)


def test_jaccard_checks_few_pairs_of_templated_documents(spark, documents, monkeypatch):
    assert checked_pairs(spark, documents, monkeypatch, templated(random.Random(4), 600)) < 100


def test_jaccard_checks_few_pairs_of_near_copies(spark, documents, monkeypatch):
    rnd = random.Random(6)
    text = prose(rnd, 150)
    rows = [(k, edited(rnd, text, rnd.randint(1, 6))) for k in range(600)]
    assert checked_pairs(spark, documents, monkeypatch, rows) < 12 * len(rows)


def test_jaccard_links_connect_each_component(spark, documents):
    rnd = random.Random(8)
    rows = [(10 * base + k, edited(rnd, prose(random.Random(base), 60), k % 3)) for base in range(5) for k in range(8)]
    links = [tuple(r) for r in jaccard.links(documents(rows)).collect()]
    want = {i: c for i, _, c in plain_components(rows)}
    assert all(a < b and want[a] == want[b] for a, b in links)
    low = dict.fromkeys(want)
    low = {i: i for i in low}
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    texts = {t: min(i for i, u in rows if u == t) for _, t in rows}
    assert {i: low[texts[t]] for i, t in rows} == want


def test_jaccard_of_nothing(spark, documents):
    assert jaccard.join(documents([])).count() == 0
    assert [tuple(r) for r in jaccard.join(documents([(3, None)])).collect()] == [(3, 0, 3)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300) if k != 150] + [(5, 2)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 if k <= 150 else 151 for k in range(301)}


# --- URL filters


def plain_judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([k for k in (tail.find(c) for c in "?#") if k >= 0], default=len(tail))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filters_equal_plain(spark):
    rnd = random.Random(8)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "com.b", "EXAMPLE.org", "", "net", "org:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/a#b", "/de/", "?q=://x", "#f", "/fr/\n/x"]
    urls = [None, "", "no scheme", "x://"] + [f"http://{h}{p}" for h in hosts for p in paths]
    urls += [f"https://big.com/de/{k}" for k in range(300)] + urls[:20]
    rules = url_filters.RULES + [("b.com", "/", "block"), ("b.com", "/fr/", "allow"), ("a.example.org", "/e", "block")]
    pages = spark.createDataFrame([(k, u, "", 1) for k, u in enumerate(urls)], "page_id bigint, url string, html string, host int")
    for chosen in (url_filters.RULES, rules):
        rnd.shuffle(chosen)
        got = url_filters.judge(pages, spark.createDataFrame(chosen, "host string, path string, verdict string")).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == plain_judge(urls[r.page_id], chosen), urls[r.page_id]


def test_url_filters_keep_odd_labels_apart(spark):
    urls = ["http://com\u0001evil/de/x", "http://a.com/de/x", "http://com\u0002a/de/", "http://x\u0001.com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r.rule for r in url_filters.judge(pages, url_filters.rule_table(spark)).collect()}
    assert got == {0: None, 1: "com/de/", 2: None, 3: "com/de/"}


def test_url_filters_without_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filters.judge(pages, url_filters.rule_table(spark)).count() == 0


# --- mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    return target


def test_mixing_meets_targets(spark, documents):
    rnd = random.Random(6)
    rows = [(k, prose(rnd, rnd.choice([0, 1, 5, 50, 400]))) for k in range(3000)] + [(5000, None), (5001, " "), (None, "a b")]
    sources = [None, "a", "b", "Z", "é", "tiny", "empty"]
    pick = {i: "empty" if not t or not t.strip() else "tiny" if i is not None and i % 100 == 0 else sources[(i or 0) % 5 if (i or 0) % 3 else 1] for i, t in rows}
    docs = documents(rows, lambda i: pick[i])
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, texts = {}, dict(rows)
    for i, t in rows:
        sizes[pick[i]] = sizes.get(pick[i], 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken, largest = {}, {}
    for r in got:
        s, n = pick[r.doc_id], len((texts[r.doc_id] or "").split())
        assert (r.size, r.source_size) == (n, sizes[s])
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * n and r.copies in (0, 1, 2, 3)
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), n)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_keeps_expectations(spark, documents):
    docs = documents([(k, "w " * (1 + k % 7)) for k in range(4200)], lambda i: f"s{i % 3}")
    for seed in (1, 2):
        rows = mixing.mix(docs, seed).groupBy("source_size", "target", "size").avg("copies").collect()
        assert len(rows) == 21
        for r in rows:  # the mean of 200 draws deviates by 0.036 at most
            assert abs(r["avg(copies)"] - r.target / r.source_size) < 0.15


def test_mixing_draws_many_equal_rows(spark, documents):
    rows = spark.range(100_000).selectExpr("cast(7 as bigint) as doc_id", "if(id < 90000, 'a b c', 'd e') as text", "if(id % 10 = 0, 's', 't') as source")
    got = mixing.mix(rows).groupBy("source_size", "target").agg({"taken": "sum", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 100_000
    assert all(abs(r["sum(taken)"] - r.target) <= 3 for r in got)


def test_mixing_of_nothing(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None)])).collect()] == [0]
