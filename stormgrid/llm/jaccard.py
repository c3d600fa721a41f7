"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one check a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import marked, marks, materialize, shared_dir, sliced, small_batches, table
from stormgrid.llm.graph import components

WORDS = 5  # of a shingle
SKETCH_BITS = 22  # log2 of the number of counters that estimate how frequent a shingle is
BLOCK = 1 << 16  # counters of one row of the sketch
SEGMENTS = 256  # hash ranges whose counts bound the overlap of two suffixes
BUCKET = 1 << 18  # prefix entries of one task, about
HELD = 1 << 18  # entries that a map task holds before it hands them on
HEAVY = 1 << 17  # entries of a shingle above which they are dealt over several tasks
ALL_PAIRS = 16  # sets of a shingle up to which all its pairs that pass the filters are kept
BLOCK_SETS = 2048  # sets of one shingle that meet as many others in one step
MEETING = 1 << 13  # entries of the shingles that one task compares, about

_CONSTANTS = np.array([xxhash.xxh3_64_intdigest(b"shingle%d" % k) | 1 for k in range(WORDS + WORDS)], np.uint64)
# A-Z become a-z; every byte of UTF-8 above stays.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, known: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < WORDS:
        mixed = (h * _CONSTANTS[:n]).sum(dtype=np.uint64)[None] + _CONSTANTS[WORDS + n : WORDS + n + 1]
    else:
        mixed = h[: n - WORDS + 1] * _CONSTANTS[0]
        for k in range(1, WORDS):
            mixed = mixed + h[k : n - WORDS + 1 + k] * _CONSTANTS[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _CONSTANTS[WORDS]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_id(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_size(n: int) -> int:
    """n - ceil(3 n / 4) + 1: two sets that link share one of so many first shingles."""
    return n - -(-3 * n // 4) + 1


def segment(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(20)).astype(np.int64) % SEGMENTS


def packed_counts(counts: np.ndarray) -> bytes:
    """How many shingles fall into each segment, in one or four bytes each."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def counts_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == SEGMENTS else np.uint32)


_PROFILE = "doc_id bigint, row bigint, set_id bigint, n int, part int, block int, counts binary, excess binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end the partition's shingle counts in sparse blocks."""
    names = ["doc_id", "row", "set_id", "n", "part", "block", "counts", "excess"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    known, part = Words(), TaskContext.get().partitionId()
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)

    for batch in batches:
        ids, sizes = [], []
        for text in batch.column("text").to_pylist():
            own = shingles(text, known)
            ids.append(set_id(own) if len(own) else None)
            sizes.append(len(own))
            np.add.at(counts, _counter(own), 1)
        none = [None] * len(ids)
        values = [batch.column("doc_id"), batch.column("row"), ids, sizes, none, none, none, none]
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(v, k) if isinstance(v, list) else v for v, k in zip(values, kinds, strict=True)], names))
    for b in range(len(counts) // BLOCK):
        block = counts[b * BLOCK : (b + 1) * BLOCK]
        if not block.any():
            continue
        values = [[None], [None], [None], [None], [part], [b], *([x] for x in _packed(block))]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)


def _packed(block: np.ndarray) -> tuple[bytes, bytes]:
    """Counters as one byte each if most are in use, and (place, count) of what is above that."""
    dense = np.minimum(block, 255).astype(np.uint8) if np.count_nonzero(block) * 4 > len(block) else None
    rest = block if dense is None else block - dense
    at = np.flatnonzero(rest)
    return b"" if dense is None else dense.tobytes(), np.concatenate([at, rest[at]]).astype(np.uint32).tobytes()


def _unpacked(counts: bytes, excess: bytes) -> np.ndarray:
    total = np.frombuffer(counts, np.uint8).astype(np.int64) if counts else np.zeros(BLOCK, np.int64)
    at, n = np.frombuffer(excess, np.uint32).reshape(2, -1)
    total[at] += n
    return total


def _added(frame: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for counts, excess in zip(frame["counts"].to_pylist(), frame["excess"].to_pylist(), strict=True):
        total += _unpacked(counts, excess)
    packed = [pa.array([x], pa.binary()) for x in _packed(np.minimum(total, (1 << 32) - 1))]
    return pa.table([frame["part"][:1], frame["block"][:1], *packed], ["part", "block", "counts", "excess"])


def _sketch(profile: DataFrame) -> np.ndarray:
    """How frequent shingles are, by hash: eight times the log2 of each counter. Always 2**SKETCH_BITS bytes."""
    sums = profile.where("block is not null").select("part", "block", "counts", "excess")
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        sums = sums.withColumn("part", F.expr("cast(part div 64 as int)"))
        sums = sums.groupBy("part", "block").applyInArrow(_added, "part int, block int, counts binary, excess binary")
        if parts <= 64:
            break
        parts = -(-parts // 64)
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in sums.toLocalIterator():
        total = _unpacked(row["counts"], row["excess"])
        levels[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.minimum(255, 8 * np.log2(np.maximum(total, 1)))
    return levels


def rare_first(own: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the common order (the counter's level, then the hash), and its segments."""
    order = level[_counter(own)].astype(np.uint64) << np.uint64(56) | own >> np.uint64(8)
    first = np.argsort(order, kind="stable")[: prefix_size(len(own))]
    return order[first], segment(own[first])


_ENTRIES = "bucket bigint, tokens binary, sets binary, places binary, ids binary, sizes binary"


def _prefixes(docs: DataFrame, levels, buckets: int, usual: float) -> DataFrame:
    """Packed prefix entries (token, set, place) by bucket; copies inside a task are packed once."""
    names = ["bucket", "tokens", "sets", "places", "ids", "sizes"]

    def packed(tokens: list, places: list, ids: list, sizes: list) -> Iterator[pa.RecordBatch]:
        sets = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(t) for t in tokens])
        token, place = np.concatenate(tokens), np.concatenate(places)
        own_id, size = np.array(ids, np.int64), np.array(sizes, np.uint32)
        # A frequent shingle is dealt over several buckets, by its set and by itself.
        deals = np.maximum(np.exp2((token >> np.uint64(56)).astype(float) / 8) - 4 * usual, 0) // HEAVY
        salt = (own_id[sets].view(np.uint64) ^ token * _CONSTANTS[1]) * _CONSTANTS[2] >> np.uint64(33)
        salt = np.where(deals > 0, salt % (deals.astype(np.uint64) + np.uint64(1)), 0).astype(np.uint64)
        bucket = ((token + salt * _CONSTANTS[3]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, cuts):
            local, number = np.unique(sets[at], return_inverse=True)
            values = [token[at], number.astype(np.uint32), place[at], own_id[local], size[local]]
            row = [pa.array([int(bucket[at[0]])], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)]
            yield pa.RecordBatch.from_arrays(row, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level, done = Words(), levels.value, set()
        tokens, places, ids, sizes, held = [], [], [], [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = shingles(text, known)
                if not len(own) or (key := set_id(own)) in done:
                    continue
                done.add(key)
                first, _ = rare_first(own, level)
                tokens.append(first)
                places.append(np.arange(len(first), dtype=np.uint32))
                ids.append(key)
                sizes.append(len(own))
                held += len(first)
                if held > HELD:
                    yield from packed(tokens, places, ids, sizes)
                    tokens, places, ids, sizes, held = [], [], [], [], 0
                    done.clear()
        if held:
            yield from packed(tokens, places, ids, sizes)

    return docs.select("text").mapInArrow(run, _ENTRIES)


def survives(size_a, size_b, place_a, place_b) -> np.ndarray:
    """Length and positional filter of a pair at its first common shingle."""
    small, big = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = 1 + np.minimum(size_a - place_a, size_b - place_b) - 1
    return (4 * small >= 3 * big) & (7 * most >= 3 * (size_a + size_b))


_CANDIDATES = "token bigint, a bigint, b bigint, size int, place int, head boolean"


def _candidates(usual: float):
    """For each bucket: pairs (a, b) that pass the filters, and the entries of crowded shingles (a, with token, size and place).

    Of each shingle there are the pairs of a set and its head; if it is not crowded, all others too.
    """

    def meet(frame: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for t, s, p, i, z in zip(*(frame[c].to_pylist() for c in ("tokens", "sets", "places", "ids", "sizes")), strict=True):
            own = np.frombuffer(s, np.uint32)
            parts[0].append(np.frombuffer(t, np.uint64))
            parts[1].append(np.frombuffer(i, np.int64)[own])
            parts[2].append(np.frombuffer(z, np.uint32)[own])
            parts[3].append(np.frombuffer(p, np.uint32))
        token, who, size, place = (np.concatenate(x) for x in parts)
        del parts
        dealt = (np.exp2((token >> np.uint64(56)).astype(float) / 8) - 4 * usual) // HEAVY > 0
        order = np.argsort(token, kind="stable")
        ordered = token[order]
        twice = np.zeros(len(ordered), bool)
        same = ordered[1:] == ordered[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice | dealt[order]]
        token, who, size, place, dealt = token[order], who[order], size[order].astype(np.int64), place[order].astype(np.int64), dealt[order]
        # Size classes of a ratio of 4/3: sets that link are of one class or of neighbouring ones.
        level = np.floor(np.log(size) / np.log(4 / 3)).astype(np.int64)
        order = np.lexsort((who, level, token))
        token, who, size, place, dealt, level = token[order], who[order], size[order], place[order], dealt[order], level[order]
        if len(token):  # copies from several tasks
            fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (who[1:] != who[:-1])])
            token, who, size, place, dealt, level = token[fresh], who[fresh], size[fresh], place[fresh], dealt[fresh], level[fresh]
        _, run, length = np.unique(token, return_inverse=True, return_counts=True)
        # Each set meets one set of its size class, the same for most shingles of a group; and these
        # heads meet those of the next class.
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (level[1:] != level[:-1])])[: len(token)]
        heads = np.flatnonzero(first)
        head = heads[np.cumsum(first) - 1]
        x, y = heads[:-1], heads[1:]
        same = token[x] == token[y]
        x, y = np.concatenate([head[~first], x[same]]), np.concatenate([np.flatnonzero(~first), y[same]])
        fits = survives(size[x], size[y], place[x], place[y])
        a, b = _distinct(who[x[fits]], who[y[fits]])
        crowded = (length[run] > ALL_PAIRS) | dealt
        left, right = [], []
        calm = np.flatnonzero(~crowded)
        for step in range(1, ALL_PAIRS):
            x, y = calm[:-step], calm[step:]
            same = token[x] == token[y]
            if not same.any():
                break
            x, y = x[same], y[same]
            fits = survives(size[x], size[y], place[x], place[y])
            left.append(who[x[fits]])
            right.append(who[y[fits]])
        c, d = _distinct(*(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right)))
        hot = np.flatnonzero(crowded)
        pairs, entries = len(a) + len(c), len(hot)
        mask = np.arange(pairs + entries) < pairs
        none = np.zeros(pairs, np.int64)
        return pa.table(
            [
                pa.array(np.concatenate([none, token[hot].view(np.int64)]), mask=mask),
                pa.array(np.concatenate([a, c, who[hot]])),
                pa.array(np.concatenate([b, d, np.zeros(entries, np.int64)]), mask=~mask),
                pa.array(np.concatenate([none, size[hot]]).astype(np.int32), mask=mask),
                pa.array(np.concatenate([none, place[hot]]).astype(np.int32), mask=mask),
                pa.array(np.arange(pairs + entries) < len(a)),
            ],
            ["token", "a", "b", "size", "place", "head"],
        )

    return meet


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, the smaller set first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[fresh], b[fresh]


def _met(frame: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of different components that pass the length, positional and suffix filter at a common shingle.

    Yields (who, x, y, spare): the sets of the frame, places of the pairs in it, and by how much the
    bound of a pair exceeds what a link needs. Of the sets' shingles before their places none is
    common if the shingle at these places is their first common one, and the pair that links passes there.
    """
    key, side = frame["key"].to_numpy(), frame["side"].to_numpy()
    order = np.argsort(key, kind="stable")
    key, side = key[order], side[order]
    who, root, size, place = (frame[c].to_numpy()[order] for c in ("set_id", "root", "size", "place"))
    size, place = size.astype(np.int64), place.astype(np.int64)
    counts = np.zeros((len(key), SEGMENTS), np.int32)
    for k, data in enumerate(frame["suffix"].take(pa.array(order)).to_pylist()):
        counts[k] = counts_of(data)
    _, run, length = np.unique(key, return_inverse=True, return_counts=True)
    after = np.cumsum(length)[run] - np.arange(len(key)) - 1 if len(key) else length
    x, step = np.arange(len(key)), 1
    while len(x := x[after[x] >= step]):
        y = x + step
        fits = (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 2)) & survives(size[x], size[y], place[x], place[y])
        x_fits, y_fits = x[fits], y[fits]
        for at in range(0, len(x_fits), 4096):
            a, b = x_fits[at : at + 4096], y_fits[at : at + 4096]
            most = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64)
            spare = 7 * most - 3 * (size[a] + size[b])
            if (enough := spare >= 0).any():
                yield who, a[enough], b[enough], spare[enough]
        step += 1


def _nearest(frame: pa.Table) -> pa.Table:
    """For each set of a component other than its shingle's main one, the partner with the highest bound."""
    best: dict[str, np.ndarray] = {}
    names = frame["set_id"].to_numpy()
    top, partner = np.full(len(names), -1, np.int64), np.zeros(len(names), np.int64)
    for who, x, y, spare in _met(frame):
        best["who"] = who
        for one, other in ((x, y), (y, x)):
            more = spare > top[one]
            top[one[more]], partner[one[more]] = spare[more], who[other[more]]
    found = np.flatnonzero(top >= 0)
    who = best.get("who", names)
    return pa.table([pa.array(who[found]), pa.array(top[found]), pa.array(partner[found])], ["a", "spare", "b"])


def _all_near(frame: pa.Table) -> pa.Table:
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for who, x, y, _ in _met(frame):
        left.append(who[x])
        right.append(who[y])
    return pa.table(list(map(pa.array, _distinct(np.concatenate(left), np.concatenate(right)))), ["a", "b"])


def _several(placed: DataFrame) -> DataFrame:
    """The shingles (token) whose sets lie in several components, with k sets, m of them in the component main."""
    tokens = placed.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.sum("c").alias("k"), F.max("c").alias("m"), F.max_by("root", "c").alias("main"), F.count("*").alias("several")
    )
    return tokens.where("several > 1").drop("several")


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots, entries["set_id"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "set_id"))


def _suffixes(hot: DataFrame, roots: DataFrame, segments: DataFrame) -> DataFrame:
    """(token, set_id, size, place, suffix): entries of shingles of several components, with the counts of the set's shingles from there on."""
    open_ = hot.join(_several(_rooted(hot, roots)).select("token"), "token", "left_semi")
    own = open_.groupBy("set_id").agg(F.collect_list(F.struct("token", "size", "place")).alias("entries"))  # of one prefix
    names = ["token", "set_id", "size", "place", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                set_, entries, data, bins = (batch.column(c)[at].as_py() for c in ("set_id", "entries", "segments", "bins"))
                entries.sort(key=lambda e: e["place"])
                counts, bins, upto, suffix = counts_of(data).astype(np.int64), np.frombuffer(bins, np.uint8), 0, []
                for e in entries:
                    counts -= np.bincount(bins[upto : e["place"]], minlength=SEGMENTS)
                    upto = e["place"]
                    suffix.append(packed_counts(counts))
                token, size, place = (pa.array([e[c] for e in entries], k) for c, k in (("token", pa.int64()), ("size", pa.int32()), ("place", pa.int32())))
                columns = [token, pa.array([set_] * len(entries), pa.int64()), size, place, pa.array(suffix, pa.binary())]
                yield from sliced(pa.RecordBatch.from_arrays(columns, names))

    found = own.join(segments, "set_id").mapInArrow(run, "token bigint, set_id bigint, size int, place int, suffix binary")
    return materialize(found, "jaccard-suffixes")


def _meetings(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of shingles whose sets lie in several components, dealt to groups in which they meet.

    The sets of a shingle's main component need not meet each other. A shingle of more than
    ``BLOCK_SETS`` sets is cut into blocks, main and others; two blocks meet in a group of their own.
    """
    tokens = materialize(_several(_rooted(entries.drop("suffix"), roots)), "jaccard-open")
    placed = _rooted(entries, roots)
    total = tokens.agg(F.sum("k")).first()[0] or 0
    placed = placed.join(tokens, "token")
    blocks = f"""
        case when k <= {BLOCK_SETS} then array(named_struct('i', 0, 'j', 0, 'side', 2))
        when root = main then transform(sequence(0, g_rest - 1), j -> named_struct('i', -1 - own_main, 'j', j, 'side', 0))
        else concat(
          transform(sequence(0, g_main - 1), i -> named_struct('i', -1 - i, 'j', own_rest, 'side', 1)),
          transform(sequence(0, g_rest - 1), j -> named_struct('i', least(j, own_rest), 'j', greatest(j, own_rest),
            'side', case when j = own_rest then 2 when own_rest < j then 0 else 1 end))) end"""
    placed = placed.withColumns({
        "g_main": F.expr(f"cast(ceil(m / {BLOCK_SETS}) as int)"),
        "g_rest": F.expr(f"cast(ceil((k - m) / {BLOCK_SETS}) as int)"),
    }).withColumns({
        "own_main": F.expr("cast(pmod(xxhash64(set_id), g_main) as int)"),
        "own_rest": F.expr("cast(pmod(xxhash64(set_id), g_rest) as int)"),
    }).withColumn("at", F.explode(F.expr(blocks)))
    buckets = max(1, -(-total // MEETING))
    return placed.select(
        F.expr(f"case when k <= {BLOCK_SETS} then pmod(xxhash64(token), {buckets}L) else xxhash64(token, at.i, at.j) end").alias("bucket"),
        F.expr("xxhash64(token, at.i, at.j)").alias("key"),
        F.col("at.side").alias("side"), "set_id", "root", "size", "place", "suffix",
    )


def _passed(docs: DataFrame, wanted: DataFrame, make, names: str) -> DataFrame:
    """(row, own, ...): what ``make`` gives for the shingles of the wanted rows, and of few others; own is the set.

    A bitmap of the wanted rows spares the other documents the work. row hashes id and text, so it
    also names documents without an id or with a repeated one.
    """
    flags = marks(wanted, "row")
    columns = [c.split()[0] for c in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = Words(), set()
        for batch in batches:
            batch = batch.filter(pa.array(marked(flags.value, batch.column("row").to_numpy())))
            rows, values = [], [[] for _ in columns]
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if row not in done:  # repeated rows
                    done.add(row)
                    own = shingles(text, known)
                    rows.append((row, set_id(own)))
                    for column, value in zip(values, make(own), strict=True):
                        column.append(value)
            data = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)]
            data += [pa.array(v, pa.binary()) for v in values]
            yield from sliced(pa.RecordBatch.from_arrays(data, ["row", "own", *columns]))

    return docs.select("row", "text").mapInArrow(run, f"row bigint, own bigint, {names}")


def _segments_of(docs: DataFrame, wanted: DataFrame, levels) -> DataFrame:
    """(set_id, segments, bins): counts of a set's shingles by segment, and the segments of its prefix in order."""

    def make(own: np.ndarray) -> tuple[bytes, bytes]:
        _, bins = rare_first(own, levels.value)
        return packed_counts(np.bincount(segment(own), minlength=SEGMENTS)), bins.astype(np.uint8).tobytes()

    wanted = materialize(wanted, "jaccard-wanted")
    found = _passed(docs, wanted, make, "segments binary, bins binary").join(wanted, "row").where("own = set_id")
    return materialize(found.select("set_id", "segments", "bins").dropDuplicates(["set_id"]), "jaccard-segments")


def _fitting(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs whose overlap, bounded by the counts of their segments, is enough for a link."""
    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = counts_of(x).astype(np.int64), counts_of(y).astype(np.int64)
                keep.append(7 * int(np.minimum(x, y).sum()) >= 3 * int(x.sum() + y.sum()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(segments.select(F.col("set_id").alias("a"), F.col("segments").alias("x")), "a")
    joined = joined.join(segments.select(F.col("set_id").alias("b"), F.col("segments").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(fits, "a bigint, b bigint")


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link: one exact check of each pair, whose sets are sent to it."""
    of_a, of_b = (reps.select(F.col("set_id").alias(c), F.col("row").alias(f"row_{c}")) for c in "ab")
    pairs = materialize(pairs.join(of_a, "a").join(of_b, "b"), "jaccard-checks")
    wanted = pairs.select(F.col("row_a").alias("row")).unionAll(pairs.select("row_b")).distinct()
    sets = _passed(docs, wanted, lambda own: (own.tobytes(),), "data binary")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Both sides read one exchange of the sets, by row.
    x, y = (sets.select(F.col("row").alias(f"row_{c}"), F.col("own").alias(f"own_{c}"), F.col("data").alias(d)) for c, d in ("ax", "by"))
    joined = pairs.join(x, "row_a").where("own_a = a").join(y, "row_b").where("own_b = b")
    return materialize(joined.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "jaccard-links")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """(rows, reps, links, roots): a row for each document, for each distinct set, for each link, and for each linked set."""
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    profile = materialize(docs.mapInArrow(_profile, _PROFILE), "jaccard-profile")
    rows = profile.where("block is null")
    reps = rows.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n").alias("n")
    )
    reps = materialize(reps, "jaccard-reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    usual = total / (1 << SKETCH_BITS)
    buckets = max(1, -(-total // (4 * BUCKET)))
    levels = spark.sparkContext.broadcast(_sketch(profile))  # 2**SKETCH_BITS bytes, whatever the input
    entries = _prefixes(docs, levels, buckets, usual).groupBy("bucket")
    found = materialize(entries.applyInArrow(_candidates(usual), _CANDIDATES), "jaccard-candidates")
    proposed = found.where("b is not null").groupBy("a", "b").agg(F.max("head").alias("head"))
    proposed = materialize(proposed, "jaccard-proposed")
    hot = found.where("b is null").select("token", F.col("a").alias("set_id"), "size", "place")

    wanted = proposed.select(F.col("a").alias("set_id")).unionAll(proposed.select("b")).unionAll(hot.select("set_id"))
    segments = _segments_of(docs, reps.select("set_id", "row").join(wanted.distinct(), "set_id", "left_semi"), levels)
    checked = materialize(_fitting(proposed.where("head").select("a", "b"), segments), "jaccard-pairs")
    links = _linked(docs, reps, checked)
    roots = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        x, y = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        apart = pairs.join(x, "a", "left").join(y, "b", "left")
        return apart.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")

    # Pairs between components: those of shingles that are not crowded; then of crowded ones each set's
    # most promising partner, again as long as many of them link; then all that are left.
    entries, step, first = None, "calm", None
    while True:
        if step == "calm":
            more = _fitting(apart(proposed.where("not head").select("a", "b")), segments)
        else:
            entries = entries or _suffixes(hot, roots, segments)
            met = _meetings(entries, roots).groupBy("bucket")
            if step == "nearest":
                more = met.applyInArrow(_nearest, "a bigint, spare bigint, b bigint")
                more = more.groupBy("a").agg(F.max(F.struct("spare", "b"))["b"].alias("b"))
                more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            else:
                more = met.applyInArrow(_all_near, "a bigint, b bigint")
        more = materialize(more.distinct().join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
        if many := more.count():
            found = _linked(docs, reps, more)
            links, checked = links.unionAll(found), checked.unionAll(more)
            roots = components(links)
        if step == "all":
            break
        if step == "calm":
            step = "nearest"
        else:
            first = first or many
            step = "nearest" if many and 20 * many >= first and 4 * found.count() >= many else "all"
    return rows, reps, links, roots


def join(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of 0.75 or more.

    1. One pass hashes the shingles of every whole text, names equal sets alike, and counts
       shingles in a sketch of fixed size. Its counts order shingles rare first; any order that
       all documents share gives the same links, so collisions cost time only.
    2. A second pass deals each distinct set's prefix over buckets. There pairs that share a prefix
       shingle pass the length and the positional filter: first each set with the head of its size
       class; a shingle of up to ``ALL_PAIRS`` sets also gives its other pairs, for later.
    3. A bound by counts of hash ranges rules pairs with heads out; those that pass are checked once
       against all their shingles. Links give components.
    4. The later pairs between different components are bounded and checked.
    5. Crowded shingles whose sets lie in several components are looked at again: pairs of different
       components must pass the length, the positional and the suffix filter (counts of hash
       ranges without the shingles before the common one). In rounds each set's partner with the
       highest bound is checked, as long as a quarter of them link; then all pairs that are left
       between components.

    So every pair is checked, ruled out by a bound, or already connected. Pairs of crowded shingles
    that a filter rules out are numbers inside a task, never rows. What still
    grows with the square of a shingle's sets is that comparison of bounds, where thousands of sets
    share a rare shingle and yet do not link; it is dealt over groups of blocks of sets.
    Sets and shingles are compared by 64-bit hashes.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach). Null, empty
    and wordless texts have no shingles and are alone. Repeated rows are copies. A null id stays
    null and takes part. Other columns are not read; an empty table gives no rows. with_row adds
    row, the hash of doc_id and text, which tells texts of one id apart.
    """
    rows, reps, _, roots = _classes(docs)
    named = reps.select("set_id", "doc_id").join(roots, reps["set_id"] == roots["node"], "left")
    named = named.select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(F.col("set_id").alias("named"), "component_id")
    return rows.join(named, rows["set_id"] == named["named"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *(["row"] if with_row else []),
    )


def links(docs: DataFrame) -> DataFrame:
    """(a, b): the verified links between the smallest ids of distinct sets, which connect every component.

    Links inside a component that its other links connect already are not all verified. Sets whose
    documents have no id are left out.
    """
    _, reps, found, _ = _classes(docs)
    x, y = reps.select(F.col("set_id").alias("a"), F.col("doc_id").alias("x")), reps.select(F.col("set_id").alias("b"), F.col("doc_id").alias("y"))
    found = found.join(x, "a").join(y, "b").where("x is not null and y is not null")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 1000)
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from items a join items b on a.x = b.x and a.doc_id <> b.doc_id and a.n * 4 >= 3 * b.n and b.n * 4 >= 3 * a.n group by 1, 2),
links as (select a, b from pairs where 100 * common >= 75 * (na + nb - common)),
reach(doc_id, r) as (
  select doc_id, doc_id from sets
  union
  select l.b, x.r from reach x join links l on l.a = x.doc_id)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.r) as component_id from sets s join reach r on r.doc_id = s.doc_id group by 1, 2
"""
