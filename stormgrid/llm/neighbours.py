"""Nearest neighbours: inverted lists of coarse centroids with product-quantised residuals, pruned by exact bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormgrid.llm.common import materialize, sliced, table

NEAREST = 20
QUERY_STEP = 20
SEED = 7
SAMPLE = 16_384  # rows that the index is fitted on, at most, whatever the size of the table
MOST_LISTS = 1024  # coarse centroids: the square root of the number of rows, up to this
PROBES = 0.7  # share of the lists that a query visits at first; its bounds then choose further ones
PARTS, CODES = 16, 256  # subspaces of a residual, and codewords of each
SHORTLIST = 256  # candidates of a block whose exact scores give the bound that the others must reach
ROWS, QUERIES = 8192, 4096  # of a block of lists, and queries that meet it in one group
CHUNK = 256  # queries that a task looks at together


@dataclass
class Index:
    centroids: np.ndarray  # lists x dims
    codebooks: np.ndarray  # parts x codes x dims of a part
    cuts: np.ndarray  # where the parts begin

    def assign(self, x: np.ndarray) -> np.ndarray:
        norms = (self.centroids**2).sum(1) / 2
        return np.argmax(x @ self.centroids.T - norms, axis=1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of rows; how far each lies from its centroid; and how far its inner product with a unit vector may be from the estimate."""
        rest = x - self.centroids[lists]
        coded = np.empty_like(rest)
        out = np.empty((len(x), len(self.codebooks)), np.uint8)
        for m, book in enumerate(self.codebooks):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            book = book[:, : part.shape[1]]
            out[:, m] = np.argmax(part @ book.T - (book**2).sum(1) / 2, axis=1)
            coded[:, self.cuts[m] : self.cuts[m + 1]] = book[out[:, m]]
        far, centre, size = (np.linalg.norm(v, axis=1) for v in (rest, self.centroids[lists], coded))
        # Estimates are sums of floats, whose rounding counts as well; that of doubles is far below it.
        return out, far + 1e-9 * (far + centre), np.linalg.norm(rest - coded, axis=1) + 1e-5 * (centre + size)

    def estimates(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of whole queries with coded rows of list ``at``, queries x rows."""
        out = np.repeat((queries @ self.centroids[at])[:, None], len(codes), axis=1).astype(np.float32)
        for m, book in enumerate(self.codebooks):
            part = queries[:, self.cuts[m] : self.cuts[m + 1]]
            distances = (part @ book[:, : part.shape[1]].T).astype(np.float32)
            out += np.take(distances, codes[:, m], axis=1)
        return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from distinct rows, seeded."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        counts = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1][filled]
        centres[filled] = np.add.reduceat(x[order], starts, axis=0) / counts[filled, None]
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    centroids = kmeans(sample, lists)
    dims = sample.shape[1]
    parts = min(PARTS, dims)
    cuts = np.linspace(0, dims, parts + 1).round().astype(int)
    index = Index(centroids, np.zeros((0, 0, 0)), cuts)
    rest = sample - centroids[index.assign(sample)]
    books = np.zeros((parts, CODES, int(np.diff(cuts).max())))
    for m in range(parts):
        part = rest[:, cuts[m] : cuts[m + 1]]
        book = kmeans(part, CODES, 6)
        books[m, :, : part.shape[1]] = book[0]
        books[m, : len(book), : part.shape[1]] = book
    index.codebooks = books
    return index


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Left out: null, empty and all-zero vectors, and those with a null or non-finite component.
    """
    v = F.col("embedding").cast("array<double>")
    fine = "forall(vector, x -> x is not null and x = x and abs(x) < double('infinity')) and exists(vector, x -> x != 0)"
    return vectors.select("vec_id", v.alias("vector")).where(f"vec_id is not null and vector is not null and {fine}")


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _laid_out(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its group, and how many blocks of ``ROWS`` rows its group is cut into."""
    group, blocks = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    now, held = 0, 0
    for at in range(lists):
        size = sizes.get(at, 0)
        if held and held + size > ROWS:
            now, held = now + 1, 0
        group[at], held = now, held + size
        if size > ROWS:
            blocks[at] = -(-size // ROWS)
    return group, blocks


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where a row has fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def _nearest(
    index: Index, q: np.ndarray, who: np.ndarray, floor: np.ndarray, visited: np.ndarray,
    ids: np.ndarray, at: np.ndarray, x: np.ndarray, codes: np.ndarray, off: np.ndarray, nearest: int, kept: int | None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's nearest rows of its visited lists, among those that reach its ``floor``; exact.

    Rows lie in order of their list ``at``. Where no floor is known, the ``kept`` rows of best
    estimate give one. Rows whose estimate, and what it may be wrong by (``off``), stay below
    the floor are out; the others are scored with the original vectors.
    """
    present, starts = np.unique(at, return_index=True)
    ends = [*starts[1:].tolist(), len(at)]
    norms, lengths = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    guess, may = np.full((len(q), len(ids)), -np.inf, np.float32), np.zeros((len(q), len(ids)), bool)
    for one, begin, end in zip(present.tolist(), starts.tolist(), ends, strict=True):
        own = np.flatnonzero(visited[:, one])
        if len(own):
            guess[own, begin:end] = index.estimates(q[own], one, codes[begin:end])
            may[own, begin:end] = True
    may &= ids != who[:, None]
    floor = floor.copy()
    if kept is not None and kept < len(ids):
        for k in np.flatnonzero(floor == -np.inf):
            row = np.where(may[k], guess[k], -np.inf)
            short = np.argpartition(row, len(row) - kept)[len(row) - kept :]
            short = short[may[k, short]]
            if len(short) >= nearest:
                floor[k] = np.partition((x[short] * q[k]).sum(axis=1), len(short) - nearest)[len(short) - nearest]
    # What is not a number is below no bound, so it is looked at.
    may &= ~(guess < floor[:, None] - norms[:, None] * off)
    left = np.flatnonzero(may.any(axis=0))
    may, ids, x = may[:, left], ids[left], x[left]
    near = np.where(may, q @ x.T, -np.inf)
    # Products of matrices round otherwise than the sums that count.
    slack = x.shape[1] * 2.0**-50 * norms * lengths.max(initial=0.0)
    may &= ~(near < (np.maximum(floor, _kth(near, nearest)) - 2 * slack)[:, None])
    for k in range(len(q)):
        short = np.flatnonzero(may[k])
        exact = (x[short] * q[k]).sum(axis=1)
        best = np.lexsort((ids[short], -exact))[:nearest]
        yield k, ids[short][best], exact[best]


def search(
    vectors: DataFrame, step: int = QUERY_STEP, nearest: int = NEAREST, probes: float = PROBES, shortlist: int | None = SHORTLIST
) -> DataFrame:
    """The ``nearest`` rows of every row whose vec_id is divisible by ``step``, exactly.

    The index is fitted on at most ``SAMPLE`` rows chosen by a hash of their id, and holds every
    row: its list's number, the product-quantised residual, and how far the row lies from its code;
    and of each list how far its rows lie from its centroid. A query first visits its best lists:
    ``probes`` is their share at least, and where these hold fewer than ``nearest`` other rows,
    it goes on until they do. The last score that it has then is its floor: with it, it visits every
    further list that may hold a row that reaches it, as an inner product is off from the
    centroid's by at most the query's norm times the distance from the centroid. So the index saves
    work on any rows and misses none; ``probes`` and ``shortlist`` are only a matter of speed.

    Lists are packed into blocks of about ``ROWS`` rows, a crowded one into several, and queries
    of a block into groups of about ``QUERIES``, so that no task gets more of either and blocks are
    copied for their own visitors only. In a block, tables of inner products score the codes of the
    visited lists. The best ``shortlist`` give a floor, rows that cannot reach it by
    their code are left out, and the others are scored with the original vectors in double
    precision. Equal scores rank by vec_id. A row is not its own neighbour.

    Rows that ``usable`` leaves out take no part. Vectors of each length are searched by themselves, as
    inner products of different lengths mean nothing. If a vec_id repeats, each row is a candidate, and
    queries of one id and length are one query (its smallest vector). Empty tables give no rows.
    """
    rows = materialize(usable(vectors), "neighbours")
    counts = rows.groupBy(F.size("vector").alias("dims")).count().orderBy("dims").toLocalIterator()
    out = None
    for dims, n in counts:
        found = _search(rows.where(F.size("vector") == dims), n, step, nearest, probes, shortlist)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return out


def _search(rows: DataFrame, n: int, step: int, nearest: int, probes: float, shortlist: int | None) -> DataFrame:
    """``search`` over n usable rows of one length."""
    order = F.xxhash64("vec_id", F.lit(SEED))
    share = min(1.0, 1.2 * SAMPLE / n + 0.01)
    bound = int((share - 0.5) * 2.0**64) if share < 1 else 2**63 - 1
    picked = rows.where(order <= F.lit(bound)).orderBy(order, "vec_id").limit(SAMPLE).select("vector").toArrow()
    dims = len(picked["vector"][0])
    index = fit(_matrix(picked["vector"], dims), int(min(max(1, n**0.5), MOST_LISTS)))
    lists = len(index.centroids)
    visits = min(lists, max(4, round(probes * lists)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)
            at = index.assign(x)
            codes, far, off = index.codes(x, at)
            columns = [batch.column("vec_id"), batch.column("vector"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(far), pa.array(off)], ["vec_id", "vector", "list", "code", "far", "off"])

    held = rows.mapInArrow(coded, "vec_id bigint, vector array<double>, list int, code binary, far double, off double")
    held = materialize(held, "neighbours-index")
    # One row for each list: at most MOST_LISTS.
    of_list = {r["list"]: r for r in held.groupBy("list").agg(F.count("*").alias("size"), F.max("far").alias("far")).toLocalIterator()}
    sizes = {at: r["size"] for at, r in of_list.items()}
    group_of, blocks_of = _laid_out(sizes, lists)
    size_of = np.array([sizes.get(at, 0) for at in range(lists)])
    radius = np.array([of_list[at]["far"] if at in of_list else 0.0 for at in range(lists)])
    kept = None if shortlist is None else max(shortlist, nearest)

    def probed(further: bool):
        def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each block that a query meets, with the lists that it visits there: its best, or further ones that reach its floor."""
            for batch in (b.slice(start, CHUNK) for b in batches for start in range(0, b.num_rows, CHUNK)):
                x = _matrix(batch.column("vector"), dims)
                scores = x @ index.centroids.T
                best = np.argsort(-scores, axis=1, kind="stable")
                # Rows of the query's own id, which are no candidates, may lie in any of the lists.
                needed = nearest + batch.column("own").to_numpy()
                enough = (np.cumsum(size_of[best], axis=1) < needed[:, None]).sum(1) + 1
                if further:
                    reach = scores + np.linalg.norm(x, axis=1)[:, None] * radius
                    open_lists = ~(reach < batch.column("floor").to_numpy()[:, None]) & (size_of > 0)
                who, parts, blocks, visited = [], [], [], []
                for k, near in enumerate(best):
                    first = max(visits, int(enough[k]))
                    own = np.sort(near[first:][open_lists[k, near[first:]]] if further else near[:first])
                    groups = group_of[own]
                    for g in np.unique(groups):
                        at = own[groups == g]
                        for block in range(int(blocks_of[at].max())):
                            who.append(k)
                            parts.append(int(g))
                            blocks.append(block)
                            visited.append(at.tolist())
                taken = batch.take(pa.array(who, pa.int64()))
                columns = [*(taken.column(c) for c in ("vec_id", "vector", "floor")), pa.array(parts, pa.int64()), pa.array(blocks, pa.int64())]
                names = ["query_id", "vector", "floor", "part", "block", "visited"]
                yield from sliced(pa.RecordBatch.from_arrays([*columns, pa.array(visited, pa.list_(pa.int32()))], names))

        return lists_of

    def meet(asking: pa.Table, block: pa.Table) -> pa.Table:
        ids, who = block["vec_id"].to_numpy(), asking["query_id"].to_numpy()
        found: tuple[list, list, list] = ([], [], [])
        if len(ids) and len(who):
            at = block["list"].to_numpy()
            order = np.lexsort((ids, at))
            ids, at, x, off = ids[order], at[order], _matrix(block["vector"], dims)[order], block["off"].to_numpy()[order]
            codes = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            q, floor = _matrix(asking["vector"], dims), asking["floor"].to_numpy()
            visited = np.zeros((len(q), lists), bool)
            for k, own in enumerate(asking["visited"].to_pylist()):
                visited[k, own] = True
            for a in range(0, len(q), CHUNK):
                some = slice(a, a + CHUNK)
                for k, near, score in _nearest(index, q[some], who[some], floor[some], visited[some], ids, at, x, codes, off, nearest, kept):
                    found[0].append(np.full(len(near), who[a + k]))
                    found[1].append(near)
                    found[2].append(score)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in found]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])

    def met(asking: DataFrame, further: bool) -> DataFrame:
        """(query_id, vec_id, score) of the nearest rows of each block that the queries meet."""
        asked = materialize(asking.mapInArrow(
            probed(further), "query_id bigint, vector array<double>, floor double, part bigint, block bigint, visited array<int>"
        ), "neighbours-asked")
        # A block is copied once for each QUERIES queries that visit it. One row for each part: at most MOST_LISTS.
        visitors = asked.groupBy("part", "block").count().groupBy("part").agg(F.max("count").alias("most"))
        crowds_of = {r["part"]: -(-r["most"] // QUERIES) for r in visitors.toLocalIterator()}
        crowds = [crowds_of.get(int(g), 0) for g in group_of]
        of_part = F.create_map(*(F.lit(x) for g in sorted(set(group_of.tolist())) for x in (int(g), max(1, crowds_of.get(int(g), 1)))))
        asked = asked.withColumn("crowd", F.pmod(F.xxhash64("query_id", F.lit(1)), of_part[F.col("part")].cast("long")))
        places = F.array([
            F.struct(F.lit(int(g)).cast("long").alias("part"), F.lit(int(b)).alias("blocks"), F.lit(int(c)).cast("long").alias("crowds"))
            for g, b, c in zip(group_of, blocks_of, crowds, strict=True)
        ])
        place = F.element_at(places, F.col("list") + 1)
        blocks = held.withColumn("place", place).select(
            F.col("place.part").alias("part"),
            F.pmod(F.xxhash64("vec_id"), F.col("place.blocks")).alias("block"),
            F.explode(F.expr("case when place.crowds > 0 then sequence(0L, place.crowds - 1) end")).alias("crowd"),
            "list", "vec_id", "vector", "code", "off",
        )
        keys = ("part", "block", "crowd")
        return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")

    asking = rows.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count("*").alias("own"))
    first = ranked(met(asking.withColumn("floor", F.lit(float("-inf"))), False))
    if visits == lists:
        return first
    first = materialize(first, "neighbours-first")
    # A query with fewer than it asks for has visited all lists.
    floors = first.where(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    more = met(asking.join(floors, "vec_id"), True)
    return ranked(first.select("query_id", "vec_id", "score").unionAll(more))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
