"""Centroid clustering: k-means in whole numbers, assigned by the threshold algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.llm.common import small_batches, table

DIM = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = "3"
#: Rows that are walked at once.
BLOCK = 4096


def most_value(dim: int) -> float:
    """The power of two below which numbers must be, so that a squared distance fits a long."""
    return float(1 << (61 - max(1, dim - 1).bit_length()) // 2)


def usable(vector: Column, dim: int = DIM, scale: float = SCALE) -> Column:
    """Exactly ``dim`` components, none null, not finite, or too large for whole distances."""
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * float(scale)) < most_value(dim)))
    return (F.size(vector) == dim) & F.coalesce(fits, F.lit(False))


def whole(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of list components, as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), dim)


class SortedLists:
    """For each dimension the centroids in the order of their value there."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.order = centroids.argsort(axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, 0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; ties go to the smaller number.

        All lists of a vector are walked outward from its value, one entry of each list a step. A
        centroid that a list shows first is measured exactly. A centroid that no list has shown is
        at least as far as the frontier in every dimension, so the walk of a vector ends once the
        sum over the frontiers is more than its best distance: at equality one with a smaller
        number might still come.
        """
        k, n = len(self.centroids), len(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        which = np.zeros(n, np.int64)
        dims = np.arange(vectors.shape[1])
        # How many values of each list lie below the vector's: the walk goes down from there and up.
        up = (self.values[None, :, :] < vectors[:, None, :]).sum(1)
        down = up - 1
        seen = np.zeros((n, k), bool)
        live = np.arange(n)
        for _ in range(k):
            x, lo, hi = vectors[live], down[live], up[live]
            far = np.iinfo(np.int64).max
            below = np.where(lo >= 0, x - self.values[np.maximum(lo, 0), dims], far)
            above = np.where(hi < k, self.values[np.minimum(hi, k - 1), dims] - x, far)
            lower = below <= above
            shown = self.order[np.where(lower, lo, hi), dims]
            frontier = np.where(lower, below, above)
            down[live], up[live] = lo - lower, hi + ~lower
            now = np.zeros((len(live), k), bool)
            np.put_along_axis(now, shown, True, 1)
            fresh = now & ~seen[live]
            seen[live] |= now
            for c in np.flatnonzero(fresh.any(0)):
                at = np.flatnonzero(fresh[:, c])
                rows = live[at]
                d = ((x[at] - self.centroids[c]) ** 2).sum(1)
                better = (d < best[rows]) | ((d == best[rows]) & (c < which[rows]))
                best[rows[better]], which[rows[better]] = d[better], c
            live = live[(frontier * frontier).sum(1) <= best[live]]
            if not len(live):
                break
        return which, best


def _assigned(batches: Iterator[pa.RecordBatch], lists: SortedLists, dim: int, scale: float):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vectors = whole(part.column("vector"), dim, scale)
            yield part, vectors, *lists.nearest(vectors)


def first_centroids(kept: DataFrame, k: int, seed: str, scale: float) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; of one id, the smaller vector first, null ids last."""
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    numbers = F.transform("vector", lambda x: F.floor(x.cast("double") * float(scale)))
    ranked = kept.select(F.when(F.col("vec_id").isNotNull(), key).alias("key"), numbers.alias("numbers"))
    rows = ranked.orderBy(F.col("key").asc_nulls_last(), "numbers").limit(k).collect()
    return np.array([r["numbers"] for r in rows], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays.

    Tasks send one row for each centroid and dimension; sums are exact decimals. The driver gets
    clusters times dimensions rows, whatever the table's size.
    """
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total, count = SortedLists(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        held = 0

        def out() -> pa.RecordBatch:
            columns = [np.repeat(np.arange(k), dim), np.tile(np.arange(dim), k), np.repeat(count, dim), total.ravel()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "d", "n", "total"])

        for _, vectors, which, _ in _assigned(batches, lists, dim, scale):
            for c in range(k):
                mine = vectors[which == c]
                total[c] += mine.sum(0)
                count[c] += len(mine)
            held += len(vectors)
            if held >= 1 << 34:  # of numbers below 2**28: sums below 2**62
                yield out()
                total[:], count[:], held = 0, 0, 0
        yield out()

    partial = kept.select("vector").mapInArrow(sums, "cluster bigint, d bigint, n bigint, total bigint")
    exact = partial.groupBy("cluster", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in exact.where("n > 0").collect():
        out[r["cluster"], r["d"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: float = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids.

    k-means on the whole numbers floor(scale * x). The vectors are never shuffled nor copied: each
    round reads them in place and sends k * dim partial sums a task. A vector finds its centroid by
    the threshold algorithm (:meth:`SortedLists.nearest`), which is exact.

    Vectors that are null, have another number of components, or a null, non-finite or too large
    one (:func:`most_value`: at 64 components |x| of 131072 or more) take no part. Rows
    with repeated or null ids take part as rows. With fewer than k vectors there are as many
    centroids; with none, no row comes back. Equal centroids: the smaller number takes all.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kept = kept.where(usable(F.col("vector"), dim, scale))
    centroids = first_centroids(kept, k, seed, scale)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids.reshape(0, dim)
    for _ in range(rounds):
        after = moved(kept, centroids, scale)
        if np.array_equal(after, centroids):
            break  # a fixpoint: further rounds change nothing
        centroids = after

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for part, _, which, best in _assigned(batches, lists, dim, scale):
            columns = [part.column("vec_id"), pa.array(which, pa.int32()), pa.array(best, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(final, schema), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add each cluster's and the whole inertia and the sha256 of the cluster's centroid: k rows are broadcast."""
    spark = found.sparkSession
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia[c], total, digest[c]) for c in sorted(inertia)]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return found.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 4096)
    found = with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same in SQL, a list comparison for each vector and centroid, round after round."""
    seen = f"""with v as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x) and abs(x::double * {SCALE}) < {most_value(DIM):.0f})) = {DIM}),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 as c, v as m from v order by 1 limit {CLUSTERS})"""
    near = "select vec_id, v, (min({{'d': d, 'c': c}})).c as c, (min({{'d': d, 'c': c}})).d as d from (select vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d, n from (select *, row_number() over () as n from v) v, c{k}) q group by vec_id, v, n"
    for k in range(ROUNDS):
        seen += f""",
a{k} as materialized ({near.format(k=k)}),
s{k} as (select c, d, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::bigint as x from (select c, unnest(v) as x, generate_subscripts(v, 1) as d from a{k}) q group by 1, 2),
c{k + 1} as materialized (select c0.c, coalesce(n.m, c0.m) as m from c{k} c0 left join (select c, list(x order by d) as m from s{k} group by 1) n on n.c = c0.c)"""
    return f"""{seen},
f as ({near.format(k=ROUNDS)}),
i as (select c, sum(d)::bigint as s from f group by 1)
select f.vec_id, f.c::int as cluster, f.d::bigint as distance, i.s as cluster_inertia, (select sum(s)::bigint from i) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from f join i on i.c = f.c join c{ROUNDS} r on r.c = f.c"""


SQL = _sql()
