"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.llm.common import materialize

CHUNK = 1 << 19  # links that one task holds at once


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer links that connect the same nodes: those of each chunk, from every node to its root."""
    root: dict[int, int] = {}
    held = 0

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= CHUNK:
            yield stars()
            root.clear()
            held = 0
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node on its smallest neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    hung = near.join(least, "a")
    moved = hung.where("b > a") if large else hung
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.unionAll(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); the root is the component's smallest node.

    Chunks of links of bounded size first become stars; one chunk is done then. Each round makes two
    stars, is written to the shared folder, and about halves the distance to the root at least. Sums
    of hashes tell when a round changes nothing.
    """
    edges = materialize(links.where("a <> b").selectExpr("cast(a as bigint) a", "cast(b as bigint) b"), "components")
    tasks = edges.count() // CHUNK + 1
    edges = materialize(edges.coalesce(tasks).mapInArrow(_forest, "a bigint, b bigint"), "components")
    mark = None
    while tasks > 1:
        edges = materialize(_star(_star(edges, True), False), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    node = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return node.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
