"""Neighbours in Voronoi diagrams: empty circles on near witnesses first, wider ones only where a cell is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormgrid.operators.networks import settled

#: Graphs of up to so many points are tested against all their points at once.
SMALL = 64
#: Neighbours of a point that are looked at together, at most, and points that a cell of the first round holds.
CROWD, FIRST = 200, 12
#: Doublings of the reach in which cells may close.
ROUNDS = 8
LEVELS = 24


def _sides(seen: DataFrame, keys: list[str]) -> DataFrame:
    """The least cotangents under which witnesses (rx, ry) of the two sides see each pair; null for a side without any."""
    dot = (F.col("px") - F.col("rx")) * (F.col("qx") - F.col("rx")) + (F.col("py") - F.col("ry")) * (F.col("qy") - F.col("ry"))
    cross = (F.col("px") - F.col("rx")) * (F.col("qy") - F.col("ry")) - (F.col("py") - F.col("ry")) * (F.col("qx") - F.col("rx"))
    cot = F.try_divide(dot, cross)
    return seen.groupBy(*keys).agg(F.min(F.when(cross > 0, cot)).alias("left"), F.min(F.when(cross < 0, -cot)).alias("right"))


def _empty_circle() -> Column:
    """Some circle through the pair holds no witness."""
    return F.col("left").isNull() | F.col("right").isNull() | (F.col("left") + F.col("right") > 1e-12)


def _named(points: DataFrame, node: str, at: str) -> DataFrame:
    return points.select("graph_id", F.col("node_id").alias(node), F.col("x").alias(f"{at}x"), F.col("y").alias(f"{at}y"))


def _whole(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (graph_id, src, dst, px, py, qx, qy) that have an empty circle among all points of their graph."""
    seen = pairs.join(_named(points, "other", "r"), "graph_id").where("other <> src and other <> dst")
    sides = _sides(seen, ["graph_id", "src", "dst"])
    return pairs.join(sides, ["graph_id", "src", "dst"], "left").where(_empty_circle()).select("graph_id", "src", "dst")


def _near(points: DataFrame, others: DataFrame) -> DataFrame:
    """For points (with reach) the others of their graph within reach, by cells of that size: src, px, py, reach, dst, qx, qy."""
    cell = lambda c, r: F.floor(F.col(c) / F.col(r)).cast("bigint")
    around = lambda c: F.explode(F.sequence(cell(c, "reach") - 1, cell(c, "reach") + 1))
    reaches = points.select("graph_id", "reach").distinct()  # one row a graph
    spread = _named(points, "src", "p").join(points.select("graph_id", F.col("node_id").alias("src"), "reach"), ["graph_id", "src"])
    spread = spread.withColumnsRenamed({"px": "x", "py": "y"}).withColumn("cx", around("x")).withColumn("cy", around("y")).withColumnsRenamed({"x": "px", "y": "py"})
    placed = others.join(F.broadcast(reaches), "graph_id").withColumn("cx", cell("x", "reach")).withColumn("cy", cell("y", "reach"))
    placed = placed.select("graph_id", F.col("node_id").alias("dst"), F.col("x").alias("qx"), F.col("y").alias("qy"), "cx", "cy")
    apart = F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy"))
    return spread.join(placed, ["graph_id", "cx", "cy"]).where((F.col("src") != F.col("dst")) & (apart <= F.col("reach"))).drop("cx", "cy")


def _first_reach(points: DataFrame) -> DataFrame:
    """(graph_id, reach): the largest of halved box sides of which no square holds more than ``FIRST`` points, else the smallest."""
    box = points.groupBy("graph_id").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    levels = points.join(F.broadcast(box), "graph_id").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).withColumn("size", F.col("side") / F.pow(F.lit(2.0), F.col("level")))
    held = levels.groupBy("graph_id", "level", "size", F.floor((F.col("x") - F.col("x0")) / F.col("size")).alias("i"), F.floor((F.col("y") - F.col("y0")) / F.col("size")).alias("j")).agg(F.count("*").alias("c"))
    most = held.groupBy("graph_id", "level", "size").agg(F.max("c").alias("c"))
    return most.groupBy("graph_id").agg(F.coalesce(F.max(F.when(F.col("c") <= FIRST, F.col("size"))), F.min("size")).alias("reach"))


def large_edges(points: DataFrame) -> DataFrame:
    """Voronoi neighbours of graphs of many points (graph_id, node_id, x, y).

    For a point and the neighbours within its reach, pairs without an empty circle among these are no
    edges. If all other pairs' circles, at both ends of what their witnesses allow, are no larger than
    half the reach, no point outside can cut the cell: the cell is closed and its pairs are edges. Reach
    doubles for open points, as long as few points lie within. Cells of the border never close: pairs of
    open points are tested on near witnesses, and the few that pass on all points of their graph.
    """
    points = settled(points.select("graph_id", "node_id", "x", "y"))
    reach = settled(_first_reach(points))
    open_, edges, near = settled(points.select("graph_id", "node_id")), None, None
    for _ in range(ROUNDS):
        asking = points.join(open_, ["graph_id", "node_id"], "left_semi").join(F.broadcast(reach), "graph_id")
        found = settled(_near(asking, points))
        crowd = found.groupBy("graph_id", "src").agg(F.count("*").alias("n")).where(F.col("n") <= CROWD).select("graph_id", "src")
        found = settled(found.join(crowd, ["graph_id", "src"], "left_semi"))
        if not found.limit(1).count():
            break
        witness = found.select("graph_id", "src", F.col("dst").alias("other"), F.col("qx").alias("rx"), F.col("qy").alias("ry"))
        sides = _sides(found.join(witness, ["graph_id", "src"]).where("other <> dst"), ["graph_id", "src", "dst"])
        held = settled(found.join(sides, ["graph_id", "src", "dst"], "left").where(_empty_circle()))
        half = F.hypot(F.col("px") - F.col("qx"), F.col("py") - F.col("qy")) / 2
        end = half * F.sqrt(1 + F.pow(F.greatest(F.abs("left"), F.abs("right")), 2))
        fine = F.col("left").isNotNull() & F.col("right").isNotNull() & (end <= F.col("reach") / 2)
        closed = settled(held.groupBy("graph_id", "src").agg(F.bool_and(fine).alias("fine"), F.count("*").alias("k")).where("fine and k > 2").select("graph_id", "src"))
        now = held.join(closed, ["graph_id", "src"], "left_semi").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        edges = settled(now if edges is None else edges.unionByName(now))
        # The widest view of each open point so far; points outside it come last.
        seen = witness.join(closed, ["graph_id", "src"], "left_anti")
        near = settled(seen if near is None else seen.unionByName(near.join(witness.select("graph_id", "src").distinct(), ["graph_id", "src"], "left_anti").join(closed, ["graph_id", "src"], "left_anti")))
        open_ = settled(open_.join(closed.withColumnRenamed("src", "node_id"), ["graph_id", "node_id"], "left_anti"))
        if not open_.limit(1).count():
            break
        reach = settled(reach.withColumn("reach", F.col("reach") * 2))
    left = points.join(open_, ["graph_id", "node_id"], "left_semi")
    pairs = settled(_named(left, "src", "p").join(_named(left, "dst", "q"), "graph_id").where("src < dst"))
    if near is not None:
        sides = _sides(pairs.join(near, ["graph_id", "src"]).where("other <> dst"), ["graph_id", "src", "dst"])
        pairs = settled(pairs.join(sides, ["graph_id", "src", "dst"], "left").where(_empty_circle()).drop("left", "right"))
    last = _whole(pairs, points)
    return last if edges is None else edges.unionByName(last).distinct()


def voronoi_edges(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Neighbours in the Voronoi diagram of each graph's points (x, y); all pairs below four points.

    For a pair p, q every other point r sees it under an angle whose cotangent is dot over cross. The
    pair is an edge iff the least cotangents of the two sides sum to more than 0, or a side has no
    point. Graphs of up to ``small`` points test all pairs on all points, others go by
    :func:`large_edges`. Returns graph_id, src, dst with src < dst.
    """
    size = settled(nodes.groupBy("graph_id").agg(F.count("*").alias("n")))
    few = nodes.join(size.where(F.col("n") <= small).select("graph_id", "n"), "graph_id")
    pairs = _named(few, "src", "p").join(_named(few, "dst", "q"), "graph_id").where("src < dst")
    out = _whole(pairs, few)
    tiny = pairs.join(size.where("n < 4").select("graph_id"), "graph_id", "left_semi").select("graph_id", "src", "dst")
    out = out.join(size.where("n >= 4").select("graph_id"), "graph_id", "left_semi").unionByName(tiny)
    many = size.where(F.col("n") > small).select("graph_id")
    if not many.limit(1).count():
        return out
    return out.unionByName(large_edges(nodes.join(many, "graph_id", "left_semi")))
