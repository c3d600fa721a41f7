"""What graphs lose when nodes are taken out: only paths that a removed node was on are searched again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.operators import networks as N
from stormgrid.operators import small as Z
from stormgrid.operators.centrality import shortest_path_edges
from stormgrid.operators.joins import symmetrize
from stormgrid.sources.shared import dropped, written

_PAIR = ["variant", "graph_id", "s", "t"]


def _without_support(dag: DataFrame, gone: DataFrame) -> DataFrame:
    """(variant, graph_id, s, t): surviving pairs all of whose shortest paths meet a removed node.

    A node keeps its distance from s while one of the nodes before it, on a shortest path from s, is
    left and keeps its own. Round by round the nodes without such support take theirs from others.
    """
    before = N.settled(dag.groupBy("graph_id", "s", F.col("w").alias("t")).agg(F.count("*").alias("ways")))
    out = [gone.select("variant", "graph_id", F.col("node_id").alias(c)) for c in ("s", "t")]

    def alive(df: DataFrame) -> DataFrame:
        for side, c in zip(out, ("s", "t"), strict=True):
            df = df.join(side, ["variant", "graph_id", c], "left_anti")
        return df

    hit = dag.join(gone.withColumnRenamed("node_id", "v"), ["graph_id", "v"]).select("variant", "graph_id", "s", F.col("w").alias("t"))
    support = N.settled(alive(hit).groupBy(*_PAIR).agg(F.count("*").alias("cut")))
    lost = fresh = N.settled(support.join(before, ["graph_id", "s", "t"]).where("cut = ways").select(*_PAIR))
    while fresh.limit(1).count():
        more = dag.join(fresh.withColumnRenamed("t", "v"), ["graph_id", "s", "v"]).select("variant", "graph_id", "s", F.col("w").alias("t"))
        more = more.join(out[1], ["variant", "graph_id", "t"], "left_anti").withColumn("cut", F.lit(1))
        old, support = support, N.settled(support.unionByName(more).groupBy(*_PAIR).agg(F.sum("cut").alias("cut")))
        now = N.settled(support.join(before, ["graph_id", "s", "t"]).where("cut = ways").select(*_PAIR))
        fresh = N.settled(now.join(lost, _PAIR, "left_anti"))
        dropped(old, lost)
        lost = now
    return lost


def _found_again(lost: DataFrame, both: DataFrame, distances: DataFrame, gone: DataFrame) -> DataFrame:
    """(variant, graph_id, s, t, d): new distances of the lost pairs that are still connected.

    First over one edge from a node that keeps its distance, then from lost pair to lost pair.
    """
    step = both.select("graph_id", F.col("src").alias("t"), F.col("dst").alias("u"), "weight")
    beside = lost.join(step, ["graph_id", "t"]).join(gone.withColumnRenamed("node_id", "u"), ["variant", "graph_id", "u"], "left_anti")
    beside = N.settled(beside)
    own = beside.where("u = s").select(*_PAIR, F.col("weight").alias("d"))
    kept = beside.where("u <> s").join(lost.withColumnRenamed("t", "u"), ["variant", "graph_id", "s", "u"], "left_anti")
    known_d = distances.select("graph_id", F.col("src").alias("s"), F.col("dst").alias("u"), F.col("d").alias("d_u"))
    kept = kept.join(known_d, ["graph_id", "s", "u"]).select(*_PAIR, (F.col("d_u") + F.col("weight")).alias("d"))
    known = frontier = N.settled(own.unionByName(kept).groupBy(*_PAIR).agg(F.min("d").alias("d")))
    # From a lost pair (s, u) to its lost neighbours (s, t).
    inner = N.settled(beside.join(lost.withColumnRenamed("t", "u"), ["variant", "graph_id", "s", "u"], "left_semi"))
    was = [known]
    while frontier.limit(1).count():
        wider = frontier.select("variant", "graph_id", "s", F.col("t").alias("u"), "d").join(inner, ["variant", "graph_id", "s", "u"])
        wider = wider.select(*_PAIR, (F.col("d") + F.col("weight")).alias("d"), F.lit(False).alias("old"))
        both_d = known.withColumn("old", F.lit(True)).unionByName(wider)
        best = both_d.groupBy(*_PAIR).agg(F.min("d").alias("d"), F.min(F.when(F.col("old"), F.col("d"))).alias("was"))
        best = N.settled(best.withColumn("fresh", F.col("was").isNull() | (F.col("d") < F.col("was") - 1e-12)).drop("was"))
        dropped(*was)
        was = [best]
        known, frontier = best.drop("fresh"), best.where("fresh").drop("fresh")
    return known


def _small(nodes: DataFrame, edges: DataFrame, weight: str | None, small: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Packed graphs of few nodes, and the ids of the other graphs; None for none, but never for both."""
    packed = N.settled(Z.packed(nodes, edges, weight, small))
    others = N.settled(nodes.select("graph_id").distinct().join(packed.select("graph_id"), "graph_id", "left_anti"))
    few = packed if packed.limit(1).count() else None
    return few, (others if few is None or others.limit(1).count() else None)


def removal_loss(nodes: DataFrame, edges: DataFrame, removed: DataFrame, cases: DataFrame | None = None, weight: str | None = None, small: int = Z.SMALL) -> DataFrame:
    """Loss of efficiency (by hops, or ``weight``) and share of the largest component after each removal.

    removed has graph_id, case_id, node_id. Equal sets of a graph are worked out once, all graphs and
    sets in one job. Graphs of at most ``small`` nodes are searched whole for each set, as small matrices
    in a task. The larger ones are searched whole once; of a set only the pairs all of whose shortest
    paths meet it are searched again (``searched``, ordered pairs), the others keep their distance.
    Component sizes follow from the pairs that stay apart.

    Returns graph_id, case_id, loss, relative (both at least 0), lcc, n_removed, capacity_removed (0
    where nodes has no capacity), searched. cases has graph_id, case_id, all of which get a row: those that remove nothing lose
    0 and keep the whole graph, whose share counts as 1. Without it only cases with a removed node
    have one. Removed ids that the graph does not have are ignored.
    """
    few, many = _small(nodes, edges, weight, small)
    done = None
    if few is not None:
        bits = removed.join(Z.node_bits(few), ["graph_id", "node_id"]).groupBy("graph_id", "case_id").agg(F.bit_or("bit").alias("mask"))
        sets = written(bits, "sets")
        done = sets.join(written(Z.set_losses(few, sets.select("graph_id", "mask").distinct()), "losses"), ["graph_id", "mask"]).drop("mask")
    if many is not None:
        part = lambda d: d if few is None else d.join(many, "graph_id", "left_semi")
        rest = _large_removal_loss(part(nodes), part(edges), part(removed), weight)
        done = rest if done is None else done.unionByName(rest.select(*done.columns))
    if cases is None:
        return done
    every = cases.select("graph_id", "case_id").distinct().join(done, ["graph_id", "case_id"], "left")
    return every.fillna({"loss": 0.0, "relative": 0.0, "lcc": 1.0, "n_removed": 0, "capacity_removed": 0.0, "searched": 0})


def event_loss(nodes: DataFrame, edges: DataFrame, events: DataFrame, weight: str | None = None, small: int = Z.SMALL) -> DataFrame:
    """What every graph loses by every event of its group, as :func:`removal_loss` does, hit or missed.

    nodes has group, lat and lon; events has case_id (unique), group, lat, lon, radius_km and takes the
    nodes of its group in its disk. The rows are graphs times events of their group, by nature; graphs of
    at most ``small`` nodes never have their hits listed.
    """
    few, many = _small(nodes, edges, weight, small)
    done = None if few is None else Z.event_losses(few, events)
    if many is None:
        return done
    rest = nodes if few is None else nodes.join(many, "graph_id", "left_semi")
    hits, cases = event_hits(rest, events)
    rest = removal_loss(rest, edges if few is None else edges.join(many, "graph_id", "left_semi"), hits, cases, weight, 0)
    return rest if done is None else done.unionByName(rest.select(*done.columns))


def event_hits(nodes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, case_id, node_id) of the nodes in the disks of events of their group, and (graph_id, case_id) of all graphs and events of a group."""
    from stormgrid.operators.spatial import within_radius

    centers = events.select("case_id", F.col("group").alias("center_group"), "radius_km", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    near = within_radius(nodes.select("graph_id", "group", "node_id", "lat", "lon"), centers, F.col("radius_km")).where("group = center_group")
    cases = nodes.select("graph_id", "group").distinct().join(events.select("case_id", "group"), "group")
    return near.select("graph_id", "case_id", "node_id"), cases.select("graph_id", "case_id")


def event_timeline_loss(nodes: DataFrame, edges: DataFrame, events: DataFrame, hours: DataFrame, small: int = Z.SMALL) -> DataFrame:
    """Hourly losses of the union of nodes that active events of a graph's group take out, summed over the hours.

    events as for :func:`event_loss`; hours: case_id, sim_id, hour. An event that hits no node of a graph
    counts as active there and loses nothing. Returns sim_id, graph_id, loss, hours, max_simultaneous.
    """
    few, many = _small(nodes, edges, None, small)
    done = None
    if few is not None:
        active = hours.join(events, "case_id").select("sim_id", "hour", "group", "case_id", "lat", "lon", "radius_km")
        unions = written(Z.event_unions(few, active), "unions")
        losses = written(Z.set_losses(few, unions.select("graph_id", "mask").where("mask <> 0").distinct()), "losses")
        sums = unions.join(losses.select("graph_id", "mask", "relative"), ["graph_id", "mask"], "left")
        sums = sums.groupBy("sim_id", "graph_id").agg(F.sum(F.coalesce("relative", F.lit(0.0))).alias("loss"), F.count("*").alias("hours"))
        most = active.groupBy("sim_id", "group", "hour").agg(F.countDistinct("case_id").alias("events")).groupBy("sim_id", "group").agg(F.max("events").alias("max_simultaneous"))
        done = sums.join(few.select("graph_id", "group"), "graph_id").join(most, ["sim_id", "group"]).drop("group")
    if many is None:
        return done
    rest = nodes if few is None else nodes.join(many, "graph_id", "left_semi")
    hits, cases = event_hits(rest, events)
    active = cases.join(hits, ["graph_id", "case_id"], "left").join(hours, "case_id").withColumnRenamed("case_id", "event_id")
    rest = N.timeline_loss(rest, edges if few is None else edges.join(many, "graph_id", "left_semi"), active)
    return rest if done is None else done.unionByName(rest.select(*done.columns))


def _large_removal_loss(nodes: DataFrame, edges: DataFrame, removed: DataFrame, weight: str | None) -> DataFrame:
    """:func:`removal_loss` by joins, for graphs of any size."""
    removed = removed.select("graph_id", "case_id", "node_id").join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    name = F.md5(F.concat_ws(",", F.sort_array(F.collect_set("node_id")).cast("array<string>")))
    sets = N.settled(removed.groupBy("graph_id", "case_id").agg(name.alias("set_id")).withColumn("variant", F.concat_ws("|", "graph_id", "set_id")))
    one = sets.groupBy("graph_id", "variant").agg(F.min("case_id").alias("case_id"))
    gone = N.settled(removed.join(one, ["graph_id", "case_id"]).select("variant", "graph_id", "node_id").distinct())

    both = N.settled(symmetrize(edges.withColumn("weight", F.lit(1.0) if weight is None else F.col(weight).cast("double"))))
    distances = N.settled(N.shortest_paths(edges, weight))
    dag = written(shortest_path_edges(both, distances), "paths")
    lost = _without_support(dag, gone)
    again = _found_again(lost, both, distances, gone)

    capacity = F.sum("capacity") if "capacity" in nodes.columns else F.lit(0.0)
    taken = gone.join(nodes, ["graph_id", "node_id"]).groupBy("variant", "graph_id").agg(F.count("*").alias("n_removed"), capacity.alias("capacity_removed"))
    inverse = distances.select("graph_id", "src", "dst", (1.0 / F.col("d")).alias("e"))
    rows = inverse.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum("e").alias("row"), F.count("*").alias("reach"), F.min("dst").alias("least"))
    rows = N.settled(rows.withColumn("root", F.least("least", "node_id")))
    graphs = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).join(rows.groupBy("graph_id").agg(F.sum("row").alias("total")), "graph_id", "left")
    of_gone = gone.join(rows, ["graph_id", "node_id"]).groupBy("variant").agg(F.sum("row").alias("cut_rows"))
    x, y = (gone.select("variant", "graph_id", F.col("node_id").alias(c)) for c in ("src", "dst"))
    inside = inverse.join(x, ["graph_id", "src"]).join(y, ["variant", "graph_id", "dst"]).groupBy("variant").agg(F.sum("e").alias("cut_twice"))
    old = lost.join(distances.select("graph_id", F.col("src").alias("s"), F.col("dst").alias("t"), "d"), ["graph_id", "s", "t"])
    old = old.groupBy("variant").agg(F.sum(1.0 / F.col("d")).alias("before_lost"), F.count("*").alias("searched"))
    new = again.groupBy("variant").agg(F.sum(1.0 / F.col("d")).alias("after_lost"))

    # A broken component: each of its nodes has pairs that stay apart; the fewest belong to its largest piece.
    apart = lost.join(again.select(*_PAIR), _PAIR, "left_anti").groupBy("variant", "graph_id", F.col("s").alias("node_id")).agg(F.count("*").alias("apart"))
    roots = nodes.select("graph_id", "node_id").join(rows.select("graph_id", "node_id", "root"), ["graph_id", "node_id"], "left")
    roots = N.settled(roots.withColumn("root", F.coalesce("root", "node_id")))
    sizes = roots.groupBy("graph_id", "root").agg(F.count("*").alias("size"))
    cut = gone.join(roots, ["graph_id", "node_id"]).groupBy("variant", "graph_id", "root").agg(F.count("*").alias("cut"))
    broken = apart.join(roots, ["graph_id", "node_id"]).groupBy("variant", "graph_id", "root").agg(F.min("apart").alias("apart"))
    pieces = taken.select("variant", "graph_id").join(sizes, "graph_id")
    pieces = pieces.join(cut, ["variant", "graph_id", "root"], "left").join(broken, ["variant", "graph_id", "root"], "left")
    largest = pieces.groupBy("variant").agg(F.max(F.col("size") - F.coalesce("cut", F.lit(0)) - F.coalesce("apart", F.lit(0))).alias("largest"))

    out = taken.join(graphs, "graph_id")
    for table in (of_gone, inside, old, new, largest):
        out = out.join(table, "variant", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    left = F.col("n") - F.col("n_removed")
    after = zero("total") - 2 * zero("cut_rows") + zero("cut_twice") - zero("before_lost") + zero("after_lost")
    after = F.when(left > 1, after / (left * (left - 1))).otherwise(0.0)
    base = F.when(F.col("n") > 1, zero("total") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    out = out.withColumns({"before": base, "loss": F.greatest(F.lit(0.0), base - after)})
    out = out.select("variant", "loss", zero(F.try_divide("loss", "before")).alias("relative"), (zero("largest") / F.col("n")).alias("lcc"), "n_removed", zero("capacity_removed").alias("capacity_removed"), F.coalesce("searched", F.lit(0)).alias("searched"))
    return sets.join(N.settled(out), "variant").drop("variant", "set_id")


def removal_sets(order: DataFrame, keys: list[str], pcts: list[float], leave_one: bool = True) -> DataFrame:
    """(keys, pct, n, k, node_id): the first max(1, round half even(n * pct)) nodes of each order, at most n - 1 if ``leave_one``.

    order has the keys, node_id and place from 1.
    """
    sizes = order.groupBy(*keys).agg(F.count("*").alias("n"))
    levels = order.join(sizes, keys).withColumn("pct", F.explode(F.array(*map(F.lit, pcts))))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.col("pct")).cast("int"))
    levels = levels.withColumn("k", F.least(k, F.col("n") - 1) if leave_one else k)
    return levels.where("place <= k").select(*keys, "pct", "n", "k", "node_id")


def attack_curve(
    nodes: DataFrame, edges: DataFrame, orders: DataFrame, pcts: list[float], weight: str | None = "weight", leave_one: bool = False
) -> DataFrame:
    """Percent of efficiency lost at each share of nodes removed: graph_id, strategy, pct, loss_pct, std, n_sims.

    orders has graph_id, strategy, replicate, node_id, place. The replicates of a strategy are
    averaged, with their deviation (null for a single one). Without ``leave_one``, a share that takes
    all nodes loses 100.
    """
    keys = ["graph_id", "strategy", "replicate"]
    sets = N.settled(removal_sets(orders, keys, pcts, leave_one).withColumn("case_id", F.concat_ws("|", "strategy", "replicate", "pct")))
    losses = removal_loss(nodes, edges, sets.select("graph_id", "case_id", "node_id"), weight=weight)
    levels = sets.select(*keys, "pct", "n", "k", "case_id").distinct()
    percent = F.when(F.col("k") >= F.col("n"), 100.0).otherwise(100.0 * F.col("relative"))
    found = levels.join(losses, ["graph_id", "case_id"]).withColumn("loss_pct", percent)
    several = F.count("*") > 1
    return found.groupBy("graph_id", "strategy", "pct").agg(F.avg("loss_pct").alias("loss_pct"), F.when(several, F.stddev_pop("loss_pct")).alias("std"), F.count("*").alias("n_sims"))
