"""Networks as node and edge tables keyed by graph: iterative DataFrame jobs over all graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators.filters import by
from stormgrid.operators.joins import symmetrize
from stormgrid.sources.shared import dropped, written


def settled(df: DataFrame) -> DataFrame:
    """Write a step of an iteration in the folder of spark.checkpoint.dir and read it back."""
    return written(df, "step")


def independent_set(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Order-first maximal independent set: what a greedy pass in the order of ``ord`` keeps.

    conflicts has pairs (a, b) of ords with a < b. Each round keeps every undecided item without an
    undecided earlier neighbour and drops the neighbours of the kept. Returns ord, kept.
    """
    state = settled(items.select("ord").withColumn("kept", F.lit(None).cast("boolean")))
    conflicts = settled(conflicts.select("a", "b"))
    while state.where("kept is null").limit(1).count():
        open_ = state.where("kept is null").select("ord")
        live = conflicts.join(open_.withColumnRenamed("ord", "a"), "a").join(open_.withColumnRenamed("ord", "b"), "b")
        fresh = open_.join(live.select(F.col("b").alias("ord")), "ord", "left_anti")
        gone = live.join(fresh.withColumnRenamed("ord", "a"), "a").select(F.col("b").alias("ord")).distinct()
        decided = fresh.withColumn("now", F.lit(True)).unionAll(gone.withColumn("now", F.lit(False)))
        state = settled(state.join(decided, "ord", "left").select("ord", F.coalesce("kept", "now").alias("kept")))
    return state


def merge_units(sizes: DataFrame, neighbours: DataFrame, plan: DataFrame, least: int = 50) -> DataFrame:
    """Units (unit, state) in which graphs of few nodes are merged.

    The planned units stand. Of the other states (state, n) those with ``least`` nodes are alone. A
    smaller one, in the order of names, joins its smallest neighbour outside the plan (the smaller name
    of equal ones, unknown sizes last) if neither has a unit yet; else it is alone.
    """
    open_ = sizes.join(plan, "state", "left_anti")
    near = neighbours.select("state", F.col("neighbour").alias("partner")).where("state <> partner")
    near = near.join(plan.select(F.col("state").alias("partner")), "partner", "left_anti")
    near = near.join(sizes.select(F.col("state").alias("partner"), F.col("n").alias("partner_n")), "partner", "left")
    order = F.struct(F.col("partner_n").isNull().alias("unknown"), "partner_n", "partner")
    best = near.groupBy("state").agg(F.min(order).alias("best")).select("state", "best.*")
    # A known neighbour with a smaller name has had its turn before.
    wish = settled(open_.where(F.col("n") < least).join(best, "state").where("unknown or partner > state").select("state", "partner"))
    x, y = (wish.select(F.col("state").alias(c), F.col("partner").alias(f"partner_{c}")) for c in "ab")
    same = x.join(y, F.col("partner_a") == F.col("partner_b")).where("a < b").select("a", "b")
    taken = x.join(y, F.col("partner_a") == F.col("b")).select("a", "b")
    kept = independent_set(wish.select(F.col("state").alias("ord")), same.unionAll(taken)).where("kept")
    pairs = wish.join(kept, wish["state"] == kept["ord"])
    merged = pairs.select(F.concat_ws("_", "state", "partner").alias("unit"), F.explode(F.array("state", "partner")).alias("state"))
    alone = open_.join(merged, "state", "left_anti").select(F.col("state").alias("unit"), "state")
    return plan.select("unit", "state").unionAll(merged).unionAll(alone)


def cluster_radius(points: DataFrame, radius_km: float) -> DataFrame:
    """Greedy clusters of fixed radius in row order, inside each state.

    points has ord, state, lat, lon, n_l1, n_l2, n_dc. A point belongs to its earliest kept
    neighbour; a cluster's place is the mean of its members.
    """
    from stormgrid.operators.spatial import within_radius

    centers = points.select(F.col("ord").alias("a"), F.col("state").alias("state_a"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    pairs = within_radius(points, centers, F.lit(radius_km)).where("state = state_a and a < ord").select("a", F.col("ord").alias("b"))
    pairs = settled(pairs)
    kept = independent_set(points, pairs)
    heads = kept.where("kept").select(F.col("ord").alias("a"))
    owner = pairs.join(heads, "a").groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("owner"))
    own = kept.join(owner, "ord", "left").select("ord", F.when(F.col("kept"), F.col("ord")).otherwise(F.col("owner")).alias("owner"))
    cap = C.capacity(F.col("n_l1"), F.col("n_l2"), F.col("n_dc"))
    return points.join(own, "ord").groupBy("state", "owner").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum(cap).alias("capacity"), F.count("*").alias("n_stations")
    )


def edge_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distance of each edge, and over the largest distance of any pair of the graph."""
    from stormgrid.operators.filters import edge_ends

    from stormgrid.operators.sites import widest

    km = C.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    # Chords of the unit ball grow with the distances on it.
    lat, lon = F.radians("lat"), F.radians("lon")
    ball = nodes.select("graph_id", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    most = widest(ball, ["x", "y", "z"]).select("graph_id", (2.0 * C.EARTH_KM * F.asin(F.least(F.lit(1.0), F.col("widest") / 2))).alias("d_max"))
    out = edge_ends(edges.select("graph_id", "src", "dst"), nodes).withColumn("km", km).join(most, "graph_id")
    return out.select("graph_id", "src", "dst", "km", F.try_divide("km", "d_max").alias("weight"))


def shortest_paths(edges: DataFrame, weight: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Distances (graph_id, src, dst, d) of all connected ordered pairs of different nodes.

    Min-plus relaxation: each round extends only the pairs that improved in the last one, until none
    does. Weights must not be negative.
    """
    both = symmetrize(edges.withColumn("weight", F.lit(1.0) if weight is None else F.col(weight))).select("graph_id", "src", "dst", "weight")
    both = settled(both)
    step = both.select("graph_id", F.col("src").alias("via"), F.col("dst").alias("to"), "weight")
    start = both if sources is None else both.join(sources, ["graph_id", "src"], "left_semi")
    known = frontier = settled(start.select("graph_id", "src", "dst", F.col("weight").alias("d")))
    best_was = [known]  # the step before, which goes once the next is written
    while True:
        wider = frontier.join(step, (frontier["graph_id"] == step["graph_id"]) & (frontier["dst"] == step["via"]))
        wider = wider.where("src <> to").select(frontier["graph_id"], "src", F.col("to").alias("dst"), (F.col("d") + F.col("weight")).alias("d"))
        both_d = known.withColumn("old", F.lit(True)).unionAll(wider.withColumn("old", F.lit(False)))
        best = both_d.groupBy("graph_id", "src", "dst").agg(F.min("d").alias("d"), F.min(F.when(F.col("old"), F.col("d"))).alias("was"))
        best, last = settled(best.withColumn("fresh", F.col("was").isNull() | (F.col("d") < F.col("was") - 1e-12)).drop("was")), best_was
        dropped(*last)
        best_was = [best]
        known, frontier = best.drop("fresh"), best.where("fresh").drop("fresh")
        if not frontier.limit(1).count():
            break
    return known


def global_efficiency(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean of 1/d over the ordered pairs of each graph; unreachable pairs count 0."""
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    near = shortest_paths(edges, weight).where("d > 1e-12").groupBy("graph_id").agg(F.sum(1.0 / F.col("d")).alias("s"))
    pairs = F.col("n") * (F.col("n") - 1)
    value = F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / pairs).otherwise(0.0)
    return size.join(near, "graph_id", "left").select("graph_id", "n", value.alias("efficiency"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, root): the smallest node of each node's component, by label propagation."""
    both = settled(symmetrize(edges.withColumn("weight", F.lit(1.0))).select("graph_id", "src", "dst"))
    labels = settled(nodes.select("graph_id", "node_id", F.col("node_id").alias("root")))
    labels_was = [labels]
    while True:
        near = both.join(labels.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.min("root").alias("near"))
        step = labels.join(near, ["graph_id", "node_id"], "left").withColumn("least", F.least("root", "near"))
        # A root may itself have a smaller root by now: jump there.
        jump = labels.select("graph_id", F.col("node_id").alias("least"), F.col("root").alias("further"))
        step = step.join(jump, ["graph_id", "least"]).select("graph_id", "node_id", F.least("least", "further").alias("new"), "root")
        last, step = labels_was, settled(step)
        if not step.where("new < root").limit(1).count():
            return labels
        dropped(*last)
        labels_was = [step]
        labels = step.select("graph_id", "node_id", F.col("new").alias("root"))


def largest_share(nodes: DataFrame, edges: DataFrame, total: Column | None = None) -> DataFrame:
    parts = components(nodes, edges).groupBy("graph_id", "root").agg(F.count("*").alias("size"))
    out = parts.groupBy("graph_id").agg(F.count("*").alias("n_components"), F.max("size").alias("largest"), F.sum("size").alias("n"))
    return out.withColumn("lcc", F.col("largest") / (F.col("n") if total is None else total))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    counts = ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    out = nodes.select("graph_id", "node_id").join(counts, ["graph_id", "node_id"], "left")
    return out.withColumn("degree", F.coalesce("degree", F.lit(0)))


def closeness(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    sums = shortest_paths(edges, weight).groupBy("graph_id", F.col("src").alias("node_id")).agg(F.sum("d").alias("s"), F.count("*").alias("reached"))
    out = nodes.select("graph_id", "node_id").join(size, "graph_id").join(sums, ["graph_id", "node_id"], "left")
    value = F.when(F.col("s") > 0, F.col("reached") / F.col("s") * F.col("reached") / (F.col("n") - 1)).otherwise(0.0)
    return out.select("graph_id", "node_id", value.alias("closeness"))


def attack_order(nodes: DataFrame, score: Column, ascending: bool = False) -> DataFrame:
    order = score.asc() if ascending else score.desc()
    return nodes.withColumn("place", F.row_number().over(by("graph_id", order, "node_id")))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Closed triangles over pairs of neighbours, for each node."""
    both = symmetrize(edges.withColumn("weight", F.lit(1.0))).select("graph_id", "src", "dst")
    a, b = both.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("u")), both.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("w"))
    closed = a.join(b, ["graph_id", "node_id"]).where("u < w").join(both.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("w")), ["graph_id", "u", "w"])
    counts = closed.groupBy("graph_id", "node_id").agg(F.count("*").alias("t"))
    out = degree(nodes, edges).join(counts, ["graph_id", "node_id"], "left")
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return out.select("graph_id", "node_id", F.when(pairs > 0, F.coalesce("t", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"))


def diameter(edges: DataFrame) -> DataFrame:
    return shortest_paths(edges).groupBy("graph_id").agg(F.max("d").alias("diameter"), F.avg("d").alias("avg_path"))


def union_timeline(events: DataFrame) -> DataFrame:
    """For each simulation, graph and hour the nodes out by any active event; events has hour and node_id rows."""
    return events.select("sim_id", "graph_id", "hour", "node_id").distinct()


def timeline_loss(nodes: DataFrame, edges: DataFrame, active: DataFrame) -> DataFrame:
    """Hourly losses of the union of nodes that active events take out, summed over the hours.

    active has sim_id, hour, event_id, graph_id, node_id: a row for each node an event takes out in
    an hour, and one with a null node for an event that takes out none, which counts as active and
    loses nothing. Equal unions of a graph are measured once. hours are those with an active event.
    """
    from stormgrid.operators.removal import removal_loss

    union = settled(union_timeline(active))
    cases = union.withColumn("case_id", F.concat_ws("|", "sim_id", "hour"))
    hours = cases.select("sim_id", "graph_id", "hour", "case_id").distinct()
    losses = removal_loss(nodes, edges, cases.where("node_id is not null").select("graph_id", "case_id", "node_id"), hours)
    most = active.groupBy("sim_id", "graph_id", "hour").agg(F.countDistinct("event_id").alias("events"))
    most = most.groupBy("sim_id", "graph_id").agg(F.max("events").alias("max_simultaneous"))
    sums = hours.join(losses, ["graph_id", "case_id"]).groupBy("sim_id", "graph_id").agg(F.sum("relative").alias("loss"), F.count("*").alias("hours"))
    return sums.join(most, ["sim_id", "graph_id"])


def expand_sites(sites: DataFrame, candidates: DataFrame, pct: float, spacing_km: float) -> DataFrame:
    """Add ceil(pct * n) sites to each state, at least ``spacing_km`` from all others.

    sites: state, lat, lon. candidates: ord, state, lat, lon in order of preference. Those near an
    existing site go; of the rest the greedy order-first choice stands, cut at each state's target.
    """
    from stormgrid.operators.spatial import within_radius

    centers = sites.select(F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    near = within_radius(candidates.select("ord", "lat", "lon"), centers, F.lit(spacing_km)).select("ord").distinct()
    free = settled(candidates.join(near, "ord", "left_anti"))
    others = free.select(F.col("ord").alias("a"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    pairs = within_radius(free.select("ord", "lat", "lon"), others, F.lit(spacing_km)).where("a < ord")
    kept = independent_set(free, pairs.select("a", F.col("ord").alias("b"))).where("kept").select("ord")
    target = sites.groupBy("state").agg(F.ceil(F.count("*") * pct).alias("target"))
    ranked = free.join(kept, "ord").join(target, "state").withColumn("k", F.row_number().over(by("state", "ord")))
    added = ranked.where("k <= target").select("state", "lat", "lon", F.lit(True).alias("is_added"))
    return sites.select("state", "lat", "lon", F.lit(False).alias("is_added")).unionByName(added)


def tract_classes(tracts: DataFrame, metro: DataFrame, micro: DataFrame, cut: float = 0.35) -> DataFrame:
    """urban, suburban or rural: tracts that meet a metro area, by area; then those that meet a micro area.

    All have id and ring; tracts have area_km2. Polygons meet if they share a point, not only their boxes.
    """
    from stormgrid.operators.joins import polygons_meet

    own = tracts.select("id", "ring")
    in_metro = polygons_meet(own, metro).select("id").distinct().withColumn("metro", F.lit(True))
    in_micro = polygons_meet(own, micro).select("id").distinct().withColumn("micro", F.lit(True))
    joined = tracts.join(in_metro, "id", "left").join(in_micro, "id", "left")
    edge = joined.where("metro").agg(F.percentile("area_km2", F.lit(cut)).alias("edge"))
    label = F.when(F.col("metro") & (F.col("area_km2") <= F.col("edge")), "urban").when(F.col("metro") | F.col("micro"), "suburban").otherwise("rural")
    return joined.crossJoin(F.broadcast(edge)).withColumn("class", label).drop("edge", "metro", "micro")  # one row


def tract_population(tracts: DataFrame, population: DataFrame) -> DataFrame:
    out = tracts.where("south is not null").join(population, "tract", "left")
    return out.withColumn("population", F.coalesce("population", F.lit(0.0))).withColumn("fips", F.substring("tract", 1, 5))
