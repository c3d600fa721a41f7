"""New sites for networks, and the weights of rebuilt edges, in the plane of the web map (km)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.functions.columns import hash_u
from stormgrid.operators.delaunay import voronoi_edges
from stormgrid.operators.draws import point_in_ring, weighted_pick
from stormgrid.operators.filters import by
from stormgrid.operators.networks import independent_set, settled
from stormgrid.operators.spatial import points_along
from stormgrid.sources.shared import written

SPACING_KM = 10.0
CORRIDOR_KM = 80.4672  # 50 miles


def planar(df: DataFrame) -> DataFrame:
    """Add x and y in km of the web map's projection."""
    x, y = C.mercator_m(F.col("lat"), F.col("lon"))
    return df.withColumns({"x": x / 1000.0, "y": y / 1000.0})


def plane_pairs(a: DataFrame, b: DataFrame, reach: float, group: str) -> DataFrame:
    """(a, b, km) of the points (id, group, x, y) of one group that are at most ``reach`` apart, by cells of that size."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    left = a.select(F.col("id").alias("a"), group, F.col("x").alias("ax"), F.col("y").alias("ay")).withColumn("cx", cell("ax")).withColumn("cy", cell("ay"))
    right = b.select(F.col("id").alias("b"), group, "x", "y").withColumn("cx", around("x")).withColumn("cy", around("y"))
    km = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    return left.join(right, [group, "cx", "cy"]).withColumn("km", km).where(F.col("km") <= reach).select("a", "b", "km")


def plane_gaps(points: DataFrame, sites: DataFrame, group: str, reach: float) -> DataFrame:
    """(id, gap): km from each point to the nearest site of its group; null where the group has none.

    Reach and cells grow fourfold until every point of a group with sites has found one.
    """
    left = settled(points.select("id", group, "x", "y").join(sites.select(group).distinct(), group, "left_semi"))
    found = None
    while left.limit(1).count():
        near = written(plane_pairs(left, sites, reach, group).groupBy(F.col("a").alias("id")).agg(F.min("km").alias("gap")), "gaps")
        found = near if found is None else found.unionAll(near)
        left = settled(left.join(near.select("id"), "id", "left_anti"))
        reach *= 4
    lone = points.select("id")
    return lone.withColumn("gap", F.lit(None).cast("double")) if found is None else lone.join(found, "id", "left")


def greedy_sites(candidates: DataFrame, sites: DataFrame, quota: DataFrame, spacing_km: float) -> DataFrame:
    """Candidates (id, state, x, y, ord) that a pass in the order of ``ord`` takes: at least ``spacing_km`` from sites and from each other, up to each state's quota."""
    # A site in the same cell, whose diagonal is shorter than the spacing, is near enough; only what is left is measured.
    size = spacing_km / 1.5
    cells = lambda d: d.withColumn("cx", F.floor(F.col("x") / size).cast("bigint")).withColumn("cy", F.floor(F.col("y") / size).cast("bigint"))
    held = cells(sites).select("state", "cx", "cy").distinct()
    candidates = settled(cells(candidates).join(held, ["state", "cx", "cy"], "left_anti").select(candidates.columns))
    near = plane_pairs(candidates, sites, spacing_km, "state").where(F.col("km") < spacing_km).select(F.col("a").alias("id")).distinct()
    free = settled(candidates.join(near, "id", "left_anti"))
    names = free.select("id", "ord")
    close = plane_pairs(free, free, spacing_km, "state").where((F.col("a") != F.col("b")) & (F.col("km") < spacing_km))
    pairs = close.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    kept = free.join(independent_set(free, pairs).where("kept").select("ord"), "ord").join(quota, "state")
    return kept.withColumn("place", F.row_number().over(by("state", "ord"))).where("place <= quota").drop("place", "quota", "ord")


def corridor_points(lines: DataFrame, every_km: float = CORRIDOR_KM) -> DataFrame:
    """(id, state, lat, lon): a point every ``every_km`` along each line (state, line_id, seq, lat, lon)."""
    named = lines.withColumn("line_id", F.concat_ws("|", "state", "line_id"))
    points = points_along(named, every_km).join(named.select("line_id", "state").distinct(), "line_id")
    return points.select(F.format_string("%s|%08d", "line_id", "k").alias("id"), "state", "lat", "lon")


def drawn_points(areas: DataFrame, counts: DataFrame, weight: str, seed: str) -> DataFrame:
    """(id, state, ord, lat, lon): n uniform points for each state, in areas (state, area_id, ring) drawn by ``weight``.

    By population for a population rule, by size for a uniform one. ord is the order of the draws; of
    counts with ``had`` the first ``had`` draws are left out.
    """
    had = F.col("had").cast("int") if "had" in counts.columns else F.lit(0)
    asks = counts.where(F.col("n") > had).select("state", F.explode(F.sequence(had + 1, F.col("n").cast("int"))).alias("ord"))
    picked = weighted_pick(asks, areas.select("state", "area_id", weight), "state", weight, "area_id", f"{seed}-area", ["state", "ord"])
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    boxes = settled(areas.select("area_id", "ring", F.array_min(lats).alias("south"), F.array_max(lats).alias("north"), F.array_min(lons).alias("west"), F.array_max(lons).alias("east")))
    spots = picked.join(boxes, "area_id").withColumn("_key", F.concat_ws("|", "state", "ord"))
    # Most rings hold the first draw of their box, which needs no search.
    place = lambda axis, low, high: F.col(low) + hash_u(F.lit(f"{seed}-{axis}"), F.col("_key"), F.lit(1)) * (F.col(high) - F.col(low))
    spots = spots.withColumns({"_lat": place("lat", "south", "north"), "_lon": place("lon", "west", "east")})
    once = F.when(C.in_ring("_lat", "_lon", "ring"), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")))
    spots = settled(spots.withColumn("_spot", F.coalesce(once, point_in_ring("ring", seed, "_key"))).select("state", "ord", "_spot"))
    return spots.select(F.format_string("%s|%08d", "state", "ord").alias("id"), "state", "ord", F.col("_spot.lat").alias("lat"), F.col("_spot.lon").alias("lon"))


def expand_corridors(sites: DataFrame, lines: DataFrame, fill: DataFrame, pct: float, spacing_km: float = SPACING_KM, every_km: float = CORRIDOR_KM) -> DataFrame:
    """Sites (id, state, lat, lon, capacity) and ceil(pct * n) new ones for each state, at least one if pct > 0.

    First points along corridors, the largest gap to the old sites first (equal gaps by id); then, for
    what is missing, ``fill`` (id, state, ord, lat, lon) in its order, on the network that has grown.
    All keep ``spacing_km`` from each other and from old sites. New sites have capacity 1, is_cf_added
    and the rule that gave them (corridor or fill); ids of new sites must differ from old ones.
    """
    old = settled(planar(sites.select("id", "state", "lat", "lon", "capacity")))
    target = old.groupBy("state").agg(F.ceil(F.count("*") * pct).cast("int").alias("quota")).where("quota > 0")
    corridor = settled(planar(corridor_points(lines, every_km)))
    gaps = plane_gaps(corridor, old, "state", spacing_km)
    ranked = corridor.join(gaps, "id").withColumn("ord", F.struct((-F.coalesce("gap", F.lit(1e9))).alias("gap"), "id")).drop("gap")
    first = settled(greedy_sites(ranked, old, target, spacing_km).withColumn("rule", F.lit("corridor")))
    have = first.groupBy("state").agg(F.count("*").alias("have"))
    short = target.join(have, "state", "left").select("state", (F.col("quota") - F.coalesce("have", F.lit(0))).alias("quota")).where("quota > 0")
    grown = settled(old.select("id", "state", "x", "y").unionByName(first.select("id", "state", "x", "y")))
    spare = settled(planar(fill)).join(short.select("state"), "state", "left_semi").withColumn("ord", F.struct("ord", "id"))
    second = greedy_sites(spare, grown, short, spacing_km).withColumn("rule", F.lit("fill"))
    added = first.select("id", "state", "lat", "lon", "rule").unionByName(second.select("id", "state", "lat", "lon", "rule"))
    added = added.withColumns({"capacity": F.lit(1.0), "is_cf_added": F.lit(True)})
    kept = old.select("id", "state", "lat", "lon", "capacity", F.lit(None).cast("string").alias("rule"), F.lit(False).alias("is_cf_added"))
    return kept.unionByName(added)


def expand_drawn(sites: DataFrame, areas: DataFrame, weight: str, pct: float, seed: str, rule: str, spacing_km: float = SPACING_KM, tries: int = 200) -> DataFrame:
    """Sites (id, state, lat, lon, capacity) and ceil(pct * n) new ones for each state at random places of its areas.

    areas: state, area_id, ring and ``weight``, its population or its size. Points are drawn in order and
    taken if they keep ``spacing_km`` from old and taken sites; a state that is short draws on, each lot
    three times as many as all before, up to ``tries`` draws for each site it asks for. What is taken
    depends neither on lots nor on other states. New sites have capacity 1, is_cf_added and ``rule``.
    """
    old = settled(planar(sites.select("id", "state", "lat", "lon", "capacity")))
    short = settled(old.groupBy("state").agg(F.ceil(F.count("*") * pct).cast("int").alias("quota")).where("quota > 0").withColumn("wanted", F.col("quota")))
    grown = old.select("id", "state", "x", "y")
    added = sites.select("id", "state", "lat", "lon").limit(0)
    seen, per = 0, min(4, tries)
    while seen < tries and short.limit(1).count():
        asks = short.select("state", (F.col("wanted") * per).alias("n"), (F.col("wanted") * seen).alias("had"))
        lot = drawn_points(areas, asks, weight, seed)
        lot = settled(planar(lot)).withColumn("ord", F.struct("ord", "id"))
        fresh = settled(greedy_sites(lot, grown, short.select("state", "quota"), spacing_km).select("id", "state", "lat", "lon", "x", "y"))
        added, grown = settled(added.unionByName(fresh.drop("x", "y"))), settled(grown.unionByName(fresh.select("id", "state", "x", "y")))
        have = fresh.groupBy("state").agg(F.count("*").alias("have"))
        left = short.join(have, "state", "left").withColumn("quota", F.col("quota") - F.coalesce("have", F.lit(0)))
        short = settled(left.where("quota > 0").drop("have"))
        seen, per = per, min(per * 4, tries)
    added = added.withColumns({"capacity": F.lit(1.0), "is_cf_added": F.lit(True), "rule": F.lit(rule)})
    kept = old.select("id", "state", "lat", "lon", "capacity", F.lit(None).cast("string").alias("rule"), F.lit(False).alias("is_cf_added"))
    return kept.unionByName(added)


def tag_within(sites: DataFrame, pct: float, seed: str) -> DataFrame:
    """Sites (id, state, n_stations) of which ceil(pct * n) of each state, at least one if pct > 0, are densified in place.

    Which ones, a hash of the id tells. Those have densify_mode within_diagnostic and one station more
    (a null count is one station); no site and no edge comes or goes.
    """
    place = F.row_number().over(by("state", hash_u(F.lit(seed), F.col("id")), "id"))
    n = F.count("*").over(Window.partitionBy("state"))
    chosen = place <= (F.greatest(F.lit(1), F.ceil(n * F.lit(pct))) if pct > 0 else F.lit(0))
    out = sites.withColumn("_chosen", chosen)
    more = F.when(F.col("_chosen"), F.coalesce("n_stations", F.lit(1)) + 1).otherwise(F.col("n_stations"))
    return out.withColumns({"densify_mode": F.when(F.col("_chosen"), "within_diagnostic"), "n_stations": more}).drop("_chosen")


def widest(points: DataFrame, coordinates: list[str], group: str = "graph_id") -> DataFrame:
    """(group, widest): the largest distance between two points of each group, 0 for one point.

    The extremes of some directions, mergeable aggregates, give a lower bound. A point can be an end of
    the widest pair only if the farthest corner of the group's box is at least that far; only such
    points are paired.
    """
    d = len(coordinates)
    axes = [v for v in product((-1, 0, 1), repeat=d) if v > (0,) * d]
    spot = F.struct(*coordinates)
    along = [sum((F.col(c) * s for c, s in zip(coordinates, v, strict=True) if s), F.lit(0.0)) for v in axes]
    ends = [f(spot, a).alias(f"e{k}{n}") for k, a in enumerate(along) for n, f in (("a", F.max_by), ("b", F.min_by))]
    box = [f(c).alias(f"{n}_{c}") for c in coordinates for n, f in (("lo", F.min), ("hi", F.max))]
    apart = lambda p, q: F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in coordinates), F.lit(0.0)))
    bounds = points.groupBy(group).agg(*box, *ends)
    least = F.greatest(*(apart(F.col(f"e{k}a"), F.col(f"e{k}b")) for k in range(len(axes))))
    bounds = bounds.select(group, least.alias("least"), *(f"{n}_{c}" for c in coordinates for n in ("lo", "hi")))
    corner = sum((F.pow(F.greatest(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(c)), 2) for c in coordinates), F.lit(0.0))
    outer = settled(points.join(bounds, group).where(F.sqrt(corner) >= F.col("least") * (1 - 1e-12)).select(group, spot.alias("p")).distinct())
    pairs = outer.join(outer.withColumnRenamed("p", "q"), group).where("p <= q")
    return pairs.groupBy(group).agg(F.max(apart(F.col("p"), F.col("q"))).alias("widest"))


def edge_weights_planar(edges: DataFrame, nodes: DataFrame, kind: str = "distance") -> DataFrame:
    """Weights of edges from distances in the plane: over the graph's largest distance, or that over the ends' capacity.

    ``capacity`` divides the share, plus 1e-6, by the geometric mean of the ends' capacities over the
    graph's largest; capacities that are not positive count as 1 there. nodes: graph_id, node_id, lat,
    lon, capacity. Returns graph_id, src, dst, km, weight.
    """
    if kind not in ("distance", "capacity"):
        raise ValueError(f"no kind of weight {kind}")
    placed = settled(planar(nodes.select("graph_id", "node_id", "lat", "lon", "capacity")))
    most = widest(placed, ["x", "y"]).join(placed.groupBy("graph_id").agg(F.max("capacity").alias("top")), "graph_id")
    a = placed.select("graph_id", F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("capacity").alias("ca"))
    b = placed.select("graph_id", F.col("node_id").alias("dst"), "x", "y", F.col("capacity").alias("cb"))
    out = edges.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).join(most, "graph_id")
    km = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    share = km / F.when(F.col("widest") > 0, F.col("widest")).otherwise(1.0)

    def size(c: str) -> Column:
        return F.when(F.col(c) > 0, F.col(c) / F.col("top")).otherwise(1.0)

    weight = share if kind == "distance" else (share + 1e-6) / F.sqrt(size("ca") * size("cb"))
    return out.select("graph_id", "src", "dst", km.alias("km"), weight.alias("weight"))


def rebuilt(sites: DataFrame) -> DataFrame:
    """Edges of the states' networks of sites, old and new: neighbours in the Voronoi diagram, with km and weight."""
    nodes = settled(planar(sites.select(F.col("state").alias("graph_id"), F.col("id").alias("node_id"), "lat", "lon", "capacity")))
    return edge_weights_planar(voronoi_edges(nodes), nodes)
