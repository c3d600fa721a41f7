"""Range joins on the globe: cells first, exact distances after."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.sources.shared import written

CELL_DEG = 0.5
KM_PER_DEG = C.EARTH_KM * math.pi / 180


def _cell(c: Column, size: float = CELL_DEG) -> Column:
    return F.floor(c / size).cast("int")


def within_radius(points: DataFrame, centers: DataFrame, radius: Column, cell: float = CELL_DEG) -> DataFrame:
    """Points (lat, lon) within ``radius`` km of centers (clat, clon), with km.

    Each center visits the cells (``cell`` degrees, a divisor of 360) that its disk can touch, wider in
    longitude away from the equator; the equi-join on cells is filtered by the exact distance. Cells
    of longitude wrap around the globe.
    """
    dlat = radius / KM_PER_DEG
    dlon = F.least(F.lit(180.0), dlat / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs(F.col("clat")) + dlat)))))
    y = F.explode(F.sequence(_cell(F.greatest(F.lit(-90.0), F.col("clat") - dlat), cell), _cell(F.least(F.lit(90.0), F.col("clat") + dlat), cell)))
    wide = F.sequence(_cell(F.col("clon") - dlon, cell), _cell(F.col("clon") + dlon, cell))
    around = round(360 / cell)
    x = F.explode(F.array_distinct(F.transform(wide, lambda c: F.pmod(c, F.lit(around)))))
    spread = centers.withColumn("cell_y", y).withColumn("cell_x", x)
    placed = points.withColumn("cell_y", _cell(F.col("lat"), cell)).withColumn("cell_x", F.pmod(_cell(F.col("lon"), cell), F.lit(around)))
    km = C.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    joined = placed.join(spread, ["cell_y", "cell_x"]).withColumn("km", km)
    return joined.where(F.col("km") <= radius).drop("cell_y", "cell_x")


#: Rings of the search for the nearest point: radius in km and cells in degrees. The last covers the globe.
RINGS = [(0.4, 1 / 64), (1.6, 1 / 32), (6.4, 1 / 8), (25.0, 0.5), (100.0, 1.0), (400.0, 4.0), (1600.0, 15.0), (6400.0, 60.0), (20100.0, 360.0)]
#: Spots of targets that are simply all looked at; targets from which on wide rings look at small cells first, and how small.
FEW, MANY, FINE = 64, 20_000, 16


def _pick(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("center").agg(F.min(F.struct("km", "id")).alias("best"))


def _own(pairs: DataFrame) -> DataFrame:
    return pairs.where("id <> center" if "center_group" not in pairs.columns else "id <> center and target_group <=> center_group")


def _fine_pairs(given: DataFrame, left: DataFrame, radius: float, cell: float) -> DataFrame:
    """Pairs within radius that may be the nearest of their center, by one target of each small cell.

    A cell whose target is farther than the least distance of another by more than both cells' widths
    holds no nearest target.
    """
    size = cell / FINE
    wide = 1.5 * size * KM_PER_DEG
    group = [c for c in ("target_group",) if c in given.columns]
    placed = given.withColumn("fy", _cell(F.col("lat"), size)).withColumn("fx", _cell(F.col("lon"), size))
    cells = written(placed.groupBy("fy", "fx", *group).agg(F.min(F.struct("lat", "lon", "id")).alias("one"), F.count("*").alias("held")).select("fy", "fx", *group, "one.*", "held"), "nearest")
    seen = within_radius(cells, left, F.lit(radius + wide), cell)
    seen = seen.where("target_group <=> center_group") if group else seen
    seen = written(seen.select("center", "clat", "clon", *(["center_group"] if group else []), "fy", "fx", "km", "id", "held"), "nearest")
    bound = seen.where("held > 1 or id <> center").groupBy("center").agg((F.min("km") + wide).alias("bound"))
    open_ = seen.join(bound, "center", "left").where(F.col("km") - wide <= F.coalesce("bound", F.lit(radius)))
    pairs = open_.drop("km", "id", "held", "bound").join(placed, ["fy", "fx"])
    km = C.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return pairs.withColumn("km", km).where(F.col("km") <= radius)


def _search(points: DataFrame, targets: DataFrame, key: str, target_key: str, group: str | None, most: float | None) -> DataFrame:
    """(key, best) of the points that have a target, within ``most`` km if given."""
    asked = points.select(F.col(key).alias("center"), *([F.col(group).alias("center_group")] if group else []), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    asked = asked.where("clat is not null and clon is not null")
    spot = ["lat", "lon", *(["target_group"] if group else [])]
    given = targets.where("lat is not null and lon is not null").select(F.col(target_key).alias("id"), *([F.col(group).alias("target_group")] if group else []), "lat", "lon")
    # A point rules out one id at most, so of targets in one place the two smallest ids are enough.
    given = written(given.withColumn("_k", F.row_number().over(Window.partitionBy(*spot).orderBy("id"))).where("_k <= 2").drop("_k"), "nearest")
    # Points that are no target themselves, in one place, have the same nearest target.
    spot = ["clat", "clon", *(["center_group"] if group else [])]
    lone = asked.join(given.select(F.col("id").alias("center")).distinct(), "center", "left_anti")
    asked = asked.join(lone.select("center"), "center", "left_anti").withColumn("member", F.col("center")).unionByName(lone.withColumn("member", F.col("center")).withColumn("center", F.min("center").over(Window.partitionBy(*spot))))
    asked = written(asked, "nearest")
    left = asked.select("center", *spot).distinct()
    n = given.count()
    if n <= FEW:
        km = C.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
        pairs = _own(left.crossJoin(F.broadcast(given))).withColumn("km", km)  # a fixed number of rows
        found = _pick(pairs if most is None else pairs.where(F.col("km") <= most))
        return found.join(asked.select("center", "member"), "center").select(F.col("member").alias(key), "best")
    # The first ring holds a fifth of a target where targets are.
    crowd = n / max(1, given.select(_cell(F.col("lat")), _cell(F.col("lon"))).distinct().count()) / (CELL_DEG * KM_PER_DEG) ** 2
    rings = [r for r in RINGS if r[0] >= 25 or r[0] ** 2 * math.pi * crowd >= 0.2]
    if most is not None:
        rings = [r for r in rings if r[0] < most] + [(most, next((c for r, c in RINGS if r >= most), 360.0))]
    found = None
    for radius, cell in rings:
        if radius > 25 and n >= MANY:
            pairs = _own(_fine_pairs(given, left, radius, cell))
        else:
            pairs = _own(within_radius(given, left, F.lit(radius), cell))
        best = written(_pick(pairs), "nearest")
        found = best if found is None else found.unionAll(best)
        left = written(left.join(best.select("center"), "center", "left_anti"), "nearest")
        if not left.limit(1).count():
            break
    return found.join(asked.select("center", "member"), "center").select(F.col("member").alias(key), "best")


def _with_nearest(points: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return points.join(found, key, "left").select(*points.columns, F.col("best.km").alias("nearest_km"), F.col("best.id").alias("nearest_id"))


def nearest_to(points: DataFrame, targets: DataFrame, key: str, target_key: str, group: str | None = None) -> DataFrame:
    """The nearest target of each point, however far, with nearest_km and nearest_id (the smaller id of equally near ones).

    A target whose id equals the point's is not its own; with ``group``, only targets of its group
    count. Rings of growing radius and cells, the first as small as the targets are dense: a point that
    finds a target inside a ring is done, as no target outside it can be nearer, so only lone points go
    on to wide rings, and there they look at small cells first. Points without any target have nulls.
    Keys must be unique; points with a null place have nulls, targets with one are left out.
    """
    return _with_nearest(points, _search(points, targets, key, target_key, group, None), key)


def nearest_other(points: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """The nearest other point of each point, of its group if given."""
    return nearest_to(points, points, key, key, group)


def nearest(points: DataFrame, targets: DataFrame, radius: float, key: str, target_key: str) -> DataFrame:
    """The nearest other target within ``radius`` km of each point (km and id), null if there is none."""
    return _with_nearest(points, _search(points, targets, key, target_key, None, radius), key)


def overlapping_pairs(windows: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pairs of disks (a.ord < b.ord) whose centres are nearer than both radii, with the overlap; b is one of ``others`` if given."""
    others = windows if others is None else others
    a = windows.select(F.col("window_id").alias("a"), F.col("ord").alias("ord_a"), F.col("radius_km").alias("r1"), F.col("center_lat").alias("clat"), F.col("center_lon").alias("clon"), F.col("window_stratum").alias("stratum_a"))
    b = others.select(F.col("window_id").alias("b"), F.col("ord").alias("ord_b"), F.col("radius_km").alias("r2"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"), F.col("window_stratum").alias("stratum_b"))
    most = others.agg(F.max("radius_km").alias("largest"))
    reach = a.crossJoin(F.broadcast(most)).withColumn("reach", F.col("r1") + F.col("largest"))
    pairs = within_radius(b, reach, F.col("reach")).where("ord_a < ord_b and km < r1 + r2")
    return pairs.withColumn("overlap", C.disk_overlap(F.col("r1"), F.col("r2"), F.col("km")))


def points_along(lines: DataFrame, spacing_km: float) -> DataFrame:
    """A point every ``spacing_km`` on each line from its start; lines has line_id, seq, lat, lon."""
    from stormgrid.operators.filters import by

    order = by("line_id", "seq")
    legs = lines.withColumn("lat1", F.lead("lat").over(order)).withColumn("lon1", F.lead("lon").over(order)).where("lat1 is not null")
    legs = legs.withColumn("km", C.haversine_km(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")))
    legs = legs.withColumn("upto", F.sum("km").over(order)).withColumn("start", F.col("upto") - F.col("km"))
    first = F.ceil(F.col("start") / spacing_km).cast("int")
    last = (F.ceil(F.col("upto") / spacing_km) - 1).cast("int")
    steps = legs.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    share = F.try_divide(F.col("k") * spacing_km - F.col("start"), F.col("km"))
    return steps.select("line_id", "k", (F.col("lat") + share * (F.col("lat1") - F.col("lat"))).alias("lat"), (F.col("lon") + share * (F.col("lon1") - F.col("lon"))).alias("lon"))


def ring_area_centroid(rings: DataFrame) -> DataFrame:
    """Area in km2 and centroid of each ring (id, ring) in an equal-area cylindrical projection."""
    sides = rings.select("id", F.posexplode("ring").alias("i", "p"), F.size("ring").alias("n"), "ring")
    nxt = F.element_at("ring", (F.col("i") + 1) % F.col("n") + 1)
    x, y = (lambda p: F.radians(p["lon"]) * C.EARTH_KM), (lambda p: F.sin(F.radians(p["lat"])) * C.EARTH_KM)
    cross = x(F.col("p")) * y(nxt) - x(nxt) * y(F.col("p"))
    sums = sides.groupBy("id").agg(
        F.sum(cross).alias("twice"), F.sum((x(F.col("p")) + x(nxt)) * cross).alias("sx"), F.sum((y(F.col("p")) + y(nxt)) * cross).alias("sy")
    )
    return sums.select(
        "id",
        (F.abs("twice") / 2).alias("area_km2"),
        F.degrees(F.asin(F.col("sy") / (3 * F.col("twice")) / C.EARTH_KM)).alias("centroid_lat"),
        F.degrees(F.col("sx") / (3 * F.col("twice")) / C.EARTH_KM).alias("centroid_lon"),
    )
