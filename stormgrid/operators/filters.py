"""Row-wise operators: event preparation, filters, scaling and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C

ATTACKS = {"all": None, "no-capacity": ["betweenness", "random"], "targeted": ["betweenness", "capacity"]}


def by(partition: str | list[str], *order):
    return Window.partitionBy(partition).orderBy(*order)


def add_event_times(df: DataFrame) -> DataFrame:
    return df.withColumn("end_time", C.end_time(F.col("start_time"), F.col("duration_min")))


def drop_regions(df: DataFrame, names: list[str], column: str = "state") -> DataFrame:
    return df.where(~F.col(column).isin(names))


def customer_share(df: DataFrame, floor: float = 0.0) -> DataFrame:
    """Share of the population that is out; needs duration_min, mean_customers and population."""
    fine = (F.col("duration_min") > 0) & (F.col("mean_customers") > 0) & (F.col("population") > 0)
    return df.where(fine).withColumn("share", C.clip(F.col("mean_customers") / F.col("population"), floor, 1))


def zscore(df: DataFrame, columns: list[str], ddof: int = 1, fit_on: DataFrame | None = None) -> DataFrame:
    """Standardise columns by the moments of ``fit_on`` (default: all rows); tiny deviations count as 1."""
    deviation = F.stddev_samp if ddof else F.stddev_pop
    source = df if fit_on is None else fit_on
    moments = source.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", deviation))))
    out = df.crossJoin(F.broadcast(moments))  # one row
    for c in columns:
        spread = F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - F.col(f"m_{c}")) / spread)
    return out.drop(*moments.columns)


def edge_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the position and capacity of both ends (suffixes _a and _b)."""
    keep = [c for c in ("lat", "lon", "capacity", "rn") if c in nodes.columns]
    a = nodes.select("graph_id", F.col("node_id").alias("src"), *(F.col(c).alias(f"{c}_a") for c in keep))
    b = nodes.select("graph_id", F.col("node_id").alias("dst"), *(F.col(c).alias(f"{c}_b") for c in keep))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])


def windows_conflict(r1: Column, r2: Column, d: Column, mode: str, most: float = 0.25) -> Column:
    if mode == "area":
        return C.disk_overlap(r1, r2, d) > most
    if mode == "centre":
        return d < F.greatest(r1, r2)
    raise ValueError(f"no mode {mode}")


def classify_location(points: DataFrame, stations: DataFrame, key: str, label: str, windows: DataFrame | None = None) -> DataFrame:
    """A label and the method that gave it: the point's own label, else that of the nearest labelled station
    within 50 km (the smaller key of equal ones), else urban or suburban by 15 stations within 10 or 30
    km and rural else. Without any station: the label of the nearest window (window_id, center_lat,
    center_lon, window_stratum), suburban if that is null; without windows: suburban.

    Stations of all states count. points and stations have ``key``, lat, lon and ``label``; a station
    of the same key as the point is the point itself, and counts for its density.
    """
    from stormgrid.operators.disks import disk_sums
    from stormgrid.operators.spatial import nearest, nearest_to

    centers = points.select(F.col(key).alias("center"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    held = lambda radius, name: disk_sums(stations, centers.withColumn("radius", F.lit(radius)), "center").withColumnRenamed("n", name)
    counts = held(30.0, "wide").join(held(10.0, "near"), "center", "left")
    known = stations.where(F.col(label).isNotNull()).select(F.col(key).alias("known"), "lat", "lon", F.col(label).alias("known_label"))
    beside = nearest(points.where(F.col(label).isNull()).select(key, "lat", "lon"), known, 50.0, key, "known")
    beside = beside.select(key, F.col("nearest_id").alias("known")).join(known.select("known", "known_label"), "known").drop("known")
    joined = points.join(counts.withColumnRenamed("center", key), key, "left").join(beside, key, "left")
    if stations.limit(1).count():
        rest, how = F.lit("rural"), F.lit("density")
    elif windows is not None:
        seen = windows.select(F.col("window_id").alias("window"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
        at = nearest_to(points.select(F.col(key).cast("string").alias("own"), "lat", "lon"), seen.withColumn("window", F.concat(F.lit("window "), F.col("window"))), "own", "window")
        tiers = windows.select(F.concat(F.lit("window "), F.col("window_id")).alias("nearest_id"), F.coalesce("window_stratum", F.lit("suburban")).alias("tier"))
        at = at.join(tiers, "nearest_id").select("own", "tier")
        joined = joined.join(at, joined[key].cast("string") == at["own"], "left").drop("own")
        rest, how = F.coalesce("tier", F.lit("suburban")), F.when(F.col("tier").isNotNull(), "window").otherwise("default")
    else:
        rest, how = F.lit("suburban"), F.lit("default")
    dense = F.when(F.col("near") >= 15, "urban").when(F.col("wide") >= 15, "suburban")
    method = F.when(F.col(label).isNotNull(), "own").when(F.col("known_label").isNotNull(), "station").otherwise(how)
    return joined.withColumn("method", method).withColumn("label", F.coalesce(F.col(label), "known_label", dense, rest))


def split_id(c: Column, pattern: str) -> tuple[Column, Column]:
    number = F.regexp_extract(c, pattern, 2)
    return F.regexp_extract(c, pattern, 1), number.try_cast("bigint")


def apply_scenario(events: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each event under each scenario; the scenarios are the rows of a study's plan, hence broadcast."""
    scale = F.when(F.col("urban"), F.coalesce("urban_scale", "radius_scale")).otherwise(F.col("radius_scale"))
    out = events.crossJoin(F.broadcast(scenarios)).withColumn("radius_km", F.col("radius_km") * scale)
    return out.withColumn("duration_hours", F.col("duration_hours") * F.col("duration_scale"))


def wrong_vintage(fips: Column) -> Column:
    return fips.startswith("09") & ~fips.isin(C.LEGACY_CT)


def assert_fips_vintage(df: DataFrame, column: str = "fips") -> DataFrame:
    found = df.where(wrong_vintage(F.col(column))).limit(1).count()
    if found:
        raise ValueError("county codes of another vintage")
    return df


def interpolate(asked: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """y at each x by the line between the samples (x, y) around it; null for keys without samples.

    Samples of one x count by their mean.
    """
    order = by(key, "x")
    means = samples.groupBy(F.col(key), "x").agg(F.avg("y").alias("y"))
    segments = means.select(
        F.col(key).alias("of"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1")
    )
    inside = (F.col("x0") <= F.col("x")) & ((F.col("x") < F.col("x1")) | F.col("x1").isNull())
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    y = F.col("y0") + F.coalesce(slope * (F.col("x") - F.col("x0")), F.lit(0.0))
    return asked.join(segments, (F.col(key) == F.col("of")) & inside, "left").withColumn("y", y)


def efficiency_at(asked: DataFrame, samples: DataFrame, baselines: DataFrame, key: str) -> DataFrame:
    """Efficiency y once x nodes are removed, from samples (x, y) of removals; every asked row has one.

    Nothing removed: the baseline (``key``, baseline, n). Below the first sample a line from the
    baseline to the best sample; above the last the worst sample shrinks with the share of the graph's
    n nodes that goes beyond it, to 0 at least; in between linear. Keys without samples keep the baseline.
    """
    ends = samples.groupBy(F.col(key).alias("of_key")).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.max("y").alias("best"), F.min("y").alias("worst"))
    out = interpolate(asked, samples, key).drop("of", "x0", "y0", "x1", "y1").withColumnRenamed("y", "inside")
    out = out.join(ends, out[key] == ends["of_key"], "left").drop("of_key")
    base = baselines.select(F.col(key).alias("base_key"), "baseline", F.col("n").alias("base_n"))
    out = out.join(base, out[key] == base["base_key"], "left").drop("base_key")
    below = F.col("baseline") - (F.col("baseline") - F.col("best")) * F.try_divide("x", "least")
    above = F.greatest(F.lit(0.0), F.col("worst") * (1 - F.try_divide(F.col("x") - F.col("most"), F.col("base_n"))))
    y = F.when((F.col("x") == 0) | F.col("least").isNull(), F.col("baseline")).when(F.col("x") < F.col("least"), below).when(F.col("x") > F.col("most"), above)
    return out.withColumn("y", y.otherwise(F.col("inside"))).drop("inside", "least", "most", "best", "worst", "baseline", "base_n")


def select_curves(df: DataFrame, attacks: str | list[str], points: int) -> DataFrame:
    chosen = ATTACKS[attacks] if isinstance(attacks, str) else attacks
    place = F.dense_rank().over(by(["window_id", "attack"], "pct"))
    kept = df if chosen is None else df.where(F.col("attack").isin(chosen))
    return kept.withColumn("place", place).where(F.col("place") <= points).drop("place")


def event_filters(df, min_minutes=None, max_minutes=None, min_customers=None, excluded=()) -> DataFrame:
    tests = [
        (min_minutes, F.col("duration_min") >= min_minutes),
        (max_minutes, F.col("duration_min") <= max_minutes),
        (min_customers, F.col("mean_customers") >= min_customers),
        (excluded or None, ~F.col("state").isin(list(excluded))),
    ]
    return reduce(lambda d, x: d.where(x), [c for v, c in tests if v is not None], df)


def consistent_keys(keys: list[str], *tables: DataFrame) -> DataFrame:
    """Keys that every table has."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*keys) for t in tables])


def keep_year(df: DataFrame, year: int | None, column: str = "start_time") -> DataFrame:
    return df if year is None else df.where(F.year(column) == year)


def prepare_history(df: DataFrame) -> DataFrame:
    known = [F.col("duration_hours")] if "duration_hours" in df.columns else []
    hours = F.coalesce(*known, F.col("duration_min") / 60.0, F.lit(1.0))
    return df.withColumn("hours", hours).withColumn("aco", F.col("mean_customers") * hours)


def lines_in_box(df: DataFrame, column: str, pattern: str, inside: Column) -> DataFrame:
    return df.where(F.col(column).rlike(pattern) & inside)


def min_nodes(df: DataFrame, n: int, column: str = "n") -> DataFrame:
    return df.where(F.col(column) >= n)
