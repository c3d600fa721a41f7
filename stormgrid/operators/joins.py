"""Joins of members, labels, scenarios and pools, array forms of curves, and table checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators.filters import by
from stormgrid.operators.outages import left_lookup

CELL_DEG = 1.0


def within_polygon(points: DataFrame, polygons: DataFrame, default: str | None = None) -> DataFrame:
    """Label of the polygon (label, ring) that holds each point, by cells of its box and the ring test.

    Of several polygons the smallest label; points outside all keep the default.
    """
    box = polygons.select(
        "label", "ring",
        F.array_min(F.transform("ring", lambda p: p["lat"])).alias("south"), F.array_max(F.transform("ring", lambda p: p["lat"])).alias("north"),
        F.array_min(F.transform("ring", lambda p: p["lon"])).alias("west"), F.array_max(F.transform("ring", lambda p: p["lon"])).alias("east"),
    )
    cell = lambda c: F.floor(F.col(c) / CELL_DEG).cast("int")
    cells = box.withColumn("cy", F.explode(F.sequence(cell("south"), cell("north")))).withColumn("cx", F.explode(F.sequence(cell("west"), cell("east"))))
    placed = points.withColumn("cy", cell("lat")).withColumn("cx", cell("lon"))
    hits = placed.join(cells, ["cy", "cx"]).where(C.in_ring("lat", "lon", "ring"))
    found = hits.groupBy("point_id").agg(F.min("label").alias("label"))
    out = points.join(found, "point_id", "left")
    return out if default is None else out.withColumn("label", F.coalesce("label", F.lit(default)))


def boxes_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes (id, south, west, north, east) that meet, by cells; each pair once."""
    cell = lambda c: F.floor(F.col(c) / CELL_DEG).cast("int")
    spread = lambda d: d.withColumn("cy", F.explode(F.sequence(cell("south"), cell("north")))).withColumn("cx", F.explode(F.sequence(cell("west"), cell("east"))))
    right = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
    right = right.withColumn("cy", F.explode(F.sequence(cell("south_b"), cell("north_b")))).withColumn("cx", F.explode(F.sequence(cell("west_b"), cell("east_b"))))
    meets = (F.col("south") <= F.col("north_b")) & (F.col("north") >= F.col("south_b")) & (F.col("west") <= F.col("east_b")) & (F.col("east") >= F.col("west_b"))
    # Of the cells that both touch only the first one counts.
    first = (F.col("cy") == F.greatest(cell("south"), cell("south_b"))) & (F.col("cx") == F.greatest(cell("west"), cell("west_b")))
    return spread(a).join(right, ["cy", "cx"]).where(meets & first).select("id", "id_b")


def polygons_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of polygons (id, ring) that share a point: boxes by cells first, then corners and sides; each pair once.

    Polygons with equal rings are tested once.
    """
    lat, lon = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    ends = [F.array_min(lat).alias("south"), F.array_min(lon).alias("west"), F.array_max(lat).alias("north"), F.array_max(lon).alias("east")]
    shapes = lambda d: d.groupBy("ring").agg(F.min("id").alias("id"))
    one, two = shapes(a), shapes(b)
    near = boxes_meet(one.select("id", *ends), two.select("id", *ends))
    near = near.join(one.select("id", F.col("ring").alias("one")), "id").join(two.select(F.col("id").alias("id_b"), F.col("ring").alias("other")), "id_b")
    met = near.where(C.rings_meet("one", "other")).select("one", "other")
    return met.join(a.select("id", F.col("ring").alias("one")), "one").join(b.select(F.col("id").alias("id_b"), F.col("ring").alias("other")), "other").select("id", "id_b")


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in the same window."""
    a = members.select("window_id", F.col("node_id").alias("src"))
    b = members.select("window_id", F.col("node_id").alias("dst"))
    return edges.join(a, "src").join(b, ["window_id", "dst"])


def ladder(df: DataFrame, pools: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """The first pool (name, sizes n by keys) that has rows for each row of df: level and pool size."""
    out = df
    for name, pool, keys in pools:
        out = out.join(pool.select(*keys, F.col("n").alias(f"n_{name}")), keys, "left")
    level = F.coalesce(*(F.when(F.col(f"n_{name}") > 0, name) for name, _, _ in pools))
    size = F.coalesce(*(F.when(F.col(f"n_{name}") > 0, F.col(f"n_{name}")) for name, _, _ in pools))
    return out.withColumn("level", level).withColumn("pool", size).drop(*(f"n_{name}" for name, _, _ in pools))


def scenario_graph(scenarios: DataFrame, graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenarios with their graph variant, and those whose variant is missing."""
    return scenarios.join(graphs, "variant"), scenarios.join(graphs, "variant", "left_anti")


def window_detail(windows: DataFrame, members: DataFrame) -> DataFrame:
    lists = members.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "capacity"))).alias("stations"))
    return windows.join(lists, "window_id", "left")


def feature_label_join(features: DataFrame, labels: DataFrame, meta: DataFrame) -> DataFrame:
    return left_lookup(left_lookup(features, labels, ["window_id"]).where(F.lit(True)), meta, ["window_id"])


def curve_to_columns(df: DataFrame, attacks: list[str], pcts: list[int]) -> DataFrame:
    names = [f"y_{a}_{p}" for a in attacks for p in pcts]
    named = df.withColumn("name", F.concat_ws("_", F.lit("y"), "attack", "pct"))
    return named.groupBy("window_id").pivot("name", names).agg(F.first("y_true"))


def columns_to_curve(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c.startswith("y_")]
    long = df.unpivot("window_id", names, "name", "y")
    attack, pct = F.regexp_extract("name", r"^y_(.*)_(\d+)$", 1), F.regexp_extract("name", r"^y_(.*)_(\d+)$", 2)
    return long.select("window_id", attack.alias("attack"), pct.cast("int").alias("pct"), "y")


def curve_vectors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arrays of a curve in the order of pct."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pct", value))).alias("points"))
    return rows.select(*keys, F.col(f"points.{value}").alias("curve"))


def curve_mean_peak(df: DataFrame) -> DataFrame:
    mean = F.aggregate("curve", F.lit(0.0), lambda a, x: a + x) / F.size("curve")
    return df.withColumn("mean", mean).withColumn("peak", F.array_max("curve")).withColumn("kept", F.transform("curve", lambda x: 1.0 - x))


def states_in(df: DataFrame, key: str, state: str) -> DataFrame:
    out = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(state)), ",").alias("states"))
    return out.withColumn("primary", F.split_part("states", F.lit(","), F.lit(1)))


def flatten_report(df: DataFrame, column: str, paths: dict[str, list[str]]) -> DataFrame:
    """A number for each name: the first JSON path that is there."""
    get = lambda path: F.get_json_object(column, path).try_cast("double")
    return df.withColumns({name: F.coalesce(*map(get, options)) for name, options in paths.items()})


def history_lists(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("event_id", "hours", "mean_customers"))).alias("history"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without loops; of repeated edges the smallest weight."""
    one = edges.where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    one = one.groupBy("graph_id", "a", "b").agg(F.min("weight").alias("weight"))
    forth = one.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return forth.unionAll(one.select("graph_id", F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


# --- checks: one row each, with name, status and value


def _check(name: str, status, value) -> list:
    return [F.lit(name).alias("name"), status.alias("status"), value.cast("double").alias("value")]


def check_same(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float) -> DataFrame:
    """Rows of b equal those of a in the columns, up to a tolerance."""
    pairs = a.alias("a").join(b.alias("b"), keys)
    diff = reduce(F.greatest, [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns]) if len(columns) > 1 else F.abs(F.col(f"a.{columns[0]}") - F.col(f"b.{columns[0]}"))
    out = pairs.agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("d"))
    return out.select(*_check("same", F.when(F.col("d") <= tol, "pass").otherwise("fail"), F.col("d")))


def check_range(df: DataFrame, column: str, fail: tuple[float, float], warn: tuple[float, float]) -> DataFrame:
    m = F.col("m")
    status = F.when((m <= fail[0]) | (m >= fail[1]), "fail").when((m <= warn[0]) | (m >= warn[1]), "warn").otherwise("pass")
    return df.agg(F.avg(column).alias("m")).select(*_check("range", status, m))


def check_coverage(df: DataFrame, other: DataFrame, keys: list[str], least: float) -> DataFrame:
    seen = df.join(other.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    share = seen.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("m"))
    return share.select(*_check("coverage", F.when(F.col("m") >= least, "pass").otherwise("fail"), F.col("m")))


def check_monotone(df: DataFrame, keys: list[str], dose: str, value: str, up: bool) -> DataFrame:
    before = F.lag(value).over(by(keys, dose))
    wrong = F.col(value) < before if up else F.col(value) > before
    out = df.withColumn("w", F.coalesce(wrong, F.lit(False))).agg(F.count_if("w").alias("n"))
    return out.select(*_check("monotone", F.when(F.col("n") == 0, "pass").otherwise("fail"), F.col("n")))


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tol: float) -> DataFrame:
    """Differing cells by column: null against a value, or numbers further apart than the tolerance."""
    left = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in columns), F.lit(1).alias("_a"))
    right = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in columns), F.lit(1).alias("_b"))
    both = left.join(right, keys, "full")
    differs = lambda c: ~(F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) | F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= tol, F.lit(False)))
    counts = both.agg(*(F.count_if(differs(c)).alias(c) for c in columns), F.count_if(F.expr("_a is null or _b is null")).alias("rows_missing"))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in [*columns, "rows_missing"]))))
