"""Readers and writers of the outage, station, coverage, network and result files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.sources.shared import written

OUTAGES = "fips int, state string, county string, start_time timestamp_ntz, duration double, min_customers double, max_customers double, mean_customers double"
STATION_NUMBERS = {"Latitude": "lat", "Longitude": "lon", "EV Level1 EVSE Num": "n_l1", "EV Level2 EVSE Num": "n_l2", "EV DC Fast Count": "n_dc"}

# Fixed value: how snapshots and the folders of their runs are named, (Jan 1 2020) or (Jan_1_2020).
SNAPSHOT = r"Jan(?: |_|%20)1(?: |_|%20)(\d{4})\)"


def _header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_outages(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Yearly CSV files stacked; a missing file is an error."""
    df = spark.read.schema(OUTAGES).option("header", True).option("enforceSchema", False).csv(list(paths))
    return df.withColumn("fips", C.norm_fips(F.col("fips")))


def read_station_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Electric stations with position, numbers of chargers and capacity; header names may hold blanks."""
    df = _header(spark.read.option("header", True).csv(path))
    C.require_columns(df, {"Latitude", "Longitude", "State"})
    if "Fuel Type Code" in df.columns:
        df = df.where(F.trim("Fuel Type Code") == "ELEC")
    numbers = [C.to_number(F.col(c), None if c.startswith("L") else 0.0).alias(n) if c in df.columns else F.lit(0.0).alias(n) for c, n in STATION_NUMBERS.items()]
    df = df.select(F.col("State").alias("state"), *numbers).where("lat is not null and lon is not null")
    return df.withColumn("capacity", C.capacity(F.col("n_l1"), F.col("n_l2"), F.col("n_dc")))


def read_clean_stations(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    C.require_columns(df, {"state", "lat", "lon"})
    for c in ("n_l1", "n_l2", "n_dc"):
        df = df.withColumn(c, C.to_number(F.col(c), 0.0) if c in df.columns else F.lit(0.0))
    df = df.withColumn("lat", C.to_number(F.col("lat"))).withColumn("lon", C.to_number(F.col("lon")))
    return df.withColumn("capacity", C.capacity(F.col("n_l1"), F.col("n_l2"), F.col("n_dc")))


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """County totals; rows whose code is no number (sums) go."""
    df = spark.read.option("header", True).csv(path).where(C.to_number(F.col("County_FIPS")).isNotNull())
    return df.select(C.norm_fips(F.col("County_FIPS")).alias("fips"), C.to_number(F.col("Customers")).alias("customers"))


def read_population(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    df = spark.read.option("header", True).option("encoding", encoding).csv(path)
    fips = F.concat(C.norm_fips(F.col("STATE"), 2), C.norm_fips(F.col("COUNTY"), 3))
    return df.select(fips.alias("fips"), C.to_number(F.col("POPESTIMATE2022")).alias("population"))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    year = F.year(F.try_to_timestamp("year", F.lit("M/d/yy")))
    return df.select("state", year.alias("year"), C.to_number(F.col("max_pct_covered")).alias("theta"))


#: Folders of a year over which graphs are dealt.
SHARDS = 64


def _shard(graph: Column) -> Column:
    return F.pmod(F.xxhash64(graph.cast("string")), F.lit(SHARDS)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def write_network(nodes: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> None:
    """Nodes, edges and meta (year, graph_id, ...) by year and shard of graphs; other graphs that the folder holds stay.

    Of the shards that are written anew, the graphs that do not change are copied.
    """
    for part, df in (("nodes", nodes), ("edges", edges), ("meta", meta)):
        new = df.withColumn("graph_id", F.col("graph_id").cast("string")).withColumn("shard", _shard(F.col("graph_id")))
        old = _stored(df.sparkSession, f"{path}/{part}")
        if old is not None:
            new = written(new, "network")
            old = old.withColumn("year", F.col("year").cast(new.schema["year"].dataType))
            kept = old.join(new.select("year", "shard").distinct(), ["year", "shard"], "left_semi").join(new.select("year", "graph_id").distinct(), ["year", "graph_id"], "left_anti")
            new = written(new.unionByName(kept, allowMissingColumns=True), "network")
        new = new.repartition("year", "shard")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "shard").parquet(f"{path}/{part}")


def read_network(spark: SparkSession, path: str, year: int | None = None, graphs: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and meta, of one year or of some graphs: only their folders are read."""
    out = []
    for part in ("nodes", "edges", "meta"):
        df = spark.read.parquet(f"{path}/{part}")
        df = df if year is None else df.where(F.col("year") == year)
        df = df if graphs is None else df.where(F.col("shard").isin([_shard(F.lit(g)) for g in graphs]) & F.col("graph_id").isin(graphs))
        out.append(df.drop("shard"))
    return tuple(out)


def write_scenario_results(metrics: DataFrame, events: DataFrame, common_events: DataFrame, path: str) -> None:
    """Metrics as CSV, the events and the events under common random numbers as gzip CSV, by unit and scenario.

    Partitions that are written replace their older forms only.
    """
    for part, df, codec in (("metrics", metrics, "none"), ("events", events, "gzip"), ("crn_events", common_events, "gzip")):
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit", "scenario")
        writer.option("header", True).option("compression", codec).csv(f"{path}/{part}")


def read_scenario_results(spark: SparkSession, path: str, metrics: str, events: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of :func:`write_scenario_results`, by their schemas (unit and scenario last)."""
    read = lambda part, schema: spark.read.schema(schema).option("header", True).csv(f"{path}/{part}")
    return read("metrics", metrics), read("events", events), read("crn_events", events)


def write_report(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_partitioned_metrics(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``family/netY_outZ/unit/*.csv``: the keys come from the path, whose parts may have a name and =."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    pattern = r"/(?:\w+=)?([^/=]+)/(?:\w+=)?net(\d+)_out(\d+)/(?:\w+=)?([^/=]+)/[^/]+$"
    path = F.col("_metadata.file_path")
    keys = {"family": 1, "net_year": 2, "out_year": 3, "unit": 4}
    return df.select("*", *(F.regexp_extract(path, pattern, k).alias(n) for n, k in keys.items()))


def resume_missing(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def geojson(df: DataFrame, properties: list[str], limit: int) -> DataFrame:
    """A FeatureCollection of points, as one text; the limit is the map's."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    top = df.orderBy(*properties).limit(limit)
    features = top.agg(F.sort_array(F.collect_list(feature)).alias("features"))
    return features.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("geojson"))


def geojson_areas(df: DataFrame, properties: list[str], limit: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A FeatureCollection of polygons, as one text, of the areas (ring, and the sides of its box) that meet the map's box.

    box is south, west, north, east; the limit is the map's, in the order of the properties. Open rings are closed.
    """
    inside = df if box is None else df.where(C.bbox_meets(*(F.col(c) for c in ("south", "west", "north", "east")), box))
    corners = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    closed = F.when(F.element_at(corners, 1) == F.element_at(corners, -1), corners).otherwise(F.concat(corners, F.slice(corners, 1, 1)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    named = inside.where(F.size("ring") > 0).orderBy(*properties).limit(limit)
    # Sorted by the properties: maps hold no more than the limit.
    rows = named.agg(F.array_sort(F.collect_list(F.struct(F.struct(*properties).alias("properties"), shape.alias("geometry")))).alias("rows"))
    features = F.transform("rows", lambda r: F.struct(F.lit("Feature").alias("type"), r["geometry"].alias("geometry"), r["properties"].alias("properties")))
    return rows.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))).alias("geojson"))


def windows_payload(windows: DataFrame, limit: int, box: tuple[float, float, float, float] | None = None, stratum: str | None = None, radius_km: float | None = None) -> DataFrame:
    """Disks of a map: windows of a stratum, of about a radius (within half a km), with centres in the box.

    box is south, west, north, east; the limit is the map's, in the order of window_id.
    """
    if stratum is not None:
        windows = windows.where(F.col("window_stratum") == stratum)
    if radius_km is not None:
        windows = windows.where(F.abs(F.col("radius_km") - radius_km) <= 0.5)
    if box is not None:
        windows = windows.where(C.in_bbox(F.col("center_lat"), F.col("center_lon"), *box))
    return windows.withColumn("radius_m", F.col("radius_km") * 1000).orderBy("window_id").limit(limit)


def snapshot_year(path) -> object:
    """Year of a snapshot's path, null where it has none."""
    return F.regexp_extract(path, SNAPSHOT, 1).try_cast("int")


def read_station_snapshots(spark: SparkSession, paths: Sequence[str], latest: bool = False) -> DataFrame:
    """Station snapshots with their year, all or those of the newest year; paths without a year are left out.

    Each file is read by its own header, as columns differ over the years.
    """
    dated = [(int(m[1]), p) for p in paths if (m := re.search(SNAPSHOT, p.rstrip("/").rsplit("/", 1)[-1]))]
    if not dated:
        raise ValueError("no path with the year of a snapshot")
    newest = max(dated)[0]
    read = [read_station_snapshot(spark, p).withColumn("year", F.lit(y)) for y, p in dated if not latest or y == newest]
    return reduce(DataFrame.unionByName, read)


def read_posterior(spark: SparkSession, path: str) -> DataFrame:
    """Draws of the county rate (draw_id, fips, lambda); chains of equally many draws are numbered one after the other."""
    df = spark.read.parquet(path)
    if "draw_id" not in df.columns:
        draws = df.agg((F.max("draw") + 1).alias("draws"))
        df = df.crossJoin(F.broadcast(draws)).withColumn("draw_id", F.col("chain") * F.col("draws") + F.col("draw"))  # one row
    return df.select(F.col("draw_id").cast("long").alias("draw_id"), C.norm_fips(F.col("fips")).alias("fips"), "lambda")


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Scenario panel; the dose comes from the scenario's name (_p20, _m30) where the column is absent."""
    df = spark.read.parquet(path)
    if "dose_pct" in df.columns:
        return df
    sign = F.when(F.regexp_extract("scenario", r"_([pm])\d+$", 1) == "m", -1).otherwise(1)
    size = F.regexp_extract("scenario", r"_[pm](\d+)$", 1).try_cast("int")
    return df.withColumn("dose_pct", F.coalesce(sign * size, F.lit(0)))


def read_polygons(spark: SparkSession, path: str, dropped: Sequence[str] = ()) -> DataFrame:
    """Rings (id, state, ring of lon, lat) with the four sides of their box; named states go."""
    df = spark.read.parquet(path).where(~F.col("state").isin(list(dropped)) if dropped else F.lit(True))
    lat, lon = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    return df.withColumns({"south": F.array_min(lat), "north": F.array_max(lat), "west": F.array_min(lon), "east": F.array_max(lon)})


def write_windows(windows: DataFrame, members: DataFrame, path: str) -> None:
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    members.write.mode("overwrite").parquet(f"{path}/window_nodes")


def write_subgraphs(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Nodes and edges of each window, and the manifest with their counts, which is returned."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    n = nodes.groupBy("window_id").agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy("window_id").agg(F.count("*").alias("n_edges"))
    manifest = n.join(m, "window_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def write_labels(labels: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    joined = labels.join(manifest, "window_id", "left")
    joined.write.mode("overwrite").parquet(f"{path}/parquet")
    joined.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return joined
