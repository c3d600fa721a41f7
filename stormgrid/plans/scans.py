"""Sources and sinks: each query writes data derived from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stormgrid.sources import tables as S
from stormgrid.sources.shared import shared_dir
from stormgrid.streaming import outages as T
from stormgrid.plans.registry import Tables, query


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def text(*columns):
    return [F.col(c).cast("string").alias(c) for c in columns]


@query("s01_read_outages", "select fips, state, start_time, duration_min / 60 as duration, mean_customers from fx_outages", "duration mean_customers")
def s01(t: Tables):
    path = folder(t, "outages")
    rows = t.fx_outages.withColumn("duration", F.col("duration_min") / 60.0)
    rows.select(F.col("fips").cast("int").alias("fips"), "state", "county", "start_time", "duration", "min_customers", "max_customers", "mean_customers", "year").write.partitionBy("year").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)
    years = [r["year"] for r in rows.select("year").distinct().toLocalIterator()]
    return S.read_outages(t.spark, [f"{path}/year={y}" for y in years]).select("fips", "state", "start_time", "duration", "mean_customers")


@query("s02_read_station_snapshot", "select state, lat, lon, 5 * n_l1 + 25 * n_l2 + 300 * n_dc as capacity from fx_stations where station_id % 9 <> 0", "lat lon capacity")
def s02(t: Tables):
    path = folder(t, "stations")
    fuel = F.when(F.col("station_id") % 9 == 0, "LPG").otherwise("ELEC")
    names = {"lat": " Latitude", "lon": "Longitude ", "state": "State", "n_l1": "EV Level1 EVSE Num", "n_l2": "EV Level2 EVSE Num", "n_dc": "EV DC Fast Count"}
    t.fx_stations.withColumn("Fuel Type Code", fuel).select(*(F.col(c).alias(n) for c, n in names.items()), "Fuel Type Code").write.option("header", True).csv(path)
    return S.read_station_snapshot(t.spark, path).select("state", "lat", "lon", "capacity")


@query("s03_read_clean_stations", "select state, lat, lon, 5 * n_l1 + 300 * n_dc as capacity from fx_stations", "lat lon capacity")
def s03(t: Tables):
    path = folder(t, "clean")
    t.fx_stations.select("state", "lat", "lon", "n_l1", "n_dc").write.option("header", True).csv(path)
    return S.read_clean_stations(t.spark, path).select("state", "lat", "lon", "capacity")


@query("s04_read_customers", "select fips, customers from fx_county", "customers")
def s04(t: Tables):
    path = folder(t, "customers")
    rows = t.fx_county.select(F.col("fips").alias("County_FIPS"), F.col("customers").cast("string").alias("Customers"))
    total = t.fx_county.agg(F.lit("Grand Total").alias("County_FIPS"), F.sum("customers").cast("string").alias("Customers"))
    rows.unionAll(total).write.option("header", True).csv(path)
    return S.read_customers(t.spark, path)


@query("s05_read_population", "select fips, population from fx_county", "population")
def s05(t: Tables):
    path = folder(t, "population")
    t.fx_county.select(F.substring("fips", 1, 2).cast("int").alias("STATE"), F.substring("fips", 3, 3).cast("int").alias("COUNTY"), F.col("population").alias("POPESTIMATE2022")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return S.read_population(t.spark, path)


@query("s06_read_coverage", "select state, year, theta from fx_coverage", "theta")
def s06(t: Tables):
    path = folder(t, "coverage")
    t.fx_coverage.select("state", F.concat(F.lit("1/1/"), F.substring(F.col("year").cast("string"), 3, 2)).alias("year"), F.col("theta").alias("max_pct_covered")).write.option("header", True).csv(path)
    return S.read_coverage(t.spark, path)


@query("s08_network", """select n.graph_id, n.node_id, n.capacity + case when n.graph_id like 'S1%' then 1 else 0 end as capacity, coalesce(n_edges, 0) as n_edges, 'km' as unit from fx_nodes n
left join (select src as node_id, count(*) as n_edges from fx_edges group by 1) e using (node_id)""", "capacity")
def s08(t: Tables):
    """Two writes: the second replaces some graphs, whose nodes have gained a capacity of one."""
    path, year = folder(t, "network"), F.lit(2023)
    meta = t.fx_nodes.groupBy("graph_id").agg(F.count("*").alias("n")).withColumns({"unit": F.lit("km"), "year": year})
    S.write_network(t.fx_nodes.withColumn("year", year), t.fx_edges.withColumn("year", year), meta, path)
    again = lambda d: d.withColumn("year", year).where("graph_id like 'S1%'")
    S.write_network(again(t.fx_nodes.withColumn("capacity", F.col("capacity") + 1)), again(t.fx_edges), again(meta), path)
    nodes, edges, about = S.read_network(t.spark, path, 2023)
    degree = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n_edges"))
    joined = nodes.select("graph_id", "node_id", "capacity").join(degree, "node_id", "left").join(about.select("graph_id", "unit"), "graph_id")
    return joined.withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


@query("s09_read_posterior", "select event_id % 40 as draw_id, count(*) as n, avg(value) as rate from events group by 1", "rate")
def s09(t: Tables):
    path = folder(t, "posterior")
    place = F.col("event_id") % 40
    t.events.select(F.floor(place / 10).alias("chain"), (place % 10).alias("draw"), F.lit("1001").alias("fips"), F.col("value").alias("lambda")).write.parquet(path)
    return S.read_posterior(t.spark, path).groupBy("draw_id").agg(F.count("*").alias("n"), F.avg("lambda").alias("rate"))


@query("s13_scenario_results", """select unit, family as scenario, year, sim_id, loss, n_events, n_hit, loss / (1 + n_hit) as per_event, loss * 2 as common from fx_sims""", "loss per_event common")
def s13(t: Tables):
    path = folder(t, "results")
    metrics = t.fx_sims.withColumnRenamed("family", "scenario")
    events = metrics.select("year", "sim_id", (F.col("loss") / (1 + F.col("n_hit"))).alias("value"), "unit", "scenario")
    S.write_scenario_results(metrics, events, events.withColumn("value", F.col("value") * 0), path)
    # A second write of the common events of all units replaces the first.
    common = metrics.select("year", "sim_id", (F.col("loss") * 2).alias("value"), "unit", "scenario")
    S.write_scenario_results(metrics, events, common, path)
    back = S.read_scenario_results(t.spark, path, "year int, sim_id int, loss double, n_events bigint, n_hit bigint, unit string, scenario string", "year int, sim_id int, value double, unit string, scenario string")
    key = ["unit", "scenario", "year", "sim_id"]
    return back[0].join(back[1].withColumnRenamed("value", "per_event"), key).join(back[2].withColumnRenamed("value", "common"), key)


@query("s14_report", "select unit, count(*) as n from fx_sims group by 1")
def s14(t: Tables):
    path = folder(t, "report")
    S.write_report(t.fx_sims.groupBy("unit").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("unit string, n bigint").json(path)


@query("s15_partitioned_metrics", "select family, unit, cast(year as varchar) as net_year, count(*) as n from fx_sims group by 1, 2, 3")
def s15(t: Tables):
    path = folder(t, "metrics")
    run = F.format_string("net%d_out%d", "year", "year")
    rows = t.fx_sims.select("loss", "n_events", "family", run.alias("run"), "unit")
    rows.write.partitionBy("family", "run", "unit").option("header", True).csv(path)
    back = S.read_partitioned_metrics(t.spark, path, "loss double, n_events bigint")
    return back.groupBy("family", "unit", "net_year").agg(F.count("*").alias("n"))


@query("s16_resume_missing", "select fips from fx_county where fips not in (select fips from fx_outages where year <= 2018 and duration_min > 500)")
def s16(t: Tables):
    return S.resume_missing(t.fx_county, t.fx_outages.where("year <= 2018 and duration_min > 500"), ["fips"]).select("fips")


@query("s17_geojson", "select count(*) as n from (select * from fx_stations order by station_id limit 100) q")
def s17(t: Tables):
    text_ = S.geojson(t.fx_stations, ["station_id", "state"], 100)
    return text_.select(F.size(F.from_json("geojson", "type string, features array<struct<type: string>>")["features"]).cast("long").alias("n"))


@query("s17_geojson_areas", "select fips, state, 5 as corners, centroid_lon - 0.7 as lon, centroid_lat - 0.5 as lat from fx_county where centroid_lat - 0.5 <= 38 and centroid_lat + 0.5 >= 32 and centroid_lon - 0.7 <= -100 and centroid_lon + 0.7 >= -115 order by fips, state limit 200", "lon lat")
def s17a(t: Tables):
    south, west = F.col("centroid_lat") - 0.5, F.col("centroid_lon") - 0.7
    sides = {"south": south, "west": west, "north": F.col("centroid_lat") + 0.5, "east": F.col("centroid_lon") + 0.7}
    ring = F.array(*(F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for x, y in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"))))
    areas = t.fx_county.withColumns(sides).withColumn("ring", ring)
    made = S.geojson_areas(areas, ["fips", "state"], 200, (32.0, -115.0, 38.0, -100.0))
    shape = "features array<struct<geometry: struct<coordinates: array<array<array<double>>>>, properties: struct<fips: string, state: string>>>"
    feature = made.select(F.explode(F.from_json("geojson", shape)["features"]).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("ring"))
    return feature.select("fips", "state", F.size("ring").alias("corners"), F.col("ring")[0][0].alias("lon"), F.col("ring")[0][1].alias("lat"))


@query("s18_windows_payload", "select window_id, center_lat, center_lon, radius_km * 1000 as radius_m from fx_windows where window_stratum = 'suburban' and abs(radius_km - 30.3) <= 0.5 and center_lat between 32 and 40 and center_lon between -115 and -95 order by window_id limit 300", "center_lat center_lon radius_m")
def s18w(t: Tables):
    out = S.windows_payload(t.fx_windows, 300, (32.0, -115.0, 40.0, -95.0), "suburban", 30.3)
    return out.select("window_id", "center_lat", "center_lon", "radius_m")


@query("s18_map_points", "select station_id, lat, lon from fx_stations where lat between 32 and 36 and lon between -115 and -100 order by station_id limit 500", "lat lon")
def s18(t: Tables):
    inside = F.col("lat").between(32, 36) & F.col("lon").between(-115, -100)
    return t.fx_stations.where(inside).orderBy("station_id").limit(500).select("station_id", "lat", "lon")


@query("s19_snapshot_year", "select distinct 2018 + event_id % 6 as year from events")
def s19(t: Tables):
    names = t.fx_outages.select(F.concat(F.lit("stations (Jan 1 "), F.col("year").cast("string"), F.lit(").csv")).alias("p")).distinct()
    return names.select(S.snapshot_year(F.col("p")).cast("long").alias("year"))


@query("s19_latest_snapshot", "select 2020 as year, state, lat, lon, 5 * n_l1 + 25 * n_l2 + 300 * n_dc as capacity from fx_stations where station_id % 3 = 2", "lat lon capacity")
def s19l(t: Tables):
    path = folder(t, "snapshots")
    names = {"lat": "Latitude", "lon": "Longitude", "state": "State", "n_l1": "EV Level1 EVSE Num", "n_l2": "EV Level2 EVSE Num", "n_dc": "EV DC Fast Count"}
    paths = [f"{path}/stations (Jan 1 {2018 + k})" for k in range(3)]
    for k, snapshot in enumerate(paths):
        t.fx_stations.where(F.col("station_id") % 3 == k).select(*(F.col(c).alias(n) for c, n in names.items())).write.option("header", True).csv(snapshot)
    return S.read_station_snapshots(t.spark, paths, latest=True).select("year", "state", "lat", "lon", "capacity")


@query("s20_national_nodes", "select concat_ws('_', graph_id, node_id) as global_id, capacity from fx_nodes", "capacity")
def s20(t: Tables):
    return t.fx_nodes.select(F.concat_ws("_", "graph_id", F.col("node_id").cast("string")).alias("global_id"), "capacity")


@query("s21_read_panel", "select family, cast((year - 2020) * 10 as int) as dose_pct, count(*) as n from fx_sims group by 1, 2")
def s21(t: Tables):
    path = folder(t, "panel")
    dose = (F.col("year") - 2020) * 10
    name = F.concat("family", F.when(dose < 0, "_m").otherwise("_p"), F.abs(dose).cast("string"))
    t.fx_sims.select("family", name.alias("scenario"), "loss").write.parquet(path)
    return S.read_panel(t.spark, path).groupBy("family", "dose_pct").agg(F.count("*").alias("n"))


@query("t01_session_merge")
def t01(t: Tables):
    """The batch twin of the stream; tests compare it with the window form."""
    return T.session_merge(t.fx_outages.withColumn("start_time", F.col("start_time").cast("timestamp")), 60)


@query("t02_hourly_active", "with h as (select state, mean_customers, unnest(generate_series(date_trunc('hour', start_time), date_trunc('hour', start_time + to_microseconds(cast(round(duration_min * 60 * 1000000) as bigint))), interval 1 hour)) as hour from fx_outages) select hour, state, count(*) as n, sum(mean_customers) as customers from h group by 1, 2", "customers")
def t02(t: Tables):
    df = t.fx_outages.withColumn("start_time", F.col("start_time").cast("timestamp"))
    return T.hourly_active(df).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("s07_read_polygons", "select fips as id, centroid_lat - 0.5 as south, centroid_lon + 0.7 as east from fx_county where state <> 'S5'", "south east")
def s07(t: Tables):
    path = folder(t, "polygons")
    corners = [(-0.5, -0.7), (0.5, -0.7), (0.5, 0.7), (-0.5, 0.7)]
    ring = F.array(*(F.struct((F.col("centroid_lon") + x).alias("lon"), (F.col("centroid_lat") + y).alias("lat")) for y, x in corners))
    t.fx_county.select(F.col("fips").alias("id"), "state", ring.alias("ring")).write.parquet(path)
    return S.read_polygons(t.spark, path, ["S5"]).select("id", "south", "east")


@query("s10_write_windows", "select window_id, radius_km from fx_windows", "radius_km")
def s10(t: Tables):
    path = folder(t, "windows")
    S.write_windows(t.fx_windows, t.fx_nodes.select(F.col("graph_id").alias("window_id"), "node_id"), path)
    return t.spark.read.parquet(f"{path}/windows").select("window_id", "radius_km")


@query("s11_write_subgraphs", "select graph_id as window_id, count(*) as n_nodes, (select count(*) from fx_edges e where e.graph_id = n.graph_id) as n_edges from fx_nodes n group by 1")
def s11(t: Tables):
    named = lambda d: d.withColumnRenamed("graph_id", "window_id")
    path = folder(t, "subgraphs")
    S.write_subgraphs(named(t.fx_nodes), named(t.fx_edges), path)
    return t.spark.read.parquet(f"{path}/manifest")


@query("s12_write_labels", "select window_id, avg(y_true) as y, min(radius_km) as radius_km from fx_curves group by 1", "y radius_km")
def s12(t: Tables):
    path = folder(t, "labels")
    labels = t.fx_curves.groupBy("window_id").agg(F.avg("y_true").alias("y"))
    S.write_labels(labels, t.fx_windows.select("window_id", "radius_km"), path)
    return t.spark.read.schema("window_id string, y double, radius_km double").option("header", True).csv(f"{path}/csv")
