"""Joins, array forms and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators import joins as J
from stormgrid.operators import outages as O
from stormgrid.operators import spatial as S
from stormgrid.operators.disks import disk_sums
from stormgrid.plans.registry import Tables, query
from stormgrid.plans.scalars import _HAV, _OVERLAP

HAV = _HAV.format


@query("j01_add_population", "select o.event_id, c.population from fx_outages o left join (select lower(trim(concat(' County  ', cast(cast(fips as int) - 1001 as varchar), ' '))) as k, state, population from fx_county) c on lower(trim(o.county)) = c.k and o.state = c.state", "population")
def j01(t: Tables):
    names = F.concat(F.lit("county  "), (F.col("fips").cast("int") - 1001).cast("string"))
    pop = t.fx_county.select("state", names.alias("key"), "population")
    return O.left_lookup(t.fx_outages.withColumn("key", C.clean_key(F.col("county"))), pop, ["state", "key"]).select("event_id", "population")


@query("j02_add_customers", "select event_id, c.customers from fx_outages o left join fx_county c using (fips)", "customers")
def j02(t: Tables):
    return O.left_lookup(t.fx_outages, t.fx_county.select("fips", "customers"), ["fips"]).select("event_id", "customers")


@query("j03_add_coverage", "select event_id, coalesce(theta, 1.0) as theta from fx_outages left join fx_coverage using (state, year)", "theta")
def j03(t: Tables):
    return O.left_lookup(t.fx_outages, t.fx_coverage, ["state", "year"], {"theta": 1.0}).select("event_id", "theta")


@query("j04_add_county_attrs", "select event_id, area_km2, customers / area_km2 as density from fx_outages left join fx_county using (fips)", "area_km2 density")
def j04(t: Tables):
    df = O.left_lookup(t.fx_outages, t.fx_county.select("fips", "area_km2", "customers"), ["fips"])
    return df.select("event_id", "area_km2", (F.col("customers") / F.col("area_km2")).alias("density"))


def event_disks(t: Tables):
    return t.fx_epicenters.select("event_id", F.col("graph_id").alias("state"), F.col("radius_km").alias("radius"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))


@query("j05_within_radius", f"select e.event_id, count(*) as n, min(s.station_id) as first from fx_epicenters e join fx_stations s on s.state = e.graph_id and {HAV(a='e.', b='s.')} <= e.radius_km group by 1")
def j05(t: Tables):
    return disk_sums(t.fx_stations, event_disks(t), "event_id", least="station_id", group="state").withColumnRenamed("least", "first")


_BOXES = "select n_nationkey as id, 30 + (n_nationkey % 10) * 1.5 + 0.2 as south, -120 + (n_nationkey % 10) * 4.0 + 0.3 as west, 30 + (n_nationkey % 10) * 1.5 + 1.3 as north, -120 + (n_nationkey % 10) * 4.0 + 3.1 as east from nation"


def boxes(t: Tables):
    k = (F.col("n_nationkey") % 10).cast("double")
    return t.nation.select(F.col("n_nationkey").alias("id"), (k * 1.5 + 30.2).alias("south"), (k * 4.0 - 119.7).alias("west"), (k * 1.5 + 31.3).alias("north"), (k * 4.0 - 116.9).alias("east"))


@query("j06_within_polygon", f"select s.station_id as point_id, coalesce(min(lpad(cast(b.id as varchar), 3, '0')), 'none') as label from fx_stations s left join ({_BOXES}) b on s.lat > south and s.lat < north and s.lon > west and s.lon < east group by 1")
def j06(t: Tables):
    corners = [("south", "west"), ("north", "west"), ("north", "east"), ("south", "east")]
    ring = F.array(*(F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for y, x in corners))
    polygons = boxes(t).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("label"), ring.alias("ring"))
    return J.within_polygon(t.fx_stations.select(F.col("station_id").alias("point_id"), "lat", "lon"), polygons, "none").select("point_id", "label")


@query("j07_boxes_meet", f"with b as ({_BOXES}) select a.id, b.id as id_b from b a join b on a.south <= b.north and a.north >= b.south and a.west <= b.east and a.east >= b.west")
def j07(t: Tables):
    return J.boxes_meet(boxes(t), boxes(t))


def triangles(t: Tables, lower: bool):
    """One half of each box, so that boxes may meet where polygons do not."""
    corners = [("south", "west"), ("south", "east"), ("north", "west")] if lower else [("north", "east"), ("south", "east"), ("north", "west")]
    k = F.col("s_suppkey")
    box = t.supplier.select(k.alias("id"), ((k * 7 % 40) / 8.0 + 30).alias("south"), ((k * 11 % 48) / 8.0 - 120).alias("west"), (0.25 + k % 5 / 4.0).alias("side"))
    box = box.withColumn("north", F.col("south") + F.col("side")).withColumn("east", F.col("west") + F.col("side"))
    return box.select("id", F.array(*(F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")) for y, x in corners)).alias("ring"))


# The lower half of a meets the upper half of b iff their boxes meet and a's corner lies below b's diagonal no
# farther than both sides allow: the sum of the coordinates of a's nearest point is at most that of its diagonal.
@query("j07_polygons_meet", """with b as (select s_suppkey as id, 30 + (s_suppkey * 7 % 40) / 8.0 as south, -120 + (s_suppkey * 11 % 48) / 8.0 as west, 0.25 + s_suppkey % 5 / 4.0 as side from supplier)
select a.id, b.id as id_b from b a join b on a.south <= b.south + b.side and a.south + a.side >= b.south and a.west <= b.west + b.side and a.west + a.side >= b.west
where greatest(a.south, b.south) + greatest(a.west, b.west) <= a.south + a.west + a.side
and least(a.south + a.side, b.south + b.side) + least(a.west + a.side, b.west + b.side) >= b.south + b.west + b.side
and b.south + b.west + b.side <= a.south + a.west + a.side""")
def j07_polygons(t: Tables):
    return J.polygons_meet(triangles(t, True), triangles(t, False))


@query("j08_nearest", f"with p as (select a.station_id, {HAV(a='a.', b='b.')} as km, b.station_id as other from fx_stations a join fx_stations b on a.station_id <> b.station_id and abs(a.lat - b.lat) < 0.3 and abs(a.lon - b.lon) < 0.5), m as (select station_id, min(km) as km from p where km <= 25 group by 1) select s.station_id, m.km as nearest_km from fx_stations s left join m using (station_id)", "nearest_km")
def j08(t: Tables):
    points = t.fx_stations.select("station_id", "lat", "lon")
    targets = points.withColumnRenamed("station_id", "target_id")
    return S.nearest(points, targets, 25.0, "station_id", "target_id").select("station_id", "nearest_km")


@query("j08_nearest_anywhere", f"select a.station_id, min({HAV(a='a.', b='b.')}) as nearest_km, arg_min(b.fips, (round({HAV(a='a.', b='b.')}, 9), b.fips)) as nearest_id from fx_stations a join (select *, centroid_lat as lat, centroid_lon * 3 as lon from fx_county where cast(fips as int) % 9 = 0) b on true group by 1", "nearest_km")
def j08_anywhere(t: Tables):
    """The nearest of far places, for some across the date line."""
    targets = t.fx_county.where("cast(fips as int) % 9 = 0").select("fips", F.col("centroid_lat").alias("lat"), (F.col("centroid_lon") * 3).alias("lon"))
    points = t.fx_stations.select("station_id", "lat", "lon").withColumn("own", F.col("station_id").cast("string"))
    return S.nearest_to(points, targets, "own", "fips").select("station_id", "nearest_km", "nearest_id")


@query("j09_not_yet_matched", "select fips from fx_county where state not in (select state from fx_coverage)")
def j09(t: Tables):
    return t.fx_county.join(t.fx_coverage, "state", "left_anti").select("fips")


@query("j10_keep_ids", "select event_id from fx_outages where fips in (select fips from fx_county where population > 10000)")
def j10(t: Tables):
    return t.fx_outages.join(t.fx_county.where("population > 10000"), "fips", "left_semi").select("event_id")


@query("j13_pairwise_overlap", f"with p as (select a.window_stratum, {_OVERLAP} as overlap from (select a.*, a.radius_km as r1, b.radius_km as r2, {HAV(a='a.center_', b='b.center_')} as d from fx_windows a join fx_windows b on a.ord < b.ord and abs(a.center_lat - b.center_lat) < 1.5) a where d < r1 + r2) select window_stratum, count(*) as pairs, max(overlap) as max_overlap, count(*) filter (where overlap > 0.25) as violations from p group by 1", "max_overlap")
def j13(t: Tables):
    pairs = S.overlapping_pairs(t.fx_windows)
    return pairs.groupBy(F.col("stratum_a").alias("window_stratum")).agg(F.count("*").alias("pairs"), F.max("overlap").alias("max_overlap"), F.count_if(F.col("overlap") > 0.25).alias("violations"))


@query("j14_active_hours", "with e as (select sim_id, event_id % 48 as s, event_id % 48 + duration_hours as t from fx_epicenters) select sim_id, h as hour, count(*) as n from e join (select unnest(range(0, 200)) as h) hours on h >= s and h < t group by 1, 2")
def j14(t: Tables):
    start = (F.col("event_id") % 48).cast("double")
    hours = O.active_hours(t.fx_epicenters, start, start + F.col("duration_hours")).where("hour < 200")
    return hours.groupBy("sim_id", F.col("hour").cast("long").alias("hour")).agg(F.count("*").alias("n"))


def members(t: Tables):
    return t.fx_nodes.where("capacity > 200").select(F.col("graph_id").alias("window_id"), "node_id", "capacity")


@query("j15_induced_edges", "select a.graph_id as window_id, src, dst from fx_edges e join fx_nodes a on a.node_id = src and a.capacity > 200 join fx_nodes b on b.node_id = dst and b.capacity > 200")
def j15(t: Tables):
    return J.induced_edges(t.fx_edges, members(t)).select("window_id", "src", "dst")


@query("j16_attach_label", "select n.node_id, coalesce(w.window_stratum, 'suburban') as stratum from fx_nodes n left join (select ord, window_stratum from fx_windows where window_stratum <> 'rural') w on w.ord = n.node_id")
def j16(t: Tables):
    labels = t.fx_windows.where("window_stratum <> 'rural'").select(F.col("ord").alias("node_id"), F.col("window_stratum").alias("stratum"))
    return O.left_lookup(t.fx_nodes, labels, ["node_id"], {"stratum": "suburban"}).select("node_id", "stratum")


@query("j17_feature_label_join", "select w.window_id, w.radius_km, c.y from fx_windows w left join (select window_id, avg(y_true) as y from fx_curves group by 1) c using (window_id)", "radius_km y")
def j17(t: Tables):
    labels = t.fx_curves.groupBy("window_id").agg(F.avg("y_true").alias("y"))
    return J.feature_label_join(t.fx_windows.select("window_id"), labels, t.fx_windows.select("window_id", "radius_km"))


@query("j18_lookup_state_year", "select event_id, coalesce(theta, 1.0) as multiplier from fx_outages left join fx_coverage using (state, year)", "multiplier")
def j18(t: Tables):
    table = t.fx_coverage.withColumnRenamed("theta", "multiplier")
    return O.left_lookup(t.fx_outages, table, ["state", "year"], {"multiplier": 1.0}).select("event_id", "multiplier")


@query("j19_ladder", "with c as (select fips, year, count(*) as n from fx_outages where duration_min > 400 group by 1, 2), s as (select state, year, count(*) as n from fx_outages where duration_min > 400 group by 1, 2), p as (select state, count(*) as n from fx_outages group by 1) select o.event_id, case when c.n > 0 then 'county' when s.n > 0 then 'state' when p.n > 0 then 'pooled' end as level, coalesce(c.n, s.n, p.n) as pool from fx_outages o left join c using (fips, year) left join s on s.state = o.state and s.year = o.year left join p on p.state = o.state")
def j19(t: Tables):
    severe = t.fx_outages.where("duration_min > 400")
    size = lambda d, *k: d.groupBy(*k).agg(F.count("*").alias("n"))
    pools = [("county", size(severe, "fips", "year"), ["fips", "year"]), ("state", size(severe, "state", "year"), ["state", "year"]), ("pooled", size(t.fx_outages, "state"), ["state"])]
    return J.ladder(t.fx_outages, pools).select("event_id", "level", "pool")


@query("j22_unit_counties", "select fips, coalesce(population, 0) as population from fx_county where centroid_lat between 31 and 40 and centroid_lon between -118 and -90 and state in (select state from fx_coverage)", "population")
def j22(t: Tables):
    inside = C.in_bbox(F.col("centroid_lat"), F.col("centroid_lon"), 31, -118, 40, -90)
    counties = t.fx_county.where(inside).join(t.fx_coverage, "state", "left_semi")
    return counties.select("fips", F.coalesce("population", F.lit(0.0)).alias("population"))


@query("j23_scenario_graph", "with s as (select distinct unit, family, concat(family, '_net') as variant from fx_sims) select unit, family, case when family = 'C' then 'missing' else 'found' end as status from s")
def j23(t: Tables):
    scenarios = t.fx_sims.select("unit", "family", F.concat("family", F.lit("_net")).alias("variant")).distinct()
    graphs = t.fx_sims.select(F.concat("family", F.lit("_net")).alias("variant")).where("variant <> 'C_net'").distinct()
    found, missing = J.scenario_graph(scenarios, graphs)
    return found.withColumn("status", F.lit("found")).unionByName(missing.withColumn("status", F.lit("missing"))).select("unit", "family", "status")


@query("j24_window_detail", "select graph_id as window_id, count(*) as n, sum(capacity) as total from fx_nodes where capacity > 200 group by 1", "total")
def j24(t: Tables):
    detail = J.window_detail(members(t).select("window_id").distinct(), members(t))
    total = F.aggregate("stations", F.lit(0.0), lambda a, s: a + s["capacity"])
    return detail.select("window_id", F.size("stations").cast("long").alias("n"), total.alias("total"))


@query("a57_disrupted_capacity", f"select e.event_id, sum(5 * n_l1 + 25 * n_l2 + 300 * n_dc) as capacity from fx_epicenters e join fx_stations s on s.state = e.graph_id and {HAV(a='e.', b='s.')} <= e.radius_km group by 1", "capacity")
def a57(t: Tables):
    caps = t.fx_stations.withColumn("capacity", C.capacity(F.col("n_l1"), F.col("n_l2"), F.col("n_dc")))
    return disk_sums(caps, event_disks(t), "event_id", ["capacity"], group="state").select("event_id", "capacity")


ATTACKS, PCTS = ["betweenness", "capacity", "random"], [5, 10, 20, 30, 40, 50, 60, 70, 80, 90]


@query("x01_curve_round_trip", "select window_id, attack, pct, y_true as y from fx_curves", "y")
def x01(t: Tables):
    return J.columns_to_curve(J.curve_to_columns(t.fx_curves, ATTACKS, PCTS))


@query("x02_curve_mean_peak", "select window_id, attack, avg(y_pred) as mean, max(y_pred) as peak, 1 - min(y_pred) as most_kept from fx_curves group by 1, 2", "mean peak most_kept")
def x02(t: Tables):
    out = J.curve_mean_peak(J.curve_vectors(t.fx_curves, ["window_id", "attack"], "y_pred"))
    return out.select("window_id", "attack", "mean", "peak", F.array_max("kept").alias("most_kept"))


@query("x03_states_in", "select cast(station_id % 50 as int) as g, string_agg(distinct state, ',' order by state) as states, min(state) as \"primary\" from fx_stations group by 1")
def x03(t: Tables):
    return J.states_in(t.fx_stations.withColumn("g", (F.col("station_id") % 50).cast("int")), "g", "state")


@query("x04_flatten_report", "select event_id, cast(json_extract_string(props, '$.k') as double) as k from events", "k")
def x04(t: Tables):
    return J.flatten_report(t.events, "props", {"k": ["$.metrics.k", "$.k"]}).select("event_id", "k")


@query("x05_history_lists", "select fips, count(*) as n, sum(duration_min / 60) as hours from fx_outages group by 1", "hours", 4)
def x05(t: Tables):
    lists = J.history_lists(t.fx_outages.withColumn("hours", F.col("duration_min") / 60.0), "fips")
    return lists.select("fips", F.size("history").cast("long").alias("n"), F.aggregate("history", F.lit(0.0), lambda a, h: a + h["hours"]).alias("hours"))


@query("x06_symmetrize", "select graph_id, src, dst, weight from fx_edges union all select graph_id, dst, src, weight from fx_edges", "weight")
def x06(t: Tables):
    back = t.fx_edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return J.symmetrize(t.fx_edges.unionAll(back))


_A = "from fx_sims where family = 'A'"


@query("q01_check_same", "select 'same' as name, 'fail' as status, max(greatest(abs(a.n_events - b.n_events), abs(a.n_hit - b.n_hit)))::double as value from fx_sims a join fx_sims b on a.unit = b.unit and a.year = b.year and a.sim_id = b.sim_id and a.family = 'A' and b.family = 'B'", "value")
def q01(t: Tables):
    a, b = t.fx_sims.where("family = 'A'"), t.fx_sims.where("family = 'B'")
    return J.check_same(a, b, ["unit", "year", "sim_id"], ["n_events", "n_hit"], 1e-9)


@query("q02_check_range", "select 'range' as name, case when m <= 0.02 or m >= 0.95 then 'fail' when m <= 0.05 or m >= 0.85 then 'warn' else 'pass' end as status, m as value from (select avg(n_hit / cast(n_events as double)) as m from fx_sims) q", "value")
def q02(t: Tables):
    return J.check_range(t.fx_sims.withColumn("p", F.col("n_hit") / F.col("n_events")), "p", (0.02, 0.95), (0.05, 0.85))


@query("q03_check_coverage", "select 'coverage' as name, case when m >= 0.9 then 'pass' else 'fail' end as status, m as value from (select avg(cast(state in (select state from fx_coverage) as int)) as m from fx_outages) q", "value")
def q03(t: Tables):
    return J.check_coverage(t.fx_outages, t.fx_coverage, ["state"], 0.9)


@query("q04_check_monotone", "select 'monotone' as name, case when count(*) = 0 then 'pass' else 'fail' end as status, count(*)::double as value from (select y_true < lag(y_true) over (partition by window_id, attack order by pct) as w from fx_curves) q where w", "value")
def q04(t: Tables):
    return J.check_monotone(t.fx_curves, ["window_id", "attack"], "pct", "y_true", True)


@query("q05_compare_tables", "select 'y_true' as \"column\", count(*) filter (where abs(y_true - y_pred) > 1e-9) as n from fx_curves union all select 'rows_missing', 0")
def q05(t: Tables):
    other = t.fx_curves.select("window_id", "attack", "pct", F.col("y_pred").alias("y_true"))
    return J.compare_tables(t.fx_curves, other, ["window_id", "attack", "pct"], ["y_true"], 1e-9)
