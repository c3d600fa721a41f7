"""Projections, filters and scalar functions on the outage, county, station and window tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators import filters as O
from stormgrid.plans.registry import Tables, query


@query("p01_to_number", "select event_id, coalesce(try_cast(replace(props, '{\"k\": ', '') as double), try_cast(value as double), 0.0) as x from events", "x")
def p01(t: Tables):
    raw = F.regexp_replace("props", r'\{"k": ', "")
    return t.events.select("event_id", F.coalesce(C.to_number(raw), C.to_number(F.col("value")), F.lit(0.0)).alias("x"))


@query("p02_capacity", "select station_id, 5 * n_l1 + 25 * n_l2 + 300 * n_dc as capacity from fx_stations", "capacity")
def p02(t: Tables):
    return t.fx_stations.select("station_id", C.capacity(F.col("n_l1"), F.col("n_l2"), F.col("n_dc")).alias("capacity"))


@query("p03_norm_fips", "select event_id, lpad(cast(user_id as varchar), 5, '0') as fips from events")
def p03(t: Tables):
    return t.events.select("event_id", C.norm_fips(F.col("user_id")).alias("fips"))


@query("p04_clean_key", "select event_id, lower(trim(county)) as plain, regexp_replace(lower(trim(county)), '\\s+', ' ', 'g') as collapsed from fx_outages")
def p04(t: Tables):
    c = F.col("county")
    return t.fx_outages.select("event_id", C.clean_key(c).alias("plain"), C.clean_key(c, True).alias("collapsed"))


@query("p05_event_times", "select event_id, start_time, start_time + to_microseconds(cast(round(duration_min * 60 * 1000000) as bigint)) as end_time, duration_min as minutes from fx_outages", "minutes")
def p05(t: Tables):
    df = O.add_event_times(t.fx_outages)
    return df.select("event_id", "start_time", "end_time", C.minutes_between(F.col("start_time"), F.col("end_time")).alias("minutes"))


@query("p06_drop_regions", "select event_id, state from fx_outages where state not in ('S1', 'S2')")
def p06(t: Tables):
    return O.drop_regions(t.fx_outages, ["S1", "S2"]).select("event_id", "state")


_SHARED = "select o.event_id, o.fips, o.state, o.duration_min, o.duration_min / 60 as hours, o.mean_customers, c.population, c.customers, least(1.0, greatest(0.0, o.mean_customers / c.population)) as share from fx_outages o join fx_county c using (fips) where o.duration_min > 0 and o.mean_customers > 0"


def shares(t: Tables):
    joined = t.fx_outages.join(t.fx_county.select("fips", "population", "customers"), "fips")
    return O.customer_share(joined).withColumn("hours", F.col("duration_min") / 60.0)


@query("p07_customer_share", f"select event_id, share from ({_SHARED}) s", "share")
def p07(t: Tables):
    return shares(t).select("event_id", "share")


@query("p08_share_of_total", "select event_id, mean_customers / customers as part from fx_outages join fx_county using (fips)", "part")
def p08(t: Tables):
    joined = t.fx_outages.join(t.fx_county.select("fips", "customers"), "fips")
    return joined.select("event_id", F.try_divide("mean_customers", "customers").alias("part"))


@query("p09_log_logit", f"select event_id, ln(duration_min + 0.1) as log_min, ln(p / (1 - p)) as logit from (select *, greatest(0.001, least(0.999, share)) as p from ({_SHARED}) s) q", "log_min logit")
def p09(t: Tables):
    log_min, logit = C.log_logit(F.col("duration_min"), F.col("share"))
    return shares(t).select("event_id", log_min.alias("log_min"), logit.alias("logit"))


@query("p10_zscore", "select fips, (area_km2 - (select avg(area_km2) from fx_county)) / (select stddev_samp(area_km2) from fx_county) as area_km2, (population - (select avg(population) from fx_county)) / (select stddev_samp(population) from fx_county) as population from fx_county", "area_km2 population")
def p10(t: Tables):
    return O.zscore(t.fx_county, ["area_km2", "population"]).select("fips", "area_km2", "population")


_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


@query("p11_haversine", f"select src, dst, {_HAV.format(a='a.', b='b.')} as km from fx_edges e join fx_nodes a on a.node_id = e.src join fx_nodes b on b.node_id = e.dst", "km")
def p11(t: Tables):
    return O.edge_ends(t.fx_edges, t.fx_nodes).select("src", "dst", C.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("km"))


@query("p12_project", "select station_id, radians(lon) * 6378137 as x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 as y from fx_stations", "x y", 3)
def p12(t: Tables):
    x, y = C.mercator_m(F.col("lat"), F.col("lon"))
    return t.fx_stations.select("station_id", x.alias("x"), y.alias("y"))


_OVERLAP = "case when d >= r1 + r2 then 0.0 when d <= abs(r1 - r2) then 1.0 else (r1 * r1 * acos(greatest(-1.0, least(1.0, (d * d + r1 * r1 - r2 * r2) / (2 * d * r1)))) + r2 * r2 * acos(greatest(-1.0, least(1.0, (d * d + r2 * r2 - r1 * r1) / (2 * d * r2)))) - 0.5 * sqrt(greatest(0.0, (r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)))) / (pi() * pow(least(r1, r2), 2)) end"
_DISKS = "select n_regionkey, o_orderkey, cast(10 + o_orderkey % 40 as double) as r1, cast(20 + o_custkey % 30 as double) as r2, cast(o_orderkey % 97 as double) as d from orders join nation on o_custkey % 25 = n_nationkey"


def disks(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", (10 + k % 40).cast("double").alias("r1"), (20 + c % 30).cast("double").alias("r2"), (k % 97).cast("double").alias("d"))


@query("p13_disk_overlap", f"select o_orderkey, {_OVERLAP} as share from ({_DISKS}) q", "share")
def p13(t: Tables):
    return disks(t).select("o_orderkey", C.disk_overlap(F.col("r1"), F.col("r2"), F.col("d")).alias("share"))


# Forty halvings in SQL would be as many nested texts: the answer is checked instead, as the overlap there and a little nearer.
@query("p14_min_separation_fits", f"select o_orderkey, true as fits from ({_DISKS}) q")
def p14_fits(t: Tables):
    near = disks(t).withColumn("km", C.min_separation("r1", "r2", 0.25))
    at, closer = (C.disk_overlap(F.col("r1"), F.col("r2"), F.col("km") + x) for x in (0.0, -1e-6))
    return near.select("o_orderkey", ((at <= 0.25 + 1e-9) & (closer > 0.25 - 1e-9)).alias("fits"))


@query("p14_min_separation")
def p14(t: Tables):
    return disks(t).select("o_orderkey", F.round(C.min_separation("r1", "r2", 0.25), 6).alias("km"))


@query("p15_windows_conflict", f"select o_orderkey, {_OVERLAP} > 0.25 as area_conflict, d < greatest(r1, r2) as centre_conflict from ({_DISKS}) q")
def p15(t: Tables):
    return disks(t).select("o_orderkey", O.windows_conflict(F.col("r1"), F.col("r2"), F.col("d"), "area", 0.25).alias("area_conflict"), O.windows_conflict(F.col("r1"), F.col("r2"), F.col("d"), "centre").alias("centre_conflict"))


@query("p16_point_in_ring", "select station_id, lat > 31 and lat < 40 and lon > -118 and lon < -90 and lat - 31 < (lon + 118) as inside from fx_stations")
def p16(t: Tables):
    ring = "array(named_struct('lon', -118D, 'lat', 31D), named_struct('lon', -109D, 'lat', 40D), named_struct('lon', -90D, 'lat', 40D), named_struct('lon', -90D, 'lat', 31D))"
    return t.fx_stations.select("station_id", C.in_ring("lat", "lon", ring).alias("inside"))


@query("p17_bbox", "select station_id, lat between 32 and 36 and lon between -115 and -100 as inside, lat <= 36 and lat + 1 >= 32 and lon <= -100 and lon + 2 >= -115 as meets from fx_stations")
def p17(t: Tables):
    lat, lon = F.col("lat"), F.col("lon")
    return t.fx_stations.select("station_id", C.in_bbox(lat, lon, 32, -115, 36, -100).alias("inside"), C.bbox_meets(lat, lon, lat + 1, lon + 2, (32, -115, 36, -100)).alias("meets"))


@query("p18_stratum", """with v as (select c_custkey, (c_custkey % 45) / 4.0 as code, case when c_custkey % 7 = 0 then 'nan'::double when c_custkey % 7 = 1 then null else c_acctbal / 10000 end as share from customer)
select c_custkey, case when round_even(code, 0) <= 3 then 'urban' when round_even(code, 0) <= 6 then 'suburban' else 'rural' end as ruca,
case when share is null or isnan(share) then 'suburban' when share >= 0.75 then 'urban' when share <= 0.10 then 'rural' else 'suburban' end as share from v""")
def p18(t: Tables):
    k = F.col("c_custkey")
    share = F.when(k % 7 == 0, float("nan")).when(k % 7 != 1, F.col("c_acctbal") / 10000)
    return t.customer.select("c_custkey", C.stratum_from_ruca((k % 45) / 4.0).alias("ruca"), C.stratum_from_urban_share(share).alias("share"))


@query("p19_stratum_from_radius", "select window_id, window_stratum as stratum from fx_windows")
def p19(t: Tables):
    return t.fx_windows.select("window_id", C.stratum_from_radius(F.col("radius_km") + 0.4).alias("stratum"))


@query("p20_classify_location", f"""with s as (select *, case when station_id % 40 = 0 then case (station_id // 40) % 3 when 0 then 'urban' when 1 then 'suburban' else 'rural' end end as known from fx_stations),
near as (select a.station_id, arg_min(b.known, ({_HAV.format(a='a.', b='b.')}, b.station_id)) as beside from s a join s b on b.known is not null and {_HAV.format(a='a.', b='b.')} <= 50 where a.known is null group by 1),
dense as (select a.station_id, count(*) filter (where {_HAV.format(a='a.', b='b.')} <= 10) as near, count(*) as wide from s a join s b on {_HAV.format(a='a.', b='b.')} <= 30 group by 1)
select s.station_id, coalesce(known, beside, case when d.near >= 15 then 'urban' when d.wide >= 15 then 'suburban' end, 'rural') as label, case when known is not null then 'own' when beside is not null then 'station' else 'density' end as method
from s join dense d using (station_id) left join near using (station_id)""")
def p20(t: Tables):
    k = F.col("station_id")
    kind = F.element_at(F.array(F.lit("urban"), F.lit("suburban"), F.lit("rural")), (F.floor(k / 40) % 3 + 1).cast("int"))
    labelled = t.fx_stations.withColumn("known", F.when(k % 40 == 0, kind))
    return O.classify_location(labelled, labelled, "station_id", "known").select("station_id", "label", "method")


@query("p20_nearest_window", f"""with c as (select fips, centroid_lat + cast(fips as int) % 13 / 10.0 as lat, centroid_lon - cast(fips as int) % 17 / 5.0 as lon from fx_county),
d as (select c.fips, arg_min(w.window_stratum, ({_HAV.format(a='w.center_', b='c.')}, w.window_id)) as label from c join fx_windows w on true group by 1) select fips, label, 'window' as method from d""")
def p20_window(t: Tables):
    """Without any station the nearest window decides, however far it is."""
    k = F.col("fips").cast("int")
    places = t.fx_county.select("fips", (F.col("centroid_lat") + k % 13 / 10.0).alias("lat"), (F.col("centroid_lon") - k % 17 / 5.0).alias("lon"), F.lit(None).cast("string").alias("known"))
    none = t.fx_stations.where("false").select(F.lit("").alias("fips"), "lat", "lon", F.lit("").alias("known"))
    return O.classify_location(places, none, "fips", "known", t.fx_windows).select("fips", "label", "method")


@query("p21_split_node_id", "select s_name, split_part(s_name, '#', 1) as head, cast(split_part(s_name, '#', 2) as bigint) as local_id from supplier")
def p21(t: Tables):
    head, number = O.split_id(F.col("s_name"), r"^(\w+)#(\d+)$")
    return t.supplier.select("s_name", head.alias("head"), number.alias("local_id"))


_CODES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY PR ZZ"


@query("p22_region_of", f"""with c as (select c_custkey, string_split('{_CODES}', ' ')[1 + c_custkey % 53] as code from customer)
select c_custkey, code, case when code in ('CT', 'DE', 'DC', 'MA', 'MD', 'ME', 'NH', 'NJ', 'NY', 'PA', 'RI', 'VT') then 'northeast' when code in ('IA', 'IL', 'IN', 'KS', 'MI', 'MN', 'MO', 'ND', 'NE', 'OH', 'SD', 'WI') then 'midwest'
when code in ('AL', 'AR', 'FL', 'GA', 'KY', 'LA', 'MS', 'NC', 'OK', 'SC', 'TN', 'TX', 'VA', 'WV') then 'south'
when code in ('AK', 'AZ', 'CA', 'CO', 'HI', 'ID', 'MT', 'NM', 'NV', 'OR', 'UT', 'WA', 'WY') then 'west' else 'other' end as region from c""")
def p22(t: Tables):
    code = F.element_at(F.array(*map(F.lit, _CODES.split())), (F.col("c_custkey") % 53 + 1).cast("int"))
    return t.customer.select("c_custkey", code.alias("code"), C.region_of(code).alias("region"))


_NAMES = ["Texas", " new york", "N. Dakota", "West Virginia", "ca", "UNK", "", "District of Columbia", "Hawaii", "Wash.", "oh", "M", "Rhode Island ", "Guam"]
_WANT = ["TX", "NY", "N.", "WV", "CA", "UNK", "UNK", "DC", "HA", "WA", "OH", "M", "RI", "GU"]


@query("p22_state_code", f"select c_custkey, {_WANT}[1 + c_custkey % {len(_WANT)}] as code from customer")
def p22_code(t: Tables):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % len(_NAMES) + 1).cast("int"))
    return t.customer.select("c_custkey", C.state_code(name).alias("code"))


@query("p23_impact_radius", "select event_id, least(150.0, greatest(5.0, sqrt(least(mean_customers / greatest(1e-3, least(1.0, coalesce(theta, 1.0))), c.customers) / (greatest(c.customers / area_km2, 1e-6) * pi())))) as km from fx_outages o join fx_county c using (fips) left join fx_coverage v on o.state = v.state and o.year = v.year", "km")
def p23(t: Tables):
    df = t.fx_outages.join(t.fx_county.drop("state"), "fips").join(t.fx_coverage, ["state", "year"], "left")
    rho = F.col("customers") / F.col("area_km2")
    return df.select("event_id", C.impact_radius(F.col("mean_customers"), F.col("theta"), rho, F.col("customers"), 5, 150).alias("km"))


_SCEN = "(select 'baseline' as scenario, 1.0 as radius_scale, 1.0 as duration_scale, cast(null as double) as urban_scale union all select 'sev_m20', 0.8, 1.0, null union all select 'urban_p30', 1.0, 1.2, 1.3)"


@query("p24_apply_scenario", f"select event_id, scenario, radius_km * case when urban then coalesce(urban_scale, radius_scale) else radius_scale end as radius_km, duration_hours * duration_scale as duration_hours from (select *, graph_id in ('S1', 'S3') as urban from fx_epicenters) e cross join {_SCEN} s", "radius_km duration_hours")
def p24(t: Tables):
    events = t.fx_epicenters.withColumn("urban", F.col("graph_id").isin("S1", "S3"))
    rows = [("baseline", 1.0, 1.0, None), ("sev_m20", 0.8, 1.0, None), ("urban_p30", 1.0, 1.2, 1.3)]
    scenarios = t.spark.createDataFrame(rows, "scenario string, radius_scale double, duration_scale double, urban_scale double")
    return O.apply_scenario(events, scenarios).select("event_id", "scenario", "radius_km", "duration_hours")


@query("p25_recovery_loss", "select event_id, radius_km * duration_hours as constant, case when duration_hours > 0 then radius_km * duration_hours / 2 * (1 - exp(-2.0)) else 0.0 end as exponential from fx_epicenters", "constant exponential")
def p25(t: Tables):
    a = F.col("radius_km"), F.col("duration_hours")
    return t.fx_epicenters.select("event_id", C.recovery_loss(*a, "constant").alias("constant"), C.recovery_loss(*a, "exponential").alias("exponential"))


def _flag_sql(pairs):
    return ", ".join(f"cast({test} as int) as {name}" for name, test in pairs)


FLAGS = [(f"dur_{h}h", f"hours >= {h}") for h in (2, 4, 8, 12, 24)] + [(f"pct_{p}", f"share >= {p / 100}") for p in (1, 2, 5, 10)]
FLAGS += [(f"abs_{n}", f"mean_customers >= {n}") for n in (100, 1000, 10000)]
FLAGS += [(f"dur_{h}h_pct_{p}", f"hours >= {h} and share >= {p / 100}") for h in (4, 8, 12) for p in (1, 5)]


@query("p26_severity_flags", f"select event_id, {_flag_sql(FLAGS)} from ({_SHARED}) s")
def p26(t: Tables):
    flags = C.severity_flags(F.col("hours"), F.col("share"), F.col("mean_customers"))
    return shares(t).select("event_id", *(c.alias(k) for k, c in flags.items()))


TIER_SQL = _flag_sql([(k, f"hours >= {h} and share >= {p}") for k, (h, p) in C.TIERS.items()])


@query("p27_severity_tiers", f"select event_id, {TIER_SQL} from ({_SHARED}) s")
def p27(t: Tables):
    tiers = C.severity_tiers(F.col("hours"), F.col("share"))
    return shares(t).select("event_id", *(c.alias(k) for k, c in tiers.items()))


GRID = [(f"t{h}_a{a}_p{p}", f"hours > {h} and (mean_customers > {a} or share > {p / 100})") for h in (4, 8, 12) for a in (500, 1000, 5000) for p in (1, 2, 5)]


@query("p28_severity_grid", f"select event_id, {_flag_sql(GRID)} from ({_SHARED}) s")
def p28(t: Tables):
    grid = C.severity_grid(F.col("hours"), F.col("mean_customers"), F.col("share"))
    return shares(t).select("event_id", *(c.alias(k) for k, c in grid.items()))


@query("p29_hash_seed", "select event_id, cast('0x' || substr(md5(concat_ws('|', user_id, event_type, event_id)), 1, 8) as bigint) as seed from events")
def p29(t: Tables):
    return t.events.select("event_id", C.hash_seed(F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("seed"))


@query("p30_event_date", "select event_id, cast(make_date(year, 1, 1) + cast(event_id % 365 as int) as date) as day from fx_outages")
def p30(t: Tables):
    return t.fx_outages.select("event_id", C.event_date(F.col("year"), F.col("event_id") % 365 + 1).alias("day"))


@query("p31_fips_vintage", "select fips, fips like '09%' and fips not in ('09001', '09003', '09005', '09007', '09009', '09011', '09013', '09015') as wrong from fx_county")
def p31(t: Tables):
    return t.fx_county.select("fips", O.wrong_vintage(F.col("fips")).alias("wrong"))


@query("p32_corr_strength", "select event_id, case when abs(r) < 0.1 then 'negligible' when abs(r) < 0.3 then 'weak' when abs(r) < 0.5 then 'moderate' when abs(r) < 0.7 then 'strong' else 'very strong' end as strength from (select event_id, cast(event_id % 201 - 100 as double) / 100 as r from events) q")
def p32(t: Tables):
    r = (F.col("event_id") % 201 - 100).cast("double") / 100.0
    return t.events.select("event_id", C.corr_strength(r).alias("strength"))


@query("p33_interp_efficiency", """
with samples as (select graph_id, cast(row_number() over (partition by graph_id order by capacity, node_id) * 3 + 2 as double) as x, lat / 100 as y from fx_nodes where node_id % 31 <> 0),
segments as (select graph_id, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from samples window w as (partition by graph_id order by x)),
ends as (select graph_id, min(x) as least, max(x) as most, max(y) as best, min(y) as worst from samples group by 1),
base as (select graph_id, count(*) as n, 0.5 as baseline from fx_nodes group by 1),
asked as (select graph_id, node_id, cast(node_id % 140 as double) as x from fx_nodes),
hits as (select a.node_id, s.*, row_number() over (partition by a.node_id order by s.x0 desc) as k from asked a join segments s on a.graph_id = s.graph_id and s.x0 <= a.x)
select a.node_id, case when x = 0 or least is null then baseline when x < least then baseline - (baseline - best) * x / least when x > most then greatest(0, worst * (1 - (x - most) / n))
  when x1 is null then y0 else y0 + (y1 - y0) * (x - x0) / (x1 - x0) end as y
from asked a join base using (graph_id) left join ends using (graph_id) left join hits h on h.node_id = a.node_id and k = 1""", "y")
def p33(t: Tables):
    """Removals from none to far above the last sample."""
    rank = F.row_number().over(O.by("graph_id", "capacity", "node_id"))
    samples = t.fx_nodes.where("node_id % 31 <> 0").select("graph_id", (rank * 3 + 2).cast("double").alias("x"), (F.col("lat") / 100).alias("y"))
    asked = t.fx_nodes.select("graph_id", "node_id", (F.col("node_id") % 140).cast("double").alias("x"))
    base = t.fx_nodes.groupBy("graph_id").agg(F.count("*").alias("n"), F.lit(0.5).alias("baseline"))
    return O.efficiency_at(asked, samples, base, "graph_id").select("node_id", "y")


@query("p34_degree_proxy_loss", "select event_id, least(1.0, pow((event_id % 50) / 49.0, 0.8)) * duration_hours as loss from fx_epicenters", "loss")
def p34(t: Tables):
    return t.fx_epicenters.select("event_id", C.degree_proxy_loss((F.col("event_id") % 50).cast("double"), F.lit(49.0), F.col("duration_hours")).alias("loss"))


@query("p35_select_curves", "select window_id, attack, pct, y_true from fx_curves where attack in ('betweenness', 'random') and pct in (5, 10, 20)", "y_true")
def p35(t: Tables):
    return O.select_curves(t.fx_curves, "no-capacity", 3).select("window_id", "attack", "pct", "y_true")


@query("p36_event_filters", "select event_id from fx_outages where duration_min >= 30 and duration_min <= 600 and mean_customers >= 20 and state not in ('S4')")
def p36(t: Tables):
    return O.event_filters(t.fx_outages, min_minutes=30, max_minutes=600, min_customers=20, excluded=["S4"]).select("event_id")


@query("p37_data_consistency", "select fips from fx_county where area_km2 is not null and fips in (select fips from fx_outages) and state in (select state from fx_coverage)")
def p37(t: Tables):
    covered = t.fx_county.join(t.fx_coverage.select("state").distinct(), "state", "left_semi")
    return O.consistent_keys(["fips"], t.fx_county.dropna(subset=["area_km2"]), t.fx_outages, covered)


@query("p38_keep_year", "select event_id, start_time from fx_outages where year(start_time) = 2024")
def p38(t: Tables):
    return O.keep_year(t.fx_outages, 2024).select("event_id", "start_time")


@query("p39_prepare_history", "select event_id, fips, year, coalesce(duration_min / 60, 1.0) as hours, mean_customers * coalesce(duration_min / 60, 1.0) as aco from fx_outages", "hours aco")
def p39(t: Tables):
    return O.prepare_history(t.fx_outages).select("event_id", "fips", "year", "hours", "aco")


@query("p40_main_lines", "select p_partkey, p_type from part where p_type in ('ECONOMY', 'PROMO') and p_size between 5 and 30")
def p40(t: Tables):
    return O.lines_in_box(t.part, "p_type", r"^(ECONOMY|PROMO)$", F.col("p_size").between(5, 30)).select("p_partkey", "p_type")


@query("p41_state_from_name", "select distinct state, year from (select concat('S', cast(user_id % 10 as varchar)) as state, 2018 + event_id % 6 as year from events) q")
def p41(t: Tables):
    names = t.fx_outages.select(F.concat(F.lit("/x/outages_"), "state", F.lit("_"), "year", F.lit(".csv")).alias("path")).distinct()
    state, year = O.split_id(F.col("path"), r"_(\w+?)_(\d{4})\.csv$")
    return names.select(state.alias("state"), year.alias("year"))


@query("p42_min_nodes", "select graph_id, count(*) as n from fx_nodes group by 1 having count(*) >= 16")
def p42(t: Tables):
    return O.min_nodes(t.fx_nodes.groupBy("graph_id").agg(F.count("*").alias("n")), 16)
