"""Windows, order, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.operators import ranking as O
from stormgrid.plans.registry import Tables, query

_UNITS = "select unit, family, year, avg(loss) as loss, sum(n_hit) / sum(n_events) as p_hit, max(n_events) as most from fx_sims group by 1, 2, 3"


def units(t: Tables):
    return t.fx_sims.groupBy("unit", "family", "year").agg(
        F.avg("loss").alias("loss"), (F.sum("n_hit") / F.sum("n_events")).alias("p_hit"), F.max("n_events").alias("most")
    )


@query("w02_rank_trajectories", f"select unit, family, year, row_number() over (partition by family, year order by loss desc, unit) as rank from ({_UNITS}) u")
def w02(t: Tables):
    return O.rank_within(units(t), ["family", "year"], F.desc("loss"), "unit").select("unit", "family", "year", F.col("rank").cast("long").alias("rank"))


@query("w03_avg_rank", f"select unit, family, year, rank() over (partition by family, year order by most) + (count(*) over (partition by family, year, most) - 1) / 2.0 as rank from ({_UNITS}) u", "rank")
def w03(t: Tables):
    return units(t).withColumn("rank", O.avg_rank("most", ["family", "year"])).select("unit", "family", "year", "rank")


@query("w04_multi_rank_score", f"""with r as (select *, 0.4 * rank() over (partition by family, year order by round(loss, 4)) + 0.3 * (rank() over (partition by family, year order by most) + (count(*) over (partition by family, year, most) - 1) / 2.0) as score from ({_UNITS}) u)
select unit, family, year, score, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0 end as risk from r window w as (partition by family, year)""", "score risk")
def w04(t: Tables):
    df = units(t).withColumn("loss", F.round("loss", 4))
    return O.multi_rank_score(df, {"loss": 0.4, "most": 0.3}, ["family", "year"]).select("unit", "family", "year", "score", "risk")


@query("w05_top_fraction", "select event_id, state from (select *, row_number() over (partition by state order by duration_min desc, event_id) as k, greatest(1, ceil(count(*) over (partition by state) * 0.1)) as n from fx_outages) q where k <= n")
def w05(t: Tables):
    return O.top_fraction(t.fx_outages, ["state"], 0.1, F.desc("duration_min"), "event_id").select("event_id", "state")


@query("w06_urban_flag", "select fips, customers / area_km2 >= (select quantile_cont(customers / area_km2, 0.75) from fx_county) as urban from fx_county")
def w06(t: Tables):
    return O.above_percentile(t.fx_county, F.col("customers") / F.col("area_km2"), 0.75, "urban").select("fips", "urban")


@query("w07_quadrant", "select fips, concat_ws('_', case when area_km2 >= (select median(area_km2) from fx_county) then 'high' else 'low' end, case when population >= (select median(population) from fx_county) then 'high' else 'low' end) as quadrant from fx_county")
def w07(t: Tables):
    return O.quadrant(t.fx_county, "area_km2", "population").select("fips", "quadrant")


@query("w08_group_mean", "select event_id, mean_customers / avg(mean_customers) over (partition by fips) as ratio from fx_outages", "ratio")
def w08(t: Tables):
    return O.group_ratio(t.fx_outages, ["fips"], "mean_customers", "ratio").select("event_id", "ratio")


@query("w09_cumulative_curve", "select graph_id, k, total from (select graph_id, row_number() over w as k, sum(capacity) over (partition by graph_id order by capacity desc, node_id rows unbounded preceding) as total, count(*) over (partition by graph_id) as n from fx_nodes window w as (partition by graph_id order by capacity desc, node_id)) q where (k - 1) % 5 = 0 or k = n", "total")
def w09(t: Tables):
    return O.cumulative_curve(t.fx_nodes, ["graph_id"], "capacity", 5, F.desc("capacity"), "node_id").select("graph_id", F.col("k").cast("long").alias("k"), "total")


@query("w10_curve_auc", "with l as (select window_id, attack, (pct - lag(pct) over w) * (y_true + lag(y_true) over w) / 2 as area from fx_curves window w as (partition by window_id, attack order by pct)) select window_id, attack, sum(area) as auc from l group by 1, 2", "auc")
def w10(t: Tables):
    return O.curve_auc(t.fx_curves, ["window_id", "attack"], "pct", "y_true")


@query("w11_number_events", "select sim_id, event_id, row_number() over (partition by sim_id order by event_id) - 1 as number from fx_epicenters")
def w11(t: Tables):
    return O.number_rows(t.fx_epicenters, ["sim_id"], "event_id").select("sim_id", "event_id", F.col("number").cast("long").alias("number"))


@query("w12_first_per_key", "select fips, event_id from (select fips, event_id, row_number() over (partition by fips order by start_time, event_id) as k from fx_outages) q where k = 1")
def w12(t: Tables):
    return O.first_per_key(t.fx_outages, ["fips"], "start_time", "event_id").select("fips", "event_id")


@query("w13_first_rank", "select * from (select fips, row_number() over (partition by state order by area_km2 desc, fips) as rank_area_km2, row_number() over (partition by state order by population desc, fips) as rank_population from fx_county) q where least(rank_area_km2, rank_population) <= 3")
def w13(t: Tables):
    df = O.first_ranks(t.fx_county, ["state"], ["area_km2", "population"], 3, "fips")
    return df.select("fips", F.col("rank_area_km2").cast("long").alias("rank_area_km2"), F.col("rank_population").cast("long").alias("rank_population"))


@query("l01_top_k", "select window_id, attack, pct, y_pred from fx_curves order by y_pred desc, window_id, attack, pct limit 50", "y_pred")
def l01(t: Tables):
    return O.top_k(t.fx_curves, "y_pred", 50, "window_id", "attack", "pct").select("window_id", "attack", "pct", "y_pred")


@query("l02_order_by_list", "select station_id, coalesce(nullif(list_position(['S3', 'S1', 'S9'], state), 0), 4) as place, row_number() over (order by coalesce(nullif(list_position(['S3', 'S1', 'S9'], state), 0), 4), station_id) as k from fx_stations")
def l02(t: Tables):
    placed = t.fx_stations.withColumn("place", O.list_position("state", ["S3", "S1", "S9"]).cast("int"))
    ordered = O.rank_within(placed.withColumn("one", F.lit(1)), ["one"], "place", "station_id")
    return ordered.select("station_id", "place", F.col("rank").cast("long").alias("k"))


_U = "cast('0x' || substr(md5(concat_ws('|', {})), 1, 8) as bigint) / 4294967296.0"


@query("l03_sample_n", f"select state, station_id from (select state, station_id, row_number() over (partition by state order by {_U.format(chr(39) + 'a' + chr(39) + ', station_id')}, station_id) as k from fx_stations) q where k <= 20")
def l03(t: Tables):
    return O.sample_n(t.fx_stations, 20, "a", ["state"], "station_id").select("state", "station_id")


@query("l04_stratified_split", f"select window_id, case when k <= greatest(1, round_even(n * 0.2, 0)) then 'test' else 'train' end as split from (select window_id, row_number() over (partition by window_stratum order by {_U.format(chr(39) + 's' + chr(39) + ', ord')}, ord) as k, count(*) over (partition by window_stratum) as n from fx_windows) q")
def l04(t: Tables):
    return O.stratified_split(t.fx_windows, "window_stratum", 0.2, "s", "ord").select("window_id", "split")


@query("l05_geo_split", "with f as (select state as fold from fx_windows group by 1 having count(*) >= 20) select window_id, fold, case when state = fold then 'test' else 'train' end as split, center_lon > -100 as east from fx_windows cross join f")
def l05(t: Tables):
    return O.state_folds(t.fx_windows, 20).select("window_id", "fold", "split", (F.col("center_lon") > -100).alias("east"))


_OF_STATE = "split_part('CA TX NY MD DE IA OH ME FL ZZ', ' ', 1 + cast(state[2:] as int))"


@query("l05_region_holdout", f"select window_id, {_OF_STATE} as code, case when {_OF_STATE} in ('NY', 'MD', 'DE', 'ME') then 'test' else 'train' end as split from fx_windows")
def l05_region(t: Tables):
    code = F.split_part(F.lit("CA TX NY MD DE IA OH ME FL ZZ"), F.lit(" "), F.expr("1 + cast(substring(state, 2) as int)"))
    return O.region_holdout(t.fx_windows.withColumn("code", code), "code", "northeast").select("window_id", "code", "split")


@query("l06_state_holdout")
def l06(t: Tables):
    chosen = O.state_holdout(t.fx_windows, "window_stratum", 0.3)
    return t.fx_windows.select("window_id", "state", F.col("state").isin(chosen).alias("held_out"))


@query("l11_tier_targets", "with s as (select window_stratum, count(*) / cast((select count(*) from fx_windows) as double) as share, row_number() over (order by window_stratum) as ord from fx_windows group by 1), r as (select *, cast(round_even(share * 1000, 0) as bigint) as target from s) select window_stratum, cast(target + case when ord = 1 then 1000 - (select sum(target) from r) else 0 end as bigint) as target from r")
def l11(t: Tables):
    counts = t.fx_windows.groupBy("window_stratum").agg(F.count("*").alias("n"))
    all_rows = t.fx_windows.agg(F.count("*").alias("all"))
    shares = counts.crossJoin(all_rows).withColumn("share", F.col("n") / F.col("all")).withColumn("one", F.lit(1))
    ranked = O.rank_within(shares, ["one"], "window_stratum").withColumnRenamed("rank", "ord")
    return O.tier_targets(ranked, 1000).select("window_stratum", "target")


@query("l13_thin_evenly", "with r as (select state, station_id, row_number() over (partition by state order by station_id) - 1 as k, count(*) over (partition by state) as n from fx_stations) select state, station_id from r where n <= 11 or k in (select unnest(list_transform(range(11), lambda i: cast(floor(i * (n - 1) / 10) as bigint))))")
def l13(t: Tables):
    return O.thin_evenly(t.fx_stations, ["state"], 11, "station_id").select("state", "station_id")


@query("u01_union_years", "select year, count(*) as n from fx_outages group by 1")
def u01(t: Tables):
    old, new = t.fx_outages.where("year <= 2020"), t.fx_outages.where("year > 2020")
    return old.unionByName(new).groupBy("year").agg(F.count("*").alias("n"))


@query("u02_distinct_rows", "select distinct state, fips, year from fx_outages")
def u02(t: Tables):
    return t.fx_outages.select("state", "fips", "year").distinct()


@query("u03_intersect_keys", "select state from fx_county intersect select state from fx_coverage")
def u03(t: Tables):
    return t.fx_county.select("state").intersect(t.fx_coverage.select("state"))


@query("u04_except_keys", "select distinct state from fx_county except select state from fx_coverage")
def u04(t: Tables):
    return t.fx_county.select("state").subtract(t.fx_coverage.select("state"))


@query("u05_disjoint_union", "select graph_id as member, node_id, split_part(graph_id, '_', 1) as unit, row_number() over (partition by split_part(graph_id, '_', 1) order by graph_id, node_id) as unit_node from fx_nodes")
def u05(t: Tables):
    plan = t.fx_nodes.select("graph_id").distinct().withColumn("unit", F.split_part("graph_id", F.lit("_"), F.lit(1)))
    return O.disjoint_union(t.fx_nodes, plan).select("member", "node_id", "unit", F.col("unit_node").cast("long").alias("unit_node"))


@query("u05_merge_units", """with recursive n as (select state, count(*) as n from fx_county where state <> 'S0' group by 1),
p as (select distinct state, 'west' as unit from fx_county where state in ('S1', 'S4')),
o as (select state, n from n anti join p using (state)),
b as (select a.state, arg_min(c.state, (c.n, c.state)) as partner from o a join o c on a.state <> c.state and abs(cast(substr(a.state, 2) as int) - cast(substr(c.state, 2) as int)) <= 2 where a.n < (select avg(n) + 1 from n) group by 1),
w as (select state, partner, row_number() over (order by state) as k from b where partner > state),
r as (select 0::bigint as k, []::varchar[] as c, []::varchar[] as m union all
  select w.k, case when list_contains(c, w.state) or list_contains(c, w.partner) then c else list_concat(c, [w.state, w.partner]) end, case when list_contains(c, w.state) or list_contains(c, w.partner) then m else list_append(m, w.state) end from r join w on w.k = r.k + 1),
g as (select w.state, w.partner from w where list_contains((select arg_max(m, k) from r), w.state)),
u as (select state || '_' || partner as unit, unnest([state, partner]) as state from g)
select unit, state from p union all select unit, state from u union all select state, state from o anti join u using (state)""")
def u05m(t: Tables):
    from stormgrid.operators.networks import merge_units

    sizes = t.fx_county.where("state <> 'S0'").groupBy("state").agg(F.count("*").alias("n"))
    plan = t.fx_county.where("state in ('S1', 'S4')").select("state").distinct().withColumn("unit", F.lit("west"))
    number = F.substring("state", 2, 9).cast("int")
    other = sizes.select(F.col("state").alias("neighbour"), number.alias("k"))
    near = sizes.select("state", F.explode(F.array(*(number + d for d in (-2, -1, 1, 2)))).alias("k")).join(other, "k")
    least = sizes.agg((F.avg("n") + 1).alias("least")).first()["least"]
    return merge_units(sizes, near.select("state", "neighbour"), plan, least)


@query("u06_dedupe_scenarios", "select family, year, unit from (select *, row_number() over (partition by family, year order by unit) as k from fx_sims where family in ('A', 'B')) q where k = 1")
def u06(t: Tables):
    return O.first_per_key(t.fx_sims.where(F.col("family").isin("A", "B")), ["family", "year"], "unit").select("family", "year", "unit")


@query("u07_design_matrix", "with u as (select distinct unit from fx_sims), y as (select distinct year from fx_sims) select unit, 'A' as family, year as net_year, year as out_year from u, y union all select unit, 'B', 2023, year from u, y where year <> 2023 union all select unit, 'C', year, null from u, y")
def u07(t: Tables):
    return O.design_matrix(t.fx_sims.select("unit").distinct(), t.fx_sims.select("year").distinct(), 2023)
