"""Losses of simulations, dose response, reliability, curves and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.operators import losses as O
from stormgrid.operators.ranking import quadrant
from stormgrid.plans.registry import Tables, query

def _avg_rank(column, keys):
    return f"rank() over (partition by {keys} order by {column}) + (count(*) over (partition by {keys}, {column}) - 1) / 2.0"


_MEANS = "select unit, family, year, round(avg(loss), 4) as loss, round(avg(n_hit), 6) as hits from fx_sims group by 1, 2, 3"


def means(t: Tables):
    return t.fx_sims.groupBy("unit", "family", "year").agg(F.round(F.avg("loss"), 4).alias("loss"), F.round(F.avg("n_hit"), 6).alias("hits"))


@query("a09_spearman", f"with r as (select family, year, {_avg_rank('loss', 'family, year')} as x, {_avg_rank('hits', 'family, year')} as y from ({_MEANS}) m) select family, year, corr(x, y) as rho, count(*) as n from r group by 1, 2 having count(*) >= 3", "rho")
def a09(t: Tables):
    return O.spearman(means(t), ["family", "year"], "loss", "hits")


@query("a10_quantile_bins", "with c as (select quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts from events) select len(list_filter(cuts, lambda x: x < value)) as bin, median(value) as median, avg(value) as mean, stddev_samp(value) as std, count(*) as n from events, c group by 1", "median mean std")
def a10(t: Tables):
    return O.quantile_bins(t.events, "value", "value", 10).withColumn("bin", F.col("bin").cast("long"))


@query("a11_width_bins", "select case when value > 0 and value <= 5 then 5.0 when value > 5 and value <= 20 then 20.0 when value > 20 and value <= 100 then 100.0 end as upper, avg(value) as mean, count(*) as n from events where value > 0 and value <= 100 group by 1", "upper mean")
def a11(t: Tables):
    binned = t.events.withColumn("upper", O.width_bin(F.col("value"), [0, 5, 20, 100])).where("upper is not null")
    return binned.groupBy("upper").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("a12_histogram", "select event_type, case when value < 10 then 0 when value < 50 then 1 else 2 end as bin, count(*) as n from events where value >= 0 and value <= 200 group by 1, 2")
def a12(t: Tables):
    return O.histogram(t.events, ["event_type"], "value", [0, 10, 50, 200])


_EV = "(select graph_id, sim_id, event_id, radius_km, case when event_id % 3 = 0 then duration_hours / 7 else 0.0 end as loss, 24 as n_nodes from fx_epicenters)"


def events(t: Tables):
    loss = F.when(F.col("event_id") % 3 == 0, F.col("duration_hours") / 7).otherwise(0.0)
    return t.fx_epicenters.select("graph_id", "sim_id", "event_id", "radius_km", loss.alias("loss"), F.lit(24).alias("n_nodes"))


@query("a13_sim_metrics", f"select graph_id, sim_id, count(*) as n_events, count(*) filter (where loss > 0) as n_hit, avg(loss) as l_event, avg(loss) filter (where loss > 0) as loss_given_hit, sum(loss) as total, max(radius_km) as max_radius, max(n_nodes) as n_nodes, count(*) filter (where loss > 0) / cast(count(*) as double) as p_hit, sum(loss) / max(n_nodes) as l_tilde from {_EV} e group by 1, 2", "l_event loss_given_hit total max_radius p_hit l_tilde")
def a13(t: Tables):
    return O.sim_metrics(events(t))


@query("a14_conditional_loss", "with c as (select unit, family, median(n_events) as mid, quantile_cont(n_events, 0.75) as high from fx_sims group by 1, 2) select unit, family, avg(case when n_events <= mid then loss end) as loss_low, avg(case when n_events >= high then loss end) as loss_high from fx_sims join c using (unit, family) group by 1, 2", "loss_low loss_high", 7)
def a14(t: Tables):
    return O.conditional_loss(t.fx_sims, ["unit", "family"], "n_events", "loss")


@query("a15_yearly_loss", "select unit, avg(total) as mean_total, avg(mean) as mean_mean, sum(total) as pooled from (select unit, year, sum(loss) as total, avg(loss) as mean from fx_sims group by 1, 2) q group by 1", "mean_total mean_mean pooled", 5)
def a15(t: Tables):
    return O.yearly_loss(t.fx_sims, ["unit"])


@query("a16_panel_row", "select unit, year, avg(loss) as mean, coalesce(stddev_samp(loss), 0) as std, quantile_cont(loss, 0.25) as p25, quantile_cont(loss, 0.75) as p75, max(loss) as max, sum(loss) as sum from fx_sims group by 1, 2", "mean std p25 p75 max sum", 5)
def a16(t: Tables):
    return O.panel_row(t.fx_sims, ["unit", "year"])


@query("a17_scenario_summary", "with s as (select unit, family, avg(loss) as mean, stddev_samp(loss) as std from fx_sims group by 1, 2) select s.unit, s.family, s.mean, s.std, s.mean - b.mean as delta, (s.mean - b.mean) * 100 / abs(b.mean) as delta_pct from s left join s b on b.unit = s.unit and b.family = 'A'", "mean std delta delta_pct", 5)
def a17(t: Tables):
    return O.scenario_summary(t.fx_sims, ["unit"], "family", "loss", "A")


@query("j12_scenario_vs_baseline", "select a.unit, a.family, a.year, a.sim_id, a.loss - b.loss as delta, (a.loss - b.loss) * 100 / nullif(abs(b.loss), 0) as delta_pct from fx_sims a join fx_sims b on a.unit = b.unit and a.year = b.year and a.sim_id = b.sim_id and b.family = 'A' where a.family <> 'A'", "delta delta_pct", 6)
def j12(t: Tables):
    out = O.versus_baseline(t.fx_sims, ["unit", "year", "sim_id"], "family", "loss", "A")
    return out.select("unit", "family", "year", "sim_id", "delta", "delta_pct")


_HITS = "select unit, year, avg(p) as p_hit, stddev_samp(p) as p_hit_std, avg(given) as loss_given_hit, stddev_samp(given) as given_std, stddev_samp(given) / avg(given) as given_cv from (select unit, year, n_hit / cast(n_events as double) as p, loss / nullif(n_hit, 0) as given from fx_sims) q group by 1, 2"


@query("a18_hit_decomposition", _HITS, "p_hit p_hit_std loss_given_hit given_std given_cv", 7)
def a18(t: Tables):
    return O.hit_decomposition(t.fx_sims, ["unit", "year"])


@query("a19_pool_years", f"with h as (select unit, year, avg(n_hit / cast(n_events as double)) as p_hit, avg(loss / nullif(n_hit, 0)) as loss_given_hit, sum(loss) / sum(n_events) as l_event from fx_sims group by 1, 2) select unit, avg(p_hit) as p_hit, avg(loss_given_hit) as loss_given_hit, avg(l_event) as l_event, count(*) as n_years, abs(avg(p_hit) * avg(loss_given_hit) - avg(l_event)) / avg(l_event) as identity_error from h group by 1", "p_hit loss_given_hit l_event identity_error", 7)
def a19(t: Tables):
    per = O.hit_decomposition(t.fx_sims, ["unit", "year"]).select("unit", "year", "p_hit", "loss_given_hit")
    whole = t.fx_sims.groupBy("unit", "year").agg((F.sum("loss") / F.sum("n_events")).alias("l_event"))
    return O.pool_years(per.join(whole, ["unit", "year"]), "unit")


_QUAD = "concat_ws('_', case when area_km2 >= (select median(area_km2) from fx_county) then 'high' else 'low' end, case when population >= (select median(population) from fx_county) then 'high' else 'low' end)"


@query("a20_quadrant_summary", f"select {_QUAD} as quadrant, count(*) as n, median(customers) as median, avg(customers) as mean from fx_county group by 1", "median mean")
def a20(t: Tables):
    return O.quadrant_summary(quadrant(t.fx_county, "area_km2", "population"), "customers")


@query("j20_attach_quadrants", f"select o.event_id, coalesce(q.quadrant, 'unknown') as quadrant from fx_outages o left join (select fips, {_QUAD} as quadrant from fx_county where state <> 'S2') q using (fips)")
def j20(t: Tables):
    from stormgrid.operators.outages import left_lookup

    labels = quadrant(t.fx_county, "area_km2", "population").where("state <> 'S2'").select("fips", "quadrant")
    return left_lookup(t.fx_outages, labels, ["fips"], {"quadrant": "unknown"}).select("event_id", "quadrant")


@query("a21_risk_measures", "with v as (select unit, quantile_cont(loss, 0.95) as var from fx_sims group by 1) select unit, avg(loss) as mean, stddev_pop(loss) as std, median(loss) as median, max(var) as var95, avg(loss) filter (where loss >= var) as cvar95, min(loss) as min, max(loss) as max from fx_sims join v using (unit) group by 1", "mean std median var95 cvar95 min max", 5)
def a21(t: Tables):
    return O.risk_measures(t.fx_sims, ["unit"])


@query("a22_normalize_loss", "select fips, customers * 1e5 / population as per_100k, customers * 1e3 / area_km2 as per_1000km2, customers * 1e5 / population * (customers * 1e3 / area_km2) as product from fx_county", "per_100k per_1000km2 product", 4)
def a22(t: Tables):
    return O.normalize_loss(t.fx_county.withColumnRenamed("customers", "loss")).select("fips", "per_100k", "per_1000km2", "product")


@query("a28_modal_value", "select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by 1, 2) q where k = 1")
def a28(t: Tables):
    return O.modal_value(t.events, ["user_id"], "event_type", "none")


@query("a29_county_predictions", "select state, count(*) as n, avg(ord % 7) as mean, max(ord % 7) as max from fx_windows group by 1", "mean")
def a29(t: Tables):
    return t.fx_windows.groupBy("state").agg(F.count("*").alias("n"), F.avg(F.col("ord") % 7).alias("mean"), F.max(F.col("ord") % 7).alias("max")).orderBy(F.desc_nulls_last("mean"))


@query("a30_category_mix", "select state, avg(cast(window_stratum = 'urban' as int)) as frac_urban, avg(cast(window_stratum = 'suburban' as int)) as frac_suburban, avg(cast(window_stratum = 'rural' as int)) as frac_rural from fx_windows group by 1", "frac_urban frac_suburban frac_rural")
def a30(t: Tables):
    return O.category_mix(t.fx_windows, ["state"], "window_stratum", ["urban", "suburban", "rural"])


@query("a31_gini", "with r as (select graph_id, capacity, row_number() over (partition by graph_id order by capacity) as i from fx_nodes) select graph_id, case when sum(capacity) > 0 then 2 * sum(i * capacity) / (count(*) * sum(capacity)) - (count(*) + 1.0) / count(*) else 0 end as gini from r group by 1", "gini")
def a31(t: Tables):
    return O.gini(t.fx_nodes, ["graph_id"], "capacity")


_CURVE = "case when var_pop(y_true) * count(*) > 1e-12 then 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) end as r2, avg(abs(y_true - y_pred)) as mae, count(*) as n"


@query("a32_curve_metrics", f"select attack, pct, {_CURVE} from fx_curves group by 1, 2", "r2 mae")
def a32(t: Tables):
    return O.curve_metrics(t.fx_curves, ["attack", "pct"])


_OLS = "regr_slope(loss, year) as slope, regr_intercept(loss, year) as intercept, corr(loss, year) as r, count(*) as n, sqrt(greatest(0.0, regr_syy(loss, year) - regr_slope(loss, year) * regr_slope(loss, year) * regr_sxx(loss, year)) / nullif(count(*) - 2, 0)) / nullif(sqrt(regr_sxx(loss, year)), 0) as se"


@query("a33_ols_slope", f"select unit, family, {_OLS} from fx_sims group by 1, 2", "slope intercept r se", 3)
def a33(t: Tables):
    return O.ols_slope(t.fx_sims, ["unit", "family"], "year", "loss")


_DOSE = "select unit, (year - 2018) * 10 as dose, avg(loss) as loss from fx_sims group by 1, 2"


@query("a34_dose_response", f"with d as ({_DOSE}) select a.unit, a.dose, a.loss, b.loss as base, a.loss - b.loss as delta, (a.loss - b.loss) * 100 / abs(b.loss) as delta_pct from d a join d b on a.unit = b.unit and b.dose = 0 where a.dose <> 0", "loss base delta delta_pct", 3)
def a34(t: Tables):
    return O.dose_response(t.fx_sims.withColumn("dose", (F.col("year") - 2018) * 10), ["unit"])


@query("a37_split_half", f"""with n as (select *, row_number() over (partition by family, unit order by sim_id, loss) as k, count(*) over (partition by family, unit) as c from fx_sims),
m as (select family, unit, avg(loss) filter (where k <= c // 2) as a, avg(loss) filter (where k > c // 2) as b from n where c >= 20 group by 1, 2),
r as (select family, {_avg_rank('a', 'family')} as x, {_avg_rank('b', 'family')} as y from m)
select family, corr(x, y) as rho, count(*) as n, 2 * corr(x, y) / (1 + corr(x, y)) as reliability from r group by 1""", "rho reliability")
def a37(t: Tables):
    return O.split_half(t.fx_sims, ["family"], "unit", "loss")


@query("a38_disattenuate", "select event_id, greatest(-1.0, least(1.0, r / sqrt(0.8 * 0.5))) as rho from (select event_id, cast(event_id % 201 - 100 as double) / 100 as r from events) q", "rho")
def a38(t: Tables):
    r = (F.col("event_id") % 201 - 100).cast("double") / 100.0
    return t.events.select("event_id", O.disattenuate(r, F.lit(0.8), F.lit(0.5)).alias("rho"))


_RHO = f"with r as (select family, year, {_avg_rank('loss', 'family, year')} as x, {_avg_rank('hits', 'family, year')} as y from ({_MEANS}) m), c as (select family, year, corr(x, y) as rho from r group by 1, 2)"


@query("a39_instability_shares", f"{_RHO} select b.year, 1 - b.rho as u_b, 1 - c.rho as u_c, (1 - b.rho) / (2 - b.rho - c.rho) as odi, (1 - c.rho) / (2 - b.rho - c.rho) as ndi from c b join c on b.year = c.year and b.family = 'B' and c.family = 'C'", "u_b u_c odi ndi")
def a39(t: Tables):
    return O.instability_shares(O.spearman(means(t), ["family", "year"], "loss", "hits"), ["year"])


@query("a40_level_shares", "select unit, sum(n_events) / cast(nullif(sum(n_events) + sum(n_hit), 0) as double) as share_n_events, sum(n_hit) / cast(nullif(sum(n_events) + sum(n_hit), 0) as double) as share_n_hit from fx_sims group by 1", "share_n_events share_n_hit")
def a40(t: Tables):
    return O.level_shares(t.fx_sims, ["unit"], ["n_events", "n_hit"])


@query("a41_local_window_features", """with e as (select graph_id, src as node_id from fx_edges union all select graph_id, dst from fx_edges), d as (select graph_id, node_id, count(*) as degree from e group by 1, 2),
n as (select n.*, coalesce(degree, 0) as degree from fx_nodes n left join d using (graph_id, node_id))
select graph_id, count(*) as n_nodes, sum(capacity) as cap_sum, max(capacity) as cap_max, avg(capacity) as cap_mean, stddev_pop(capacity) as cap_std, avg(lat) as lat_mean, stddev_pop(lat) as lat_std, avg(lon) as lon_mean, stddev_pop(lon) as lon_std, avg(degree) as degree_mean, max(degree) as degree_max from n group by 1""", "cap_sum cap_max cap_mean cap_std lat_mean lat_std lon_mean lon_std degree_mean", 5)
def a41(t: Tables):
    return O.local_window_features(t.fx_nodes, t.fx_edges)


@query("a42_loss_by", "select attack, pct, avg(y_true) as mean, stddev_samp(y_true) as std from fx_curves group by 1, 2", "mean std")
def a42(t: Tables):
    return t.fx_curves.groupBy("attack", "pct").agg(F.avg("y_true").alias("mean"), F.stddev_samp("y_true").alias("std"))


@query("a43_replicate_convergence", "with m as (select unit, year, avg(loss) as a, avg(loss) filter (where sim_id < 5) as m5, avg(loss) filter (where sim_id < 20) as m20 from fx_sims group by 1, 2) select 5 as k, max(abs(m5 - a) / abs(a)) as max_diff, avg(abs(m5 - a) / abs(a)) as mean_diff from m union all select 20, max(abs(m20 - a) / abs(a)), avg(abs(m20 - a) / abs(a)) from m", "max_diff mean_diff")
def a43(t: Tables):
    return O.replicate_convergence(t.fx_sims.select("unit", "year", F.col("sim_id").alias("replicate"), F.col("loss").alias("y")), ["unit", "year"], [5, 20])


@query("a44_importance_compare", "with p as (select window_stratum as feature, coalesce(avg(y_true) filter (where attack = 'betweenness'), 0) as betweenness, coalesce(avg(y_true) filter (where attack = 'capacity'), 0) as capacity, coalesce(avg(y_true) filter (where attack = 'random'), 0) as random from fx_curves group by 1) select feature, betweenness, capacity, random, betweenness - random as difference from p", "betweenness capacity random difference")
def a44(t: Tables):
    return O.importance_compare(t.fx_curves.select(F.col("window_stratum").alias("feature"), "attack", (F.col("y_true")).alias("value")))


@query("a48_convergence_qc", "select unit, count(*) as n, avg(loss) as mean, sum(n_hit) / cast(sum(n_events) as double) as p_hit, stddev_samp(loss) / avg(loss) as cv, stddev_samp(loss) / avg(loss) / sqrt(count(*)) as rel_se from fx_sims group by 1", "mean p_hit cv rel_se", 3)
def a48(t: Tables):
    return O.convergence_qc(t.fx_sims, ["unit"])


@query("a49_split_balance", "with s as (select *, case when center_lon > -100 then 'train' else 'test' end as split from fx_windows), e as (select *, 'global' as part from s union all select *, split from s) select part, avg(cast(window_stratum = 'urban' as int)) as frac_urban, avg(cast(window_stratum = 'rural' as int)) as frac_rural, count(*) as n from e group by 1", "frac_urban frac_rural")
def a49(t: Tables):
    df = t.fx_windows.withColumn("split", F.when(F.col("center_lon") > -100, "train").otherwise("test"))
    return O.split_balance(df, "split", "window_stratum", ["urban", "rural"])


@query("a50_window_summary", "select window_stratum, count(*) as n, avg(radius_km) as mean, min(ord) as min, max(ord) as max from fx_windows group by 1", "mean")
def a50(t: Tables):
    return t.fx_windows.groupBy("window_stratum").agg(F.count("*").alias("n"), F.avg("radius_km").alias("mean"), F.min("ord").alias("min"), F.max("ord").alias("max"))


@query("a52_compare_slopes", "with s as (select unit, regr_slope(loss, year) filter (where family = 'A') as a, regr_slope(loss, year) filter (where family = 'B') as b from fx_sims group by 1) select count(*) as n, count(*) filter (where abs(a) > abs(b)) as n_a_steeper, median(a - b) as median_difference from s", "median_difference", 3)
def a52(t: Tables):
    return O.compare_slopes(O.ols_slope(t.fx_sims, ["unit", "family"], "year", "loss"), "unit", "A", "B")


_VULN = "select unit, avg(loss) as mean, sum(loss) / sum(n_events) as per_node, quantile_cont(loss, 0.95) as var95 from fx_sims group by 1"


@query("a53_composite_vulnerability", f"with v as ({_VULN}), s as (select unit, 0.4 * (mean - min(mean) over ()) / (max(mean) over () - min(mean) over ()) + 0.3 * per_node / max(per_node) over () + 0.3 * var95 / max(var95) over () as score from v) select unit, score, rank() over (order by score desc) as rank from s", "score")
def a53(t: Tables):
    df = t.fx_sims.groupBy("unit").agg(F.avg("loss").alias("mean"), (F.sum("loss") / F.sum("n_events")).alias("per_node"), F.percentile("loss", F.lit(0.95)).alias("var95"))
    return O.composite_vulnerability(df, "unit").select("unit", "score", F.col("rank").cast("long").alias("rank"))


@query("a55_extremes", f"with v as ({_VULN}), l as (select unit, 'mean' as measure, mean as value, mean as k from v union all select unit, 'per_node', per_node, -per_node from v) select unit, measure, value, row_number() over (partition by measure order by k, unit) as place from l qualify place <= 3", "value", 3)
def a55(t: Tables):
    df = t.fx_sims.groupBy("unit").agg(F.avg("loss").alias("mean"), (F.sum("loss") / F.sum("n_events")).alias("per_node"))
    return O.extremes(df, "unit", {"mean": True, "per_node": False}, 3).withColumn("place", F.col("place").cast("long"))


@query("a56_pivot_report", "select pct, avg(y_true) filter (where attack = 'betweenness') as betweenness, avg(y_true) filter (where attack = 'random') as random from fx_curves group by 1", "betweenness random")
def a56(t: Tables):
    return O.pivot_report(t.fx_curves, "pct", "attack", ["betweenness", "random"], "y_true")


@query("a35_dose_audit", f"with d as ({_DOSE}), g as (select unit, dose, 20 + dose as nodes, loss from d), j as (select a.unit, a.dose, 100 * (a.nodes / 20.0 - 1) as growth_pct, 100 * (20.0 / a.nodes - 1) as denominator_pct, 100 * (a.loss - b.loss) / abs(b.loss) as delta_pct from g a join g b on a.unit = b.unit and b.dose = 0) select dose, avg(growth_pct) as growth_pct, avg(denominator_pct) as denominator_pct, avg(delta_pct) as mean_pct, median(delta_pct) as median_pct, avg(delta_pct - denominator_pct) as rest_pct from j group by 1", "growth_pct denominator_pct mean_pct median_pct rest_pct", 4)
def a35(t: Tables):
    df = t.fx_sims.withColumn("dose", (F.col("year") - 2018) * 10).groupBy("unit", "dose").agg(F.avg("loss").alias("loss"))
    base = df.where("dose = 0").select("unit", F.col("loss").alias("base"))
    nodes = F.col("dose") + 20
    out = df.join(base, "unit").withColumn("growth_pct", 100 * (nodes / 20.0 - 1)).withColumn("denominator_pct", 100 * (20.0 / nodes - 1))
    out = out.withColumn("delta_pct", 100 * (F.col("loss") - F.col("base")) / F.abs("base"))
    return out.groupBy("dose").agg(
        F.avg("growth_pct").alias("growth_pct"), F.avg("denominator_pct").alias("denominator_pct"), F.avg("delta_pct").alias("mean_pct"),
        F.median("delta_pct").alias("median_pct"), F.avg(F.col("delta_pct") - F.col("denominator_pct")).alias("rest_pct"),
    )
