"""Merged outages, rates, severity tables and posterior summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators import outages as O
from stormgrid.operators.filters import add_event_times
from stormgrid.plans.registry import Tables, query
from stormgrid.plans.scalars import _SHARED, TIER_SQL, shares

TIERS = list(C.TIERS)

_TIMED = "select *, start_time + to_microseconds(cast(round(duration_min * 60 * 1000000) as bigint)) as end_time from fx_outages"
_MERGED = f"""
with timed as ({_TIMED}),
flagged as (select *, case when start_time <= max(end_time) over (w rows between unbounded preceding and 1 preceding) + interval 60 minute then 0 else 1 end as fresh
  from timed window w as (partition by fips order by start_time, end_time, event_id)),
islands as (select *, sum(fresh) over (partition by fips order by start_time, end_time, event_id rows unbounded preceding) as island from flagged),
merged as (select fips, min(start_time) as start_time, max(end_time) as end_time, max(max_customers) as max_customers,
  sum(mean_customers * duration_min) / nullif(sum(duration_min), 0) as mean_customers, arg_min(state, (start_time, end_time, event_id)) as state, count(*) as n_merged
  from islands group by fips, island)
"""


def merged(t: Tables):
    return O.merge_outages(add_event_times(t.fx_outages), 60)


@query("w01_merge_outages", f"{_MERGED} select fips, state, start_time, end_time, max_customers, mean_customers, n_merged from merged", "max_customers mean_customers")
def w01(t: Tables):
    return merged(t).select("fips", "state", "start_time", "end_time", "max_customers", "mean_customers", "n_merged")


_RATE = "select state, fips, count(*) as n_events, min(year(start_time)) as min_year, max(year(start_time)) as max_year, max(year(start_time)) - min(year(start_time)) + 1 as n_years, count(*) / cast(max(year(start_time)) - min(year(start_time)) + 1 as double) as rate_per_year"


@query("a01_county_rate", f"{_MERGED} {_RATE} from merged group by 1, 2", "rate_per_year")
def a01(t: Tables):
    return O.county_rate(merged(t).withColumn("year", F.year("start_time").cast("long")))


@query("a02_state_rate", "select state, count(*) as n_events, min(year) as min_year, max(year) as max_year, max(year) - min(year) + 1 as n_years, count(*) / cast(max(year) - min(year) + 1 as double) as rate_per_year, count(distinct fips) as n_counties, count(*) / cast(max(year) - min(year) + 1 as double) / count(distinct fips) as rate_per_county from fx_outages group by 1", "rate_per_year rate_per_county")
def a02(t: Tables):
    return O.state_rate(t.fx_outages)


@query("a03_state_profile", "select state, count(*) as n_events, count(distinct year) as n_years, sum(duration_min * mean_customers) / sum(mean_customers) as duration, sum(mean_customers) as customers, count(*) / cast(count(distinct year) as double) as rate from fx_outages group by 1", "duration customers rate", 4)
def a03(t: Tables):
    return O.state_profile(t.fx_outages)


_TIERED = f"select q.*, {TIER_SQL} from ({_SHARED}) q"
_SEV = ", ".join(f"{f}({m}) as {m}_{k}" for m in ("duration_min", "share") for k, f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("std", "stddev_samp")))
_SEV += "".join(f", sum({f})::bigint as n_{f}" for f in TIERS) + "".join(f", avg({f}) as rate_{f}" for f in TIERS)
_SEV_DOUBLES = " ".join([f"{m}_{k}" for m in ("duration_min", "share") for k in ("mean", "median", "max", "std")] + [f"rate_{f}" for f in TIERS])


def tiered(t: Tables):
    df = shares(t)
    return df.withColumns(C.severity_tiers(F.col("hours"), F.col("share")))


@query("a04_county_severity", f"select state, fips, count(*) as n_events, {_SEV} from ({_TIERED}) s group by 1, 2 having count(*) >= 10", _SEV_DOUBLES, 5)
def a04(t: Tables):
    return O.severity_by(tiered(t), ["state", "fips"], TIERS, 10)


@query("a05_county_severe_rate", f"select state, fips, sum(tier1)::bigint as n_severe, count(*) as n_total, avg(duration_min) as mean_minutes, avg(share) as mean_share, sum(tier1) / count(*) as raw_rate from ({_TIERED}) s group by 1, 2 having count(*) >= 5", "mean_minutes mean_share raw_rate")
def a05(t: Tables):
    return O.severe_rate(tiered(t), "tier1", 5)


@query("a06_state_severity", f"select state, count(*) as n_events, {_SEV} from ({_TIERED}) s group by 1", _SEV_DOUBLES, 5)
def a06(t: Tables):
    return O.severity_by(tiered(t), ["state"], TIERS)


@query("a07_severity_summary", " union all ".join(f"select '{f}' as definition, sum({f})::bigint as n, sum({f}) * 100.0 / count(*) as pct from ({_TIERED}) s" for f in TIERS), "pct")
def a07(t: Tables):
    return O.severity_summary(tiered(t), TIERS)


@query("a08_corr_by_group", f"select state, corr(duration_min, share) as r, count(*) as n from ({_SHARED}) s group by 1 having count(*) > 10", "r")
def a08(t: Tables):
    return O.corr_by_group(shares(t), ["state"], "duration_min", "share", 10)


def counts(t: Tables):
    return t.fx_outages.groupBy("state", "year").agg(F.count("*").alias("n"))


@query("j11_full_grid", "select s.fips, y.day, coalesce(n, 0) as n from (select distinct fips from fx_outages) s cross join (select distinct dayofyear(start_time) as day from fx_outages) y left join (select fips, dayofyear(start_time) as day, count(*) as n from fx_outages group by 1, 2) c on c.fips = s.fips and c.day = y.day")
def j11(t: Tables):
    daily = t.fx_outages.groupBy("fips", F.dayofyear("start_time").cast("long").alias("day")).agg(F.count("*").alias("n"))
    return O.full_grid(daily, "fips", "day", "n")


@query("a23_rate_multipliers", "select state, year, n, n / avg(n) over (partition by state) as multiplier from (select state, year, count(*) as n from fx_outages group by 1, 2) q", "multiplier")
def a23(t: Tables):
    return O.rate_multipliers(counts(t))


_DRAWS = "select event_id % 40 as draw_id, state, fips, value as lam from (select event_id, value, concat('S', cast(user_id % 10 as varchar)) as state, lpad(cast(1001 + user_id as varchar), 5, '0') as fips from events) e"


def draws(t: Tables):
    return t.fx_outages.select((F.col("event_id") % 40).alias("draw_id"), "state", "fips", F.col("mean_customers").alias("lam"))


@query("a24_state_lambda", f"select draw_id, state, avg(lam) as mean_rate, sum(lam) as sum_rate from ({_DRAWS}) d group by 1, 2", "mean_rate sum_rate")
def a24(t: Tables):
    mean = O.state_lambda(draws(t), "mean").withColumnRenamed("lam", "mean_rate")
    return mean.join(O.state_lambda(draws(t), "sum").withColumnRenamed("lam", "sum_rate"), ["draw_id", "state"])


@query("a25_posterior_summary", f"select state, fips, avg(lam) as mean, stddev_pop(lam) as sd, quantile_cont(lam, 0.025) as low, quantile_cont(lam, 0.5) as median, quantile_cont(lam, 0.975) as high from ({_DRAWS}) d group by 1, 2", "mean sd low median high")
def a25(t: Tables):
    return O.posterior_summary(draws(t), ["state", "fips"])


@query("a26_hdi", f"""with r as (select fips, lam, row_number() over (partition by fips order by lam) as i, cast(floor(count(*) over (partition by fips) * 0.95) as bigint) as k from ({_DRAWS}) d),
s as (select a.fips, a.lam as low, b.lam as high, row_number() over (partition by a.fips order by b.lam - a.lam, a.lam) as best from r a join r b on a.fips = b.fips and b.i = a.i + a.k)
select fips, low, high from s where best = 1""", "low high")
def a26(t: Tables):
    return O.hdi(draws(t), ["fips"])


@query("a27_icc", f"with m as (select draw_id, state, avg(lam) as m, var_pop(lam) as v from ({_DRAWS}) d group by 1, 2), p as (select draw_id, var_pop(m) as b, avg(v) as w from m group by 1) select avg(b) as between_var, avg(w) as within_var, avg(b) / (avg(b) + avg(w)) as icc from p", "between_var within_var icc")
def a27(t: Tables):
    return O.icc(draws(t))


@query("a45_severity_score", f"select fips, count(*) * avg(duration_min) * avg(share) as score from ({_SHARED}) s group by 1 order by score desc, fips limit 20", "score", 4)
def a45(t: Tables):
    return O.severity_score(shares(t), 20)


def _stats(cond):
    return f"select state, avg(duration_min) as mean, median(duration_min) as median, stddev_samp(duration_min) as std, min(duration_min) as min, max(duration_min) as max, quantile_cont(duration_min, 0.95) as p95 from fx_outages where {cond} group by 1"


@query("a46_compare_samples", f"select a.state, a.mean, a.median, a.std, a.min, a.max, a.p95, b.mean as mean_b, b.median as median_b, b.std as std_b, b.min as min_b, b.max as max_b, b.p95 as p95_b, b.mean / a.mean as mean_ratio from ({_stats('year <= 2020')}) a join ({_stats('year > 2020')}) b using (state)", "mean median std min max p95 mean_b median_b std_b min_b max_b p95_b mean_ratio", 5)
def a46(t: Tables):
    df = t.fx_outages
    return O.compare_samples(df.where("year <= 2020"), df.where("year > 2020"), "state", "duration_min")


@query("a47_rate_outliers", "with r as (select fips, count(*) / 6.0 as rate from fx_outages group by 1), s as (select avg(rate) as m, stddev_samp(rate) as s from r) select fips, rate, case when rate = 0 then 'zero' when rate > m + 3 * s then 'high' else 'usual' end as status from r, s", "rate")
def a47(t: Tables):
    return O.rate_outliers(O.county_counts(t.fx_outages, 6).withColumnRenamed("per_year", "rate"), "rate")


@query("a51_state_rollup", f"select state, sum(n)::bigint as n_events, sum(t1)::bigint as n_tier1, sum(t4)::bigint as n_tier4, sum(t1) / sum(n) as rate_tier1, sum(t4) / sum(n) as rate_tier4 from (select state, fips, count(*) as n, sum(tier1) as t1, sum(tier4) as t4 from ({_TIERED}) s group by 1, 2) c group by 1", "rate_tier1 rate_tier4")
def a51(t: Tables):
    county = O.severity_by(tiered(t), ["state", "fips"], ["tier1", "tier4"])
    return O.state_rollup(county, ["tier1", "tier4"])


@query("a54_county_counts", "select fips, count(*) / 6.0 as per_year from fx_outages group by 1", "per_year")
def a54(t: Tables):
    return O.county_counts(t.fx_outages, 6)


@query("m07_shrink_rates", """with c as (select state, fips, count(*) as n, 6.0 as t from fx_outages group by 1, 2),
s as (select state, avg(n / t) as m, greatest(var_samp(n / t) - avg(n / t) / 6.0, 1e-9) as v from c group by 1)
select fips, n / t as raw, (m * m / v + n) / (m / v + t) as shrunk from c join s using (state)""", "raw shrunk")
def m07(t: Tables):
    from stormgrid.operators.models import shrink_rates

    c = t.fx_outages.groupBy("state", "fips").agg(F.count("*").alias("n"), F.lit(6.0).alias("t"))
    return shrink_rates(c, "state").select("fips", "raw", "shrunk")


@query("m07_nested_rates", """with c as (select state, fips, count(*) as n, 6.0::double as t from fx_outages group by 1, 2),
g as (select state, sum(n) as gn, sum(t) as gt, sum(n) / sum(t) as gr, case when count(*) > 1 then greatest(var_samp(n / t) - sum(n) / sum(t) / avg(t), 1e-9) end as gv from c group by 1),
nat as (select avg(gr) as national_rate, greatest(var_samp(gr) - avg(gr / gt), 1e-9) as nv, coalesce(avg(gv), 1e-9) as usual from g),
s as (select state, national_rate, (national_rate * national_rate / nv + gn) / (national_rate / nv + gt) as group_rate, coalesce(gv, usual) as v from g, nat),
p as (select fips, n / t as raw, group_rate, national_rate, group_rate * group_rate / v + n as a, group_rate / v + t as b from c join s using (state))
select fips, raw, group_rate, national_rate, a / b as shrunk, a / b * pow(greatest(0, 1 - 1 / (9 * a) - 1.959964 / (3 * sqrt(a))), 3) as low, a / b * pow(greatest(0, 1 - 1 / (9 * a) + 1.959964 / (3 * sqrt(a))), 3) as high from p""", "raw group_rate national_rate shrunk low high")
def m07_nested(t: Tables):
    from stormgrid.operators.models import shrink_rates_nested

    c = t.fx_outages.groupBy("state", "fips").agg(F.count("*").alias("n"), F.lit(6.0).alias("t"))
    return shrink_rates_nested(c, "state").select("fips", "raw", "group_rate", "national_rate", "shrunk", "low", "high")


@query("m08_severity_glm")
def m08_glm(t: Tables):
    """Share of severe events by area, customers and population of the county."""
    from stormgrid.operators.models import severity_glm

    c = tiered(t).groupBy("fips").agg(F.sum("tier1").alias("k"), F.count("*").alias("n")).join(t.fx_county, "fips")
    out, _ = severity_glm(c, ["area_km2", "customers", "population"])
    return out.select("fips", F.round("predicted", 4).alias("predicted"))


@query("m08_shrink_severity", f"""with c as (select state, fips, sum(tier1) as k, count(*) as n from ({_TIERED}) s group by 1, 2),
s as (select state, avg(k / n) as m, var_samp(k / n) as v from c group by 1),
p as (select state, m, greatest(m * (1 - m) / nullif(greatest(v, 1e-9), 0) - 1, 1e-6) as w from s)
select fips, k / n as raw, (m * w + k) / (w + n) as shrunk from c join p using (state)""", "raw shrunk")
def m08(t: Tables):
    from stormgrid.operators.models import shrink_severity

    c = tiered(t).groupBy("state", "fips").agg(F.sum("tier1").alias("k"), F.count("*").alias("n"))
    return shrink_severity(c, "state").select("fips", "raw", "shrunk")
