"""Outage events: merging, enrichment, rates, severity and rate posteriors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators.filters import by


def merge_outages(df: DataFrame, max_gap_min: float, weight: str = "duration_min") -> DataFrame:
    """Gaps and islands by county: outages that overlap, or begin at most the gap after, are one.

    A running maximum of earlier ends tells where an island begins. An island has the earliest
    start, the latest end, extreme customers and the weighted mean of mean customers (null if the
    weights are 0). Needs fips, start_time, end_time, event_id, the customers and the weight.
    """
    before = by("fips", "start_time", "end_time", "event_id")
    reached = F.max("end_time").over(before.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.make_interval(secs=F.lit(max_gap_min * 60.0).cast("decimal(18,6)"))
    fresh = F.when(F.col("start_time") <= reached + gap, 0).otherwise(1)
    islands = df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(before))
    w = F.col(weight)
    merged = islands.groupBy("fips", "island").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.min("min_customers").alias("min_customers"),
        F.max("max_customers").alias("max_customers"),
        F.try_divide(F.sum(F.col("mean_customers") * w), F.nullif(F.sum(w), F.lit(0.0))).alias("mean_customers"),
        F.min_by("state", F.struct("start_time", "end_time", "event_id")).alias("state"),
        F.min("event_id").alias("event_id"),
        F.count("*").alias("n_merged"),
    )
    return merged.withColumn("duration_min", C.minutes_between(F.col("start_time"), F.col("end_time")))


def left_lookup(df: DataFrame, other: DataFrame, keys: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join that keeps the left side's columns and fills what is missing."""
    clash = [c for c in other.columns if c in df.columns and c not in keys]
    joined = df.join(other.drop(*clash), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def county_rate(events: DataFrame, by_columns: tuple[str, ...] = ("state", "fips"), year: str = "year") -> DataFrame:
    out = events.groupBy(*by_columns).agg(
        F.count("*").alias("n_events"), F.min(year).alias("min_year"), F.max(year).alias("max_year")
    )
    out = out.withColumn("n_years", F.col("max_year") - F.col("min_year") + 1)
    return out.withColumn("rate_per_year", F.col("n_events") / F.col("n_years"))


def state_rate(events: DataFrame) -> DataFrame:
    out = county_rate(events, ("state",))
    counties = events.groupBy("state").agg(F.countDistinct("fips").alias("n_counties"))
    return out.join(counties, "state").withColumn("rate_per_county", F.col("rate_per_year") / F.col("n_counties"))


def state_profile(events: DataFrame, method: str = "weighted") -> DataFrame:
    d, w = F.col("duration_min"), F.col("mean_customers")
    duration = {"weighted": F.try_divide(F.sum(d * w), F.sum(w)), "median": F.median(d), "simple": F.avg(d)}[method]
    out = events.groupBy("state").agg(
        F.count("*").alias("n_events"), F.countDistinct("year").alias("n_years"), duration.alias("duration"), F.sum(w).alias("customers")
    )
    return out.withColumn("rate", F.col("n_events") / F.col("n_years"))


def severity_by(df: DataFrame, keys: list[str], flags: list[str], min_events: int = 1, measures: tuple[str, ...] = ("duration_min", "share")) -> DataFrame:
    """Counts, moments of the measures, and sums and rates of the flags, for groups of enough events."""
    stats = {"mean": F.avg, "median": F.median, "max": F.max, "std": F.stddev_samp}
    aggs = [f(m).alias(f"{m}_{k}") for m in measures for k, f in stats.items()]
    aggs += [F.sum(f).alias(f"n_{f}") for f in flags] + [F.avg(f).alias(f"rate_{f}") for f in flags]
    return df.groupBy(*keys).agg(F.count("*").alias("n_events"), *aggs).where(F.col("n_events") >= min_events)


def severe_rate(df: DataFrame, flag: str, min_events: int) -> DataFrame:
    out = df.groupBy("state", "fips").agg(
        F.sum(flag).alias("n_severe"), F.count("*").alias("n_total"), F.avg("duration_min").alias("mean_minutes"), F.avg("share").alias("mean_share")
    )
    return out.where(F.col("n_total") >= min_events).withColumn("raw_rate", F.col("n_severe") / F.col("n_total"))


def severity_summary(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row for each definition: how many events meet it, and what part of all."""
    one = df.agg(F.count("*").alias("all"), *(F.sum(f).alias(f) for f in flags))
    return one.unpivot("all", flags, "definition", "n").select("definition", "n", (F.col("n") * 100.0 / F.col("all")).alias("pct"))


def corr_by_group(df: DataFrame, keys: list[str], x: str, y: str, min_n: int) -> DataFrame:
    out = df.groupBy(*keys).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    return out.where(F.col("n") > min_n)


def rate_multipliers(counts: DataFrame, key: str = "state", year: str = "year", value: str = "n") -> DataFrame:
    """Each year's count over the key's mean, 1 where that is 0."""
    mean = F.avg(value).over(Window.partitionBy(key))
    return counts.withColumn("multiplier", F.when(mean > 0, F.col(value) / mean).otherwise(1.0))


def full_grid(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Every pair of the values of a and b; a missing pair counts 0."""
    grid = df.select(a).distinct().crossJoin(df.select(b).distinct())
    return grid.join(df, [a, b], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def state_lambda(draws: DataFrame, how: str) -> DataFrame:
    f = {"mean": F.avg, "sum": F.sum}[how]
    return draws.groupBy("draw_id", "state").agg(f("lam").alias("lam"))


def posterior_summary(draws: DataFrame, keys: list[str], value: str = "lam") -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), q.alias("q"))
    return out.select(*keys, "mean", "sd", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def hdi(draws: DataFrame, keys: list[str], value: str = "lam", prob: float = 0.95) -> DataFrame:
    """The shortest interval that holds ``prob`` of the draws."""
    order = by(keys, value)
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = draws.withColumn("i", F.row_number().over(order)).withColumn("n", n).withColumn("k", F.floor(F.col("n") * prob))
    upper = ranked.select(*keys, (F.col("i") - F.col("k")).alias("i"), F.col(value).alias("high"))
    spans = ranked.join(upper, [*keys, "i"]).withColumn("width", F.col("high") - F.col(value))
    best = spans.groupBy(*keys).agg(F.min(F.struct("width", F.col(value).alias("low"), "high")).alias("b"))
    return best.select(*keys, "b.low", "b.high")


def icc(draws: DataFrame) -> DataFrame:
    """Share of the variance that lies between states: mean over draws of the state means' variance."""
    means = draws.groupBy("draw_id", "state").agg(F.avg("lam").alias("m"), F.var_pop("lam").alias("v"))
    per = means.groupBy("draw_id").agg(F.var_pop("m").alias("between_var"), F.avg("v").alias("within_var"))
    out = per.agg(F.avg("between_var").alias("between_var"), F.avg("within_var").alias("within_var"))
    return out.withColumn("icc", F.col("between_var") / (F.col("between_var") + F.col("within_var")))


def severity_score(df: DataFrame, n: int) -> DataFrame:
    out = df.groupBy("fips").agg((F.count("*") * F.avg("duration_min") * F.avg("share")).alias("score"))
    return out.orderBy(F.desc("score"), "fips").limit(n)


def sample_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.lit(0.95)).alias("p95"),
    )


def compare_samples(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    x, y = sample_stats(a, key, value), sample_stats(b, key, value)
    names = [c for c in x.columns if c != key]
    y = y.select(key, *(F.col(c).alias(f"{c}_b") for c in names))
    return x.join(y, key).withColumn("mean_ratio", F.try_divide("mean_b", "mean"))


def rate_outliers(rates: DataFrame, value: str = "rate_per_year") -> DataFrame:
    stats = rates.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    out = rates.crossJoin(F.broadcast(stats))  # one row
    high = F.col(value) > F.col("m") + 3 * F.col("s")
    return out.withColumn("status", F.when(F.col(value) == 0, "zero").when(high, "high").otherwise("usual")).drop("m", "s")


def state_rollup(county: DataFrame, flags: list[str]) -> DataFrame:
    out = county.groupBy("state").agg(F.sum("n_events").alias("n_events"), *(F.sum(f"n_{f}").alias(f"n_{f}") for f in flags))
    return out.withColumns({f"rate_{f}": F.col(f"n_{f}") / F.col("n_events") for f in flags})


def county_counts(events: DataFrame, years: int) -> DataFrame:
    return events.groupBy("fips").agg((F.count("*") / float(years)).alias("per_year"))


def active_hours(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row for each whole hour h with start <= h < end."""
    first, last = F.ceil(start).cast("int"), (F.ceil(end) - 1).cast("int")
    return events.where(first <= last).withColumn("hour", F.explode(F.sequence(first, last)))
