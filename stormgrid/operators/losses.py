"""Scenario losses: metrics of simulations, dose response, reliability and curve accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators.filters import by
from stormgrid.operators.ranking import avg_rank


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ranked.withColumn("_x", avg_rank(x, keys)).withColumn("_y", avg_rank(y, keys))
    out = ranked.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))
    return out.where(F.col("n") >= min_n)


def quantile_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Median, mean, deviation and count of y in quantile bins of x; edges are exact percentiles."""
    cuts = F.percentile(x, F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("cuts")
    binned = df.crossJoin(F.broadcast(df.agg(cuts)))  # one row
    at = F.size(F.filter("cuts", lambda c: c < F.col(x)))
    return binned.groupBy(at.alias("bin")).agg(F.median(y).alias("median"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.count("*").alias("n"))


def width_bin(x: Column, edges: list[float]) -> Column:
    """Right-closed bins (lo, hi], by the upper edge; null outside."""
    out = F.lit(None).cast("double")
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((x > lo) & (x <= hi), float(hi)).otherwise(out)
    return out


def histogram(df: DataFrame, keys: list[str], x: str, edges: list[float]) -> DataFrame:
    """Counts of [lo, hi) bins, the last closed; long form, bins without rows missing."""
    place = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        upper = F.col(x) <= hi if k == len(edges) - 2 else F.col(x) < hi
        place = F.when((F.col(x) >= lo) & upper, k).otherwise(place)
    return df.withColumn("bin", place).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def sim_metrics(events: DataFrame) -> DataFrame:
    """Per simulation: events, hits, P(hit), loss per event and given a hit, total over nodes."""
    hit = F.col("loss") > 0
    out = events.groupBy("graph_id", "sim_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(hit).alias("n_hit"),
        F.avg("loss").alias("l_event"),
        F.avg(F.when(hit, F.col("loss"))).alias("loss_given_hit"),
        F.sum("loss").alias("total"),
        F.max("radius_km").alias("max_radius"),
        F.max("n_nodes").alias("n_nodes"),
    )
    return out.withColumn("p_hit", F.col("n_hit") / F.col("n_events")).withColumn("l_tilde", F.try_divide("total", "n_nodes"))


def conditional_loss(df: DataFrame, keys: list[str], size: str, loss: str) -> DataFrame:
    """Mean loss of the events at or below the median size and at or above its 75th percentile."""
    cuts = df.groupBy(*keys).agg(F.median(size).alias("mid"), F.percentile(size, F.lit(0.75)).alias("high"))
    joined = df.join(cuts, keys)
    low, high = F.col(size) <= F.col("mid"), F.col(size) >= F.col("high")
    return joined.groupBy(*keys).agg(F.avg(F.when(low, F.col(loss))).alias("loss_low"), F.avg(F.when(high, F.col(loss))).alias("loss_high"))


def yearly_loss(df: DataFrame, keys: list[str]) -> DataFrame:
    per = df.groupBy(*keys, "year").agg(F.sum("loss").alias("total"), F.avg("loss").alias("mean"))
    return per.groupBy(*keys).agg(F.avg("total").alias("mean_total"), F.avg("mean").alias("mean_mean"), F.sum("total").alias("pooled"))


def panel_row(df: DataFrame, keys: list[str], value: str = "loss") -> DataFrame:
    """Mean, deviation (0 for one row), quartiles, maximum and sum."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    out = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), q.alias("q"), F.max(value).alias("max"), F.sum(value).alias("sum")
    )
    return out.withColumn("p25", F.col("q")[0]).withColumn("p75", F.col("q")[1]).drop("q")


def versus_baseline(df: DataFrame, keys: list[str], scenario: str, value: str, baseline: str) -> DataFrame:
    base = df.where(F.col(scenario) == baseline).select(*keys, F.col(value).alias("base"))
    out = df.where(F.col(scenario) != baseline).join(base, keys).withColumn("delta", F.col(value) - F.col("base"))
    return out.withColumn("delta_pct", F.try_divide(F.col("delta") * 100.0, F.abs("base")))


def scenario_summary(df: DataFrame, keys: list[str], scenario: str, value: str, baseline: str) -> DataFrame:
    stats = df.groupBy(*keys, scenario).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    base = stats.where(F.col(scenario) == baseline).select(*keys, F.col("mean").alias("base"))
    out = stats.join(base, keys, "left").withColumn("delta", F.col("mean") - F.col("base"))
    return out.withColumn("delta_pct", F.try_divide(F.col("delta") * 100.0, F.abs("base"))).drop("base")


def hit_decomposition(df: DataFrame, keys: list[str]) -> DataFrame:
    """P(hit) and loss given a hit, over simulations, with the coefficient of variation."""
    d = df.withColumn("p", F.col("n_hit") / F.col("n_events")).withColumn("given", F.try_divide("loss", "n_hit"))
    out = d.groupBy(*keys).agg(
        F.avg("p").alias("p_hit"), F.stddev_samp("p").alias("p_hit_std"), F.avg("given").alias("loss_given_hit"), F.stddev_samp("given").alias("given_std")
    )
    return out.withColumn("given_cv", F.try_divide("given_std", "loss_given_hit"))


def pool_years(df: DataFrame, key: str) -> DataFrame:
    """Means over years, and by how much the product of the parts misses the whole."""
    out = df.groupBy(key).agg(F.avg("p_hit").alias("p_hit"), F.avg("loss_given_hit").alias("loss_given_hit"), F.avg("l_event").alias("l_event"), F.count("*").alias("n_years"))
    product = F.col("p_hit") * F.col("loss_given_hit")
    return out.withColumn("identity_error", F.try_divide(F.abs(product - F.col("l_event")), F.col("l_event")))


def quadrant_summary(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("quadrant").agg(F.count("*").alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"))


def risk_measures(df: DataFrame, keys: list[str], value: str = "loss", level: float = 0.95) -> DataFrame:
    """Value at risk, and the mean of what is at least that large, beside the usual moments."""
    var = df.groupBy(*keys).agg(F.percentile(value, F.lit(level)).alias("var"))
    v = F.col(value)
    return df.join(var, keys).groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.max("var").alias("var95"),
        F.avg(F.when(v >= F.col("var"), v)).alias("cvar95"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def normalize_loss(df: DataFrame) -> DataFrame:
    per_person = F.try_divide(F.col("loss") * 1e5, F.col("population"))
    per_area = F.try_divide(F.col("loss") * 1e3, F.col("area_km2"))
    return df.withColumn("per_100k", per_person).withColumn("per_1000km2", per_area).withColumn("product", per_person * per_area)


def modal_value(df: DataFrame, keys: list[str], column: str, default: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.mode(column, True), F.lit(default)).alias(column))


def category_mix(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg((F.col(column) == v).cast("double")).alias(f"frac_{v}") for v in values))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inequality of values clipped at 0; 0 where they sum to 0."""
    x = df.withColumn("_x", F.greatest(F.col(value), F.lit(0.0)))
    x = x.withColumn("_i", F.row_number().over(by(keys, "_x")))
    out = x.groupBy(*keys).agg(F.sum(F.col("_i") * F.col("_x")).alias("s"), F.sum("_x").alias("t"), F.count("*").alias("n"))
    g = 2.0 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1.0) / F.col("n")
    return out.select(*keys, F.when(F.col("t") > 0, g).otherwise(0.0).alias("gini"))


def curve_metrics(df: DataFrame, keys: list[str], min_n: int = 2) -> DataFrame:
    """R2 and mean absolute error of y_pred; R2 is null where y_true does not vary."""
    both = df.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    rest = F.col("y_true") - F.col("y_pred")
    out = both.groupBy(*keys).agg(F.sum(rest * rest).alias("sse"), (F.var_pop("y_true") * F.count("*")).alias("sst"), F.avg(F.abs(rest)).alias("mae"), F.count("*").alias("n"))
    out = out.where(F.col("n") >= min_n).withColumn("r2", F.when(F.col("sst") > 1e-12, 1.0 - F.col("sse") / F.col("sst")))
    return out.select(*keys, "r2", "mae", "n")


def ols_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count("*").alias("n"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
    )
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    return out.withColumn("se", F.try_divide(F.sqrt(F.try_divide(rest, F.col("n") - 2)), F.sqrt("sxx"))).drop("sxx", "syy")


def dose_response(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean loss by dose, dose 0 included, with the change against dose 0."""
    mean = df.groupBy(*keys, "dose").agg(F.avg("loss").alias("loss"))
    return versus_baseline(mean.withColumn("d", F.col("dose").cast("string")), keys, "d", "loss", "0").drop("d")


def split_half(df: DataFrame, keys: list[str], unit: str, value: str, least: int = 20) -> DataFrame:
    """Rank correlation of unit means of the two halves of the simulations, stepped up by Spearman-Brown."""
    group = Window.partitionBy(*keys, unit)
    n = F.count("*").over(group)
    half = F.when(F.row_number().over(by([*keys, unit], "sim_id", value)) <= F.floor(n / 2), 1).otherwise(2)
    parts = df.withColumn("n", n).withColumn("half", half).where(F.col("n") >= least)
    means = parts.groupBy(*keys, unit).agg(F.avg(F.when(F.col("half") == 1, F.col(value))).alias("a"), F.avg(F.when(F.col("half") == 2, F.col(value))).alias("b"))
    return spearman(means, keys, "a", "b").withColumn("reliability", 2.0 * F.col("rho") / (1.0 + F.col("rho")))


def disattenuate(rho: Column, r1: Column, r2: Column) -> Column:
    return F.when((r1 > 0) & (r2 > 0), C.clip(rho / F.sqrt(r1 * r2), -1, 1))


def instability_shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """1 - rho of families B and C, and the part of each in their sum."""
    wide = df.groupBy(*keys).pivot("family", ["B", "C"]).agg(F.first("rho"))
    u_b, u_c = 1.0 - F.col("B"), 1.0 - F.col("C")
    return wide.select(*keys, u_b.alias("u_b"), u_c.alias("u_c"), F.try_divide(u_b, u_b + u_c).alias("odi"), F.try_divide(u_c, u_b + u_c).alias("ndi"))


def level_shares(df: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    total = sum(F.sum(c) for c in levels)
    return df.groupBy(*keys).agg(*(F.try_divide(F.sum(c), F.nullif(total, F.lit(0))).alias(f"share_{c}") for c in levels))


def replicate_convergence(df: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """How far the mean of the first k replicates is from the mean of all, relative to it."""
    cols = [F.avg(F.when(F.col("replicate") < k, F.col("y"))).alias(f"m{k}") for k in ks]
    means = df.groupBy(*keys).agg(F.avg("y").alias("all"), *cols)
    diff = lambda k: F.try_divide(F.abs(F.col(f"m{k}") - F.col("all")), F.abs("all"))
    rows = means.agg(*(f(diff(k)).alias(f"{n}_{k}") for k in ks for n, f in (("max", F.max), ("mean", F.avg))))
    pieces = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"max_{k}").alias("max_diff"), F.col(f"mean_{k}").alias("mean_diff")) for k in ks))
    return rows.select(F.inline(pieces))


def local_window_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Count, capacity, position and degree statistics of each graph."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    degree = ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    d = nodes.join(degree, ["graph_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    aggs = [F.count("*").alias("n_nodes"), F.sum("capacity").alias("cap_sum"), F.max("capacity").alias("cap_max")]
    for c, name in (("capacity", "cap"), ("lat", "lat"), ("lon", "lon")):
        aggs += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]
    return d.groupBy("graph_id").agg(*aggs, F.avg("degree").alias("degree_mean"), F.max("degree").alias("degree_max"))


def importance_compare(df: DataFrame) -> DataFrame:
    wide = df.groupBy("feature").pivot("attack", ["betweenness", "capacity", "random"]).agg(F.avg("value")).fillna(0.0)
    return wide.withColumn("difference", F.col("betweenness") - F.col("random"))


def convergence_qc(df: DataFrame, keys: list[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("std"), (F.sum("n_hit") / F.sum("n_events")).alias("p_hit"))
    cv = F.try_divide("std", "mean")
    return out.withColumn("cv", cv).withColumn("rel_se", cv / F.sqrt("n")).drop("std")


def split_balance(df: DataFrame, split: str, stratum: str, values: list[str]) -> DataFrame:
    every = df.withColumn("part", F.explode(F.array(F.lit("global"), F.col(split))))
    return category_mix(every, ["part"], stratum, values).join(every.groupBy("part").agg(F.count("*").alias("n")), "part")


def compare_slopes(slopes: DataFrame, key: str, a: str, b: str) -> DataFrame:
    wide = slopes.groupBy(key).pivot("family", [a, b]).agg(F.first("slope"))
    steeper = F.abs(a) > F.abs(b)
    return wide.agg(F.count("*").alias("n"), F.count_if(steeper).alias("n_a_steeper"), F.median(F.col(a) - F.col(b)).alias("median_difference"))


def composite_vulnerability(df: DataFrame, key: str) -> DataFrame:
    """.4 scaled mean loss, .3 loss per node over its maximum, .3 value at risk over its maximum; with the rank."""
    every = Window.partitionBy()
    low, high = F.min("mean").over(every), F.max("mean").over(every)
    a = F.when(high > low, (F.col("mean") - low) / (high - low)).otherwise(0.0)
    score = 0.4 * a + 0.3 * F.col("per_node") / F.max("per_node").over(every) + 0.3 * F.col("var95") / F.max("var95").over(every)
    out = df.withColumn("score", score)
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))))


def extremes(df: DataFrame, key: str, measures: dict[str, bool], k: int) -> DataFrame:
    """The k smallest (True) or largest (False) rows of each measure, long."""
    long = df.unpivot(key, list(measures), "measure", "value").where("value is not null")
    signed = F.col("value") * F.when(F.col("measure").isin([m for m, up in measures.items() if up]), 1.0).otherwise(-1.0)
    place = F.row_number().over(by("measure", signed, key))
    return long.withColumn("place", place).where(F.col("place") <= k)


def pivot_report(df: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))
