"""Ranks, top rows, splits, samples by hash, running curves and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators.filters import by


def avg_rank(column: str, partition: list[str], ascending: bool = True) -> Column:
    """Rank with ties at their average."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    return F.rank().over(by(partition, order)) + (F.count("*").over(Window.partitionBy(*partition, column)) - 1) / 2.0


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(by(keys, *order))).where("_k = 1").drop("_k")


def top_fraction(df: DataFrame, keys: list[str], pct: float, *order) -> DataFrame:
    """The first ceil(n * pct) rows of each group, at least one."""
    n = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(by(keys, *order))
    kept = df.withColumn("_k", k).withColumn("_n", F.greatest(F.lit(1), F.ceil(n * pct)))
    return kept.where("_k <= _n").drop("_k", "_n")


def rank_within(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(by(keys, *order)))


def multi_rank_score(df: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Weighted average-tie ranks of several measures, their order, and the score scaled to 0..1."""
    score = sum(F.col(f"rank_{c}") * w for c, w in weights.items())
    out = df.withColumns({f"rank_{c}": avg_rank(c, keys) for c in weights}).withColumn("score", score)
    group = Window.partitionBy(*keys)
    low, high = F.min("score").over(group), F.max("score").over(group)
    return out.withColumn("risk", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0))


def quadrant(df: DataFrame, x: str, y: str) -> DataFrame:
    """high or low on two axes, by their medians."""
    medians = df.agg(F.median(x).alias("mx"), F.median(y).alias("my"))
    out = df.crossJoin(F.broadcast(medians))  # one row
    side = lambda c, m: F.when(F.col(c) >= F.col(m), "high").otherwise("low")
    return out.withColumn("quadrant", F.concat_ws("_", side(x, "mx"), side(y, "my"))).drop("mx", "my")


def above_percentile(df: DataFrame, value: Column, p: float, out: str) -> DataFrame:
    cut = df.agg(F.percentile(value, F.lit(p)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, value >= F.col("_cut")).drop("_cut")  # one row


def group_ratio(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) / F.avg(value).over(Window.partitionBy(*keys)))


def cumulative_curve(df: DataFrame, keys: list[str], value: str, step: int, *order) -> DataFrame:
    """Running sum of the value clipped at 0, at every ``step``-th row, the first and the last."""
    w = by(keys, *order)
    out = df.withColumn("k", F.row_number().over(w)).withColumn("total", F.sum(F.greatest(F.col(value), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return out.where(((F.col("k") - 1) % step == 0) | (F.col("k") == F.col("_n"))).drop("_n")


def curve_auc(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Trapezoid area over x; the value itself for a single point."""
    w = by(keys, x)
    legs = df.withColumn("area", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0)
    return legs.groupBy(*keys).agg(F.coalesce(F.sum("area"), F.max(y)).alias("auc"))


def number_rows(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("number", F.row_number().over(by(keys, *order)) - 1)


def first_ranks(df: DataFrame, keys: list[str], columns: list[str], top: int, *ties) -> DataFrame:
    """Rank on several columns, for rows that are among the top of any."""
    ranked = df.withColumns({f"rank_{c}": F.row_number().over(by(keys, F.desc(c), *ties)) for c in columns})
    return ranked.where(F.least(*(f"rank_{c}" for c in columns)) <= top)


def top_k(df: DataFrame, column: str, k: int, *ties, most: int = 200) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(max(1, min(k, most)))


def list_position(column: str, order: list[str]) -> Column:
    """Place in a fixed order, the unknown last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


def sample_n(df: DataFrame, n: int, seed: str, keys: list[str], row_id: str) -> DataFrame:
    """At most n rows of each group, by a hash of the row's id: the same rows in any partitioning."""
    u = C.hash_u(F.lit(seed), F.col(row_id))
    return df.withColumn("_k", F.row_number().over(by(keys, u, row_id))).where(F.col("_k") <= n).drop("_k")


def stratified_split(df: DataFrame, stratum: str, share: float, seed: str, row_id: str) -> DataFrame:
    """Of each stratum max(1, round half even(share * n)) rows are test rows."""
    u = C.hash_u(F.lit(seed), F.col(row_id))
    k = F.row_number().over(by(stratum, u, row_id))
    n = F.count("*").over(Window.partitionBy(stratum))
    test = k <= F.greatest(F.lit(1), F.bround(n * F.lit(share)).cast("int"))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def state_folds(df: DataFrame, least: int) -> DataFrame:
    """One fold for each state of enough rows: every row once a fold, test where the state is the fold's."""
    folds = df.groupBy("state").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("state").alias("fold"))
    rows = df.crossJoin(F.broadcast(folds))  # a fold is a state
    return rows.withColumn("split", F.when(F.col("state") == F.col("fold"), "test").otherwise("train"))


def region_holdout(df: DataFrame, state_code: str, region: str) -> DataFrame:
    """split is test for the rows of one region's states, train for all others."""
    if region not in C.REGIONS:
        raise ValueError(f"no region {region}; there are {', '.join(C.REGIONS)}")
    test = F.coalesce(F.upper(F.trim(F.col(state_code))).isin(C.REGIONS[region].split()), F.lit(False))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def state_holdout(df: DataFrame, stratum: str, share: float) -> list[str]:
    """Whole states that together hold about ``share`` of the rows with a like mix of strata.

    Works on the table of counts by state and stratum, greedily; at most 1.2 times the target.
    """
    counts: dict[str, dict[str, int]] = {}
    for r in df.groupBy("state", stratum).count().toLocalIterator():
        counts.setdefault(r["state"], {})[r[stratum]] = r["count"]
    names = sorted({s for c in counts.values() for s in c}, key=str)
    total = {s: sum(c.get(s, 0) for c in counts.values()) for s in names}
    target = share * sum(total.values())
    chosen: list[str] = []
    held = dict.fromkeys(names, 0)
    while True:
        best = None
        for state in sorted(set(counts) - set(chosen)):
            now = {s: held[s] + counts[state].get(s, 0) for s in names}
            size = sum(now.values())
            if size > 1.2 * target:
                continue
            miss = abs(size - target) / target + sum(abs(now[s] / size - total[s] / sum(total.values())) for s in names)
            if best is None or miss < best[0]:
                best = (miss, state, now)
        if best is None or sum(held.values()) >= target:
            return chosen
        chosen.append(best[1])
        held = best[2]


def tier_targets(shares: DataFrame, total: int) -> DataFrame:
    """Rounded shares of a total; the remainder goes to the first tier (column ord)."""
    whole = shares.withColumn("target", F.bround(F.col("share") * total).cast("bigint"))
    rest = F.lit(total) - F.sum("target").over(Window.partitionBy())
    return whole.withColumn("target", F.col("target") + F.when(F.col("ord") == 1, rest).otherwise(0))


def thin_evenly(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """n evenly spaced rows of each group, the first and the last among them."""
    size = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(by(keys, *order)) - 1
    out = df.withColumn("_k", k).withColumn("_n", size)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1)))
    return out.where((F.col("_n") <= n) | F.array_contains(picks, F.col("_k").cast("bigint"))).drop("_k", "_n")


def disjoint_union(graphs: DataFrame, plan: DataFrame) -> DataFrame:
    """Nodes of member graphs under their unit, numbered on from member to member."""
    joined = graphs.join(plan, "graph_id")
    number = F.row_number().over(by("unit", "graph_id", "node_id"))
    return joined.withColumn("unit_node", number).withColumnRenamed("graph_id", "member")


def design_matrix(units: DataFrame, years: DataFrame, base_year: int) -> DataFrame:
    """Jobs of three designs; the cell that two of them share is kept once."""
    same = years.select(F.lit("A").alias("family"), F.col("year").alias("net_year"), F.col("year").alias("out_year"))
    fixed = years.where(F.col("year") != base_year).select(F.lit("B").alias("family"), F.lit(base_year).alias("net_year"), F.col("year").alias("out_year"))
    pooled = years.select(F.lit("C").alias("family"), F.col("year").alias("net_year"), F.lit(None).cast("int").alias("out_year"))
    return units.crossJoin(same.unionAll(fixed).unionAll(pooled))
