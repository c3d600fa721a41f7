"""Spaced samples of windows: seeds in hash order, disks of nodes around them, quotas for each stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions.columns import hash_u
from stormgrid.operators.filters import by
from stormgrid.operators.networks import independent_set, settled
from stormgrid.operators.spatial import overlapping_pairs, within_radius

#: Shares of a window's radius that centres keep from each other, pass by pass.
SEPARATIONS = (0.5, 0.35)
LEAST_NODES, MOST_NODES = 15, 100


def _near(points: DataFrame, centers: DataFrame, share: float) -> DataFrame:
    """(a, b): points b of a stratum at most ``share`` of the radius from centers a."""
    around = centers.select(F.col("node_id").alias("a"), F.col("stratum").alias("stratum_a"), F.col("radius_km").alias("r"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    own = points.select(F.col("node_id").alias("b"), "stratum", "lat", "lon")
    return within_radius(own, around, F.col("r") * share).where("stratum = stratum_a and a <> b").select("a", "b")


def spaced_seeds(
    nodes: DataFrame, tiers: DataFrame, seed: str, least: int = LEAST_NODES, separations: tuple[float, ...] = SEPARATIONS, first_share: float = 4.0
) -> DataFrame:
    """The seeds that a greedy pass in hash order accepts in each stratum, up to its target.

    nodes: node_id (unique), lat, lon, stratum. tiers: stratum, radius_km, target. A seed must have
    ``least`` nodes of any stratum in its disk and more than the pass's share of the radius to every
    accepted seed of its stratum. A pass takes seeds in lots of growing hash thresholds, about
    ``first_share`` times the target first, so a large pool is looked at only as far as the targets
    need; as greedy choices depend on earlier seeds alone, lots do not change them. The next pass
    takes what is missing with a smaller distance, in a new order.

    Returns node_id, stratum, radius_km, lat, lon, n_raw, pass, place (order of acceptance).
    """
    pool = nodes.join(F.broadcast(tiers), "stratum").where("target > 0")  # tiers: one row a stratum
    sizes = pool.groupBy("stratum").agg(F.count("*").alias("pool"))
    plan = settled(tiers.join(sizes, "stratum").select("stratum", "target", "pool"))
    kept = None
    for k, share in enumerate(separations):
        order = hash_u(F.lit(f"{seed}-{k}"), F.col("node_id"))
        low, lot = 0.0, first_share
        while low < 1.0:
            have = plan.withColumn("have", F.lit(0)) if kept is None else plan.join(kept.groupBy("stratum").agg(F.count("*").alias("have")), "stratum", "left").fillna(0, ["have"])
            missing = have.where("have < target").select("stratum", (F.col("target") - F.col("have")).alias("missing"), "pool")
            rows = missing.collect()  # one row a stratum
            if not rows:
                break
            high = min(1.0, max(low + lot * r["missing"] / r["pool"] for r in rows))
            now = pool.join(F.broadcast(missing.drop("pool")), "stratum").withColumn("u", order).where((F.col("u") >= low) & (F.col("u") < high if high < 1 else F.lit(True)))
            if kept is not None:
                now = now.join(_near(now, kept, share).select(F.col("b").alias("node_id")).distinct(), "node_id", "left_anti")
                now = now.join(kept.select("node_id"), "node_id", "left_anti")
            now = settled(now)
            centers = now.select(F.col("node_id").alias("seed"), "radius_km", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
            full = within_radius(nodes.select("lat", "lon"), centers, F.col("radius_km")).groupBy(F.col("seed").alias("node_id")).agg(F.count("*").alias("n_raw")).where(F.col("n_raw") >= least)
            now = settled(now.join(full, "node_id").withColumn("ord", F.struct("u", "node_id")))
            names = now.select(F.col("node_id").alias("id"), "ord")
            pairs = _near(now, now, share).join(names.toDF("a", "ord_a"), "a").join(names.toDF("b", "ord_b"), "b").where("ord_a < ord_b")
            chosen = independent_set(now, pairs.select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"))).where("kept")
            rank = F.row_number().over(by("stratum", "ord"))
            taken = now.join(chosen.select("ord"), "ord").withColumn("rank", rank).where("rank <= missing")
            taken = taken.select("node_id", "stratum", "radius_km", "lat", "lon", "n_raw", F.lit(k + 1).alias("pass"), "u")
            kept = settled(taken if kept is None else kept.unionByName(taken))
            low, lot = high, lot * 4
    if kept is None:
        kept = pool.select("node_id", "stratum", "radius_km", "lat", "lon", F.lit(0).cast("bigint").alias("n_raw"), F.lit(0).alias("pass"), F.lit(0.0).alias("u")).where("false")
    place = F.row_number().over(by("stratum", "pass", "u", "node_id"))
    return kept.withColumn("place", place).drop("u")


def random_windows(
    nodes: DataFrame, tiers: DataFrame, seed: str, least: int = LEAST_NODES, most: int = MOST_NODES, separations: tuple[float, ...] = SEPARATIONS
) -> tuple[DataFrame, DataFrame]:
    """Windows and their members: a disk around each spaced seed, of at most ``most`` nodes by hash.

    The windows have window_id (``w_stratum_00000`` in the order of acceptance), the seed, n_raw and
    n_nodes, and the shares of strata among their members.
    """
    seeds = settled(spaced_seeds(nodes, tiers, seed, least, separations))
    name = F.format_string("w_%s_%05d", F.col("stratum"), F.col("place") - 1)
    named = seeds.select(name.alias("window_id"), F.col("stratum").alias("window_stratum"), "radius_km", F.col("node_id").alias("seed_node_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon"), "n_raw", "pass")
    inside = within_radius(nodes.select("node_id", "lat", "lon", "stratum"), named, F.col("radius_km"))
    u = hash_u(F.lit(f"{seed}-member"), F.col("window_id"), F.col("node_id"))
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy(u, "node_id"))
    members = settled(inside.withColumn("rank", rank).where(F.col("rank") <= most).select("window_id", "node_id", "stratum", "lat", "lon"))
    share = lambda s: F.avg((F.col("stratum") == s).cast("double")).alias(f"frac_{s}")
    mix = members.groupBy("window_id").agg(F.count("*").alias("n_nodes"), *map(share, ("urban", "suburban", "rural")))
    windows = named.withColumnsRenamed({"clat": "center_lat", "clon": "center_lon"}).join(mix, "window_id")
    return windows, members


def first_members(points: DataFrame, windows: DataFrame, n: int, seed: str, row_id: str, first: int = 2000) -> DataFrame:
    """(window_id, row_id): the first ``n`` points (row_id, lat, lon) of each window's disk in an order of hashes that all windows share.

    windows: window_id (unique), radius_km, clat, clon. Points come in lots of that order, each three times
    all before it, from about ``first`` points on; a window that has its members looks at no further lot.
    """
    points = points.select(row_id, "lat", "lon").withColumn("_u", hash_u(F.lit(seed), F.col(row_id)))
    points, left = settled(points), settled(windows.select("window_id", "radius_km", "clat", "clon", F.lit(n).alias("missing")))
    low, high, cell, out = 0.0, min(1.0, first / max(1, points.count())), 0.5, None
    while low < 1.0 and left.limit(1).count():
        lot = points.where((F.col("_u") >= low) & (F.col("_u") < high if high < 1.0 else F.lit(True)))
        pairs = within_radius(lot, left, F.col("radius_km"), cell).select("window_id", row_id, "_u", "missing")
        now = settled(pairs.withColumn("_k", F.row_number().over(by("window_id", "_u", row_id))).where(F.col("_k") <= n).where("_k <= missing").select("window_id", row_id))
        out = now if out is None else out.unionAll(now)
        have = now.groupBy("window_id").agg(F.count("*").alias("have"))
        left = left.join(have, "window_id", "left").withColumn("missing", F.col("missing") - F.coalesce("have", F.lit(0))).drop("have")
        left = settled(left.where("missing > 0"))
        low, high, cell = high, min(1.0, high * 4), max(cell / 2, 0.125)
    return windows.select("window_id").join(points.select(row_id), F.lit(False)) if out is None else out


def spaced_windows(windows: DataFrame, most: float, quotas: DataFrame | None = None, first: int = 500) -> DataFrame:
    """Windows that a greedy pass in the order of ``ord`` (a number) keeps, no two of which overlap by more than ``most``.

    The pass takes lots, each three times all before it, from ``first`` windows on. Of a lot only the
    windows that no kept one rules out are compared with each other: their number is bounded by the room
    that is left, not by the number of windows, so conflicts between windows that fall anyway are never
    listed. With quotas (window_stratum, quota) only windows of one stratum conflict, and a stratum that
    has its quota takes no more. Returns the kept windows.
    """
    n = windows.count()
    shares = [min(1.0, first / n) * 4.0**k for k in range(32) if min(1.0, first / n) * 4.0**k < 1] if n else []
    cuts = sorted(set(windows.agg(F.percentile_approx("ord", shares, 10000)).first()[0])) if shares else []
    kept = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        lot = windows if low is None else windows.where(F.col("ord") > low)
        lot = lot if high is None else lot.where(F.col("ord") <= high)
        if quotas is not None:
            open_ = quotas if kept is None else quotas.join(kept.groupBy("window_stratum").agg(F.count("*").alias("have")), "window_stratum", "left").where("have is null or have < quota")
            lot = lot.join(F.broadcast(open_.select("window_stratum")), "window_stratum")  # one row a stratum
        near = lambda a, b: overlapping_pairs(a, b).where((F.col("overlap") > most) & (F.lit(quotas is None) | (F.col("stratum_a") == F.col("stratum_b"))))
        if kept is not None:
            lot = lot.join(near(kept, lot).select(F.col("ord_b").alias("ord")).distinct(), "ord", "left_anti")
        lot = settled(lot.select(windows.columns))
        if not lot.limit(1).count():
            continue
        chosen = independent_set(lot, near(lot, lot).select(F.col("ord_a").alias("a"), F.col("ord_b").alias("b"))).where("kept")
        now = lot.join(chosen.select("ord"), "ord").select(windows.columns)
        kept = settled(now if kept is None else kept.unionByName(now))
    if kept is None:
        return windows.limit(0)
    if quotas is None:
        return kept
    rank = F.row_number().over(by("window_stratum", "ord"))
    return kept.withColumn("rank", rank).join(F.broadcast(quotas), "window_stratum").where("rank <= quota").select(windows.columns)
