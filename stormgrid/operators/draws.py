"""Reproducible draws: every number is a hash of the seed and the row's keys, so that any partitioning,
and any subset of scenarios, gives the same events (common random numbers)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.functions.columns import hash_u
from stormgrid.operators.filters import by
from stormgrid.operators.losses import spearman


def poisson(rate: Column, u: Column, most: int = 400) -> Column:
    """Inverse of the Poisson distribution at u, for rates up to about 200: counts while the sum is below u."""
    state = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    step = lambda s, k: F.when(
        s["c"] < u, F.struct(k.alias("n"), (s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"))
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step, lambda s: s["n"])


def poisson_counts(rates: DataFrame, keys: list[str], rate: str, seed: str, part: float = 100.0) -> DataFrame:
    """A count for each row; a large rate is the sum of several draws of at most ``part``."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(rate) / part)).cast("int")
    split = rates.select(*keys, F.col(rate).alias("_r"), parts.alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    u = hash_u(F.lit(seed), *keys_of(keys), F.col("_i"))
    return split.withColumn("_k", poisson(F.greatest(F.col("_r"), F.lit(0.0)) / F.col("_n"), u)).groupBy(*keys).agg(F.sum("_k").alias("n"))


def keys_of(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def weighted_pick(asks: DataFrame, items: DataFrame, group: str, weight: str, item: str, seed: str, keys: list[str]) -> DataFrame:
    """For each row of asks one item of its group, with odds by weight (floor 1e-8).

    A number meets only the items whose stretch of [0, 1) touches its bucket; a group has as many buckets as items.
    """
    order = by(group, item)
    w = F.greatest(F.col(weight), F.lit(1e-8))
    total = F.sum(w).over(Window.partitionBy(group))
    cut = items.select(group, item, (F.sum(w).over(order) / total).alias("hi"), (F.sum(w).over(order) / total - w / total).alias("lo"))
    sizes = items.groupBy(group).agg(F.count("*").alias("_n"))
    cut = cut.join(sizes, group).withColumn("_b", F.expr("explode(sequence(cast(greatest(0, floor(lo * _n)) as bigint), cast(case when hi > 1 - 1e-9 then _n - 1 else least(_n - 1, floor(hi * _n)) end as bigint)))")).drop("_n")
    u = asks.withColumn("_u", hash_u(F.lit(seed), *keys_of(keys))).join(sizes, group).withColumn("_b", F.expr("cast(least(_n - 1, floor(_u * _n)) as bigint)")).drop("_n")
    met = u.join(cut, [group, "_b"]).where("_u >= lo and (_u < hi or hi > 1 - 1e-9)").drop("_b")
    return met.withColumn("_k", F.row_number().over(by(keys, "hi"))).where("_k = 1").drop("_u", "_k", "lo", "hi")


def uniform_pick(asks: DataFrame, pool: DataFrame, group: str | list[str], order: str, seed: str, keys: list[str], least: int = 1) -> DataFrame:
    """For each row of asks one row of the pool of its group, of groups with ``least`` rows."""
    groups = [group] if isinstance(group, str) else group
    numbered = pool.withColumn("_i", F.row_number().over(by(groups, order)) - 1)
    sizes = pool.groupBy(*groups).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    want = asks.join(sizes, groups).withColumn("_i", F.floor(hash_u(F.lit(seed), *keys_of(keys)) * F.col("_n")).cast("int"))
    return want.join(numbered, [*groups, "_i"]).drop("_i", "_n")


def ladder_pick(asks: DataFrame, pools: list[tuple[str, DataFrame, list[str], int]], order: str, seed: str, keys: list[str], values: list[str]) -> DataFrame:
    """For each row of asks a row of the first pool (level, rows, group, least) whose group has enough rows, with its level.

    Rows that no pool serves are left out.
    """
    out, left = None, asks
    for level, pool, group, least in pools:
        drawn = uniform_pick(left, pool.select(*group, order, *values), group, order, seed, keys, least)
        drawn = drawn.select(*asks.columns, order, *values, F.lit(level).alias("level"))
        out = drawn if out is None else out.unionByName(drawn)
        left = left.join(drawn.select(*keys), keys, "left_anti")
    return out


def severe_pool(history: DataFrame, group: str, value: str, top: float = 0.10) -> DataFrame:
    """The ``top`` share of each group's rows by value, rounded up; of equal values the smaller event_id."""
    ranked = history.withColumn("_k", F.row_number().over(by(group, F.desc(value), "event_id"))).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    return ranked.where(F.col("_k") <= F.ceil(F.col("_n") * F.lit(top))).drop("_k", "_n")


def asked(counts: DataFrame) -> DataFrame:
    """A row, numbered k from 1, for each event that counts asks for."""
    return counts.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")


def bootstrap_events(counts: DataFrame, rates: DataFrame, history: DataFrame, seed: str, severe: str | None = None, top: float = 0.10, least: int = 1) -> DataFrame:
    """Draw n events for each (sim_id, state): a county by its rate, then one of its past events, else of the state's.

    counts: sim_id, state, n. rates: state, fips, rate. history: event_id, state, fips, hours, and the
    column ``severe``, if given: then only the ``top`` share of a state's events by it are drawn from,
    and of these the ``top`` share of each county's. Counties with fewer than ``least`` events borrow
    from the state (``pooled``). Events of states without any history are left out.
    """
    keys = ["sim_id", "state", "k"]
    county = weighted_pick(asked(counts), rates, "state", "rate", "fips", f"{seed}-county", keys)
    of_state = history if severe is None else severe_pool(history, "state", severe, top)
    of_county = history if severe is None else severe_pool(of_state, "fips", severe, top)
    pools = [("county", of_county, ["fips"], least), ("state", of_state, ["state"], 1)]
    drawn = ladder_pick(county.select(*keys, "fips"), pools, "event_id", f"{seed}-event", keys, ["hours"])
    return drawn.select(*keys, "fips", "event_id", "hours", (F.col("level") != "county").alias("pooled"))


def bootstrap_year_events(counts: DataFrame, rates: DataFrame, history: DataFrame, seed: str, least: int = 1) -> DataFrame:
    """Draw n events for each (sim_id, year, state): of the county's events of that year, else the state's of that year, else the state's of all years.

    counts: sim_id, year, state, n. rates: state, fips, rate. history: event_id, state, fips, year,
    hours. Counties with fewer than ``least`` events of the year borrow. level is county, state_year
    or state_pooled. Events of states without any history are left out.
    """
    keys = ["sim_id", "year", "state", "k"]
    county = weighted_pick(asked(counts), rates, "state", "rate", "fips", f"{seed}-county", keys)
    pools = [("county", history, ["fips", "year"], least), ("state_year", history, ["state", "year"], 1), ("state_pooled", history, ["state"], 1)]
    return ladder_pick(county.select(*keys, "fips"), pools, "event_id", f"{seed}-event", keys, ["hours"])


def draw_posterior(draws: DataFrame, sims: DataFrame, n_draws: int, seed: str) -> DataFrame:
    """One joint draw of all counties for each simulation."""
    pick = F.floor(hash_u(F.lit(seed), F.col("sim_id")) * n_draws).cast("bigint")
    return sims.withColumn("draw_id", pick).join(draws, "draw_id")


def epicenters(events: DataFrame, tracts: DataFrame, counties: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """A tract of the event's county by population, and a uniform point in the tract.

    tracts: fips, tract, population, ring. counties: fips, ring. Events of counties without tracts get a
    point in the county (``placed`` is county), those without either a null place (none): every event
    has a row. A point is the first of ``POINTS`` draws of the ring's box that lies in the ring, else
    in the middle of the widest stretch of the ring on the box's middle latitude.
    """
    picked = weighted_pick(events, tracts.select("fips", "tract", "population"), "fips", "population", "tract", f"{seed}-tract", keys)
    inside = picked.join(tracts.select("tract", "ring"), "tract").withColumn("placed", F.lit("tract"))
    rest = events.join(picked.select(*keys), keys, "left_anti").join(counties.select("fips", "ring"), "fips", "left")
    rest = rest.withColumns({"tract": F.lit(None).cast("string"), "placed": F.when(F.col("ring").isNull(), "none").otherwise("county")})
    every = inside.unionByName(rest, allowMissingColumns=True).withColumn("_key", F.concat_ws("|", *keys_of(keys)))
    out = every.withColumn("_spot", point_in_ring("ring", seed, "_key"))
    return out.withColumn("lat", F.col("_spot.lat")).withColumn("lon", F.col("_spot.lon")).drop("ring", "_spot", "_key", "population")


#: Draws for a point in a ring before its middle is taken.
POINTS = 100


def point_in_ring(ring: str, seed: str, key: str) -> Column:
    """A uniform point (lat, lon) of a ring by hash numbers of the key column; null for a null ring."""
    u = "(cast(conv(substring(md5(concat_ws('|', '{seed}', {key}, k)), 1, 8), 16, 10) as bigint) / 4294967296D)"
    box = {c: f"{f}(transform({ring}, p -> p.{axis}))" for c, f, axis in (("south", "array_min", "lat"), ("north", "array_max", "lat"), ("west", "array_min", "lon"), ("east", "array_max", "lon"))}
    named = ", ".join(f"'{c}', {e}" for c, e in box.items())
    lat, lon = (u.format(seed=f"{seed}-{c}", key=key) for c in ("lat", "lon"))
    drawn = f"named_struct('lat', b.south + {lat} * (b.north - b.south), 'lon', b.west + {lon} * (b.east - b.west))"
    first = f"""aggregate(sequence(1, {POINTS}), cast(null as struct<lat: double, lon: double>), (acc, k) -> case when acc is not null then acc
        else transform(array({drawn}), c -> case when {C._in_ring("c.lat", "c.lon", ring)} then c end)[0] end)"""
    mid = "((b.south + b.north) / 2D)"
    cuts = f"array_sort(array_compact(zip_with({ring}, {C._sides(ring)}, (p, q) -> case when (p.lat > {mid}) <> (q.lat > {mid}) then (q.lon - p.lon) * ({mid} - p.lat) / (q.lat - p.lat) + p.lon end)))"
    spans = f"transform({cuts}, (x, i) -> case when i % 2 = 1 then named_struct('width', x - get(cuts, i - 1), 'at', (x + get(cuts, i - 1)) / 2D) end)"
    middle = f"transform(array({cuts}), cuts -> named_struct('lat', {mid}, 'lon', coalesce(array_max(array_compact({spans.replace(cuts, 'cuts')})).at, {ring}[0].lon)))[0]"
    return F.expr(f"case when {ring} is not null then transform(array(named_struct({named})), b -> coalesce({first}, {middle}))[0] end")


def smooth_draw(asks: DataFrame, history: DataFrame, group: str, value: str, seed: str, keys: list[str], bandwidth: float = 0.2) -> DataFrame:
    """A past value with Gaussian noise of ``bandwidth`` deviations in log space (none below two values)."""
    spread = history.groupBy(group).agg(F.coalesce(F.stddev_samp(F.ln(value)), F.lit(0.0)).alias("_s"))
    drawn = uniform_pick(asks, history.select(group, value, "event_id"), group, "event_id", f"{seed}-base", keys).join(spread, group)
    u1 = F.greatest(hash_u(F.lit(f"{seed}-a"), *keys_of(keys)), F.lit(1e-12))
    noise = F.sqrt(-2.0 * F.ln(u1)) * F.cos(2 * 3.141592653589793 * hash_u(F.lit(f"{seed}-b"), *keys_of(keys)))
    return drawn.withColumn(value, F.exp(F.ln(value) + noise * F.col("_s") * bandwidth)).drop("_s")


def event_days(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    day = F.floor(hash_u(F.lit(seed), *keys_of(keys)) * 365).cast("int") + 1
    return df.withColumn("day", day).withColumn("stable_id", F.concat_ws("_", *keys_of(keys)))


def bootstrap_spearman(sims: DataFrame, n_boot: int, seed: str) -> DataFrame:
    """Rank correlation of unit losses of families A and B when simulations are drawn again, n_boot times."""
    keys = ["unit", "family"]
    numbered = sims.withColumn("i", F.row_number().over(by(keys, "year", "sim_id")) - 1)
    numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    boots = sims.sparkSession.range(n_boot).withColumnRenamed("id", "boot")
    asks = numbered.select(*keys, "i", "n").crossJoin(F.broadcast(boots))  # n_boot rows
    pick = F.floor(hash_u(F.lit(seed), F.col("boot"), F.col("unit"), F.col("family"), F.col("i")) * F.col("n")).cast("int")
    drawn = asks.select(*keys, "boot", pick.alias("i")).join(numbered.select(*keys, "i", "loss"), [*keys, "i"])
    wide = drawn.groupBy("boot", "unit").pivot("family", ["A", "B"]).agg(F.avg("loss"))
    return spearman(wide, ["boot"], "A", "B")
