"""Hash draws: counts, events, epicentres and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormgrid.operators import draws as D
from stormgrid.operators import outages as O
from stormgrid.plans.registry import Tables, query

_U = "cast('0x' || substr(md5(concat_ws('|', {})), 1, 8) as bigint) / 4294967296.0"


# County and state rates, and Poisson numbers by adding terms until their sum reaches the hash number.
_RATES = "rates as (select state, fips, count(*) / cast(max(year) - min(year) + 1 as double) / 20.0 as rate from fx_outages group by 1, 2), srate as (select state, sum(rate) as rate from rates group by 1)"


def _poisson(asks: str, seed: str) -> str:
    u = _U.format(f"'{seed}', sim_id, state, i")
    return f"""parts as (select sim_id, state, rate, greatest(1, ceil(rate / 100))::int as m from ({asks}) q), split as (select sim_id, state, i, {u} as u, greatest(rate, 0) / m as r from parts, lateral (select unnest(range(1, m + 1)) as i) x),
pois(sim_id, state, i, u, r, n, p, c) as (select *, 0, exp(-r), exp(-r) from split union all select sim_id, state, i, u, r, n + 1, p * r / (n + 1), c + p * r / (n + 1) from pois where c < u and n < 400),
counts as (select sim_id, state, sum(n)::bigint as n from (select sim_id, state, i, max(n) as n from pois group by 1, 2, 3) q group by 1, 2)"""


def _chosen(seed: str, keys: str = "sim_id, state, k") -> str:
    """A county by its rate for each event that is asked for."""
    u = _U.format(f"'{seed}-county', {keys}")
    return f"""asks as (select sim_id, state, unnest(range(1, n + 1)) as k from counts where n > 0),
odds as (select state, fips, sum(greatest(rate, 1e-8)) over (partition by state order by fips) / sum(greatest(rate, 1e-8)) over (partition by state) as hi, greatest(rate, 1e-8) / sum(greatest(rate, 1e-8)) over (partition by state) as w from rates),
chosen as (select a.*, o.fips from asks a join odds o using (state) where {u} >= hi - w and ({u} < hi or hi > 1 - 1e-9))"""


def _drawn(seed: str) -> str:
    """A county by its rate, then one of its events: every county with a rate has some."""
    return f"""{_chosen(seed)},
past as (select fips, event_id, duration_min / 60.0 as hours, row_number() over (partition by fips order by event_id) - 1 as i, count(*) over (partition by fips) as n from fx_outages),
drawn as materialized (select sim_id, state, k, c.fips, event_id, hours from chosen c join past p on p.fips = c.fips and p.i = floor({_U.format(f"'{seed}-event', sim_id, state, k")} * p.n))"""


def _pool(name: str, rows: str, group: str) -> str:
    return f"{name} as (select *, row_number() over (partition by {group} order by event_id) - 1 as i, count(*) over (partition by {group}) as n from {rows})"


def _top(name: str, rows: str, group: str) -> str:
    """The upper tenth of each group by mean customers, rounded up."""
    return f"""{name} as (select event_id, state, fips, hours, mean_customers from (select *, row_number() over (partition by {group} order by mean_customers desc, event_id) as r, count(*) over (partition by {group}) as c from {rows}) q where r <= ceil(c * 0.1::double))"""


_SIMS = "select q.sim_id::int as sim_id, state, rate from srate, range(4) q(sim_id)"


def rates(t: Tables):
    return O.county_rate(t.fx_outages).select("state", "fips", (F.col("rate_per_year") / 20.0).alias("rate"))


def counts(t: Tables):
    state = rates(t).groupBy("state").agg(F.sum("rate").alias("rate"))
    sims = t.spark.range(4).select(F.col("id").cast("int").alias("sim_id"))
    return D.poisson_counts(state.crossJoin(sims), ["sim_id", "state"], "rate", "counts")


def history(t: Tables):
    return t.fx_outages.select("event_id", "state", "fips", (F.col("duration_min") / 60.0).alias("hours"))


@query("l08_poisson_counts", f"with recursive {_RATES}, {_poisson(_SIMS, 'counts')} select * from counts")
def l08(t: Tables):
    return counts(t)


@query("l07_bootstrap_events", f"with recursive {_RATES}, {_poisson(_SIMS, 'counts')}, {_drawn('boot')} select sim_id, state, k, fips, event_id, hours, false as pooled from drawn", "hours")
def l07(t: Tables):
    return D.bootstrap_events(counts(t), rates(t), history(t), "boot")


@query("l07_severe_events", f"""with recursive {_RATES}, {_poisson(_SIMS, 'counts')}, {_chosen('severe')}, past as (select *, duration_min / 60.0 as hours from fx_outages), {_top('bad', 'past', 'state')}, {_top('worst', 'bad', 'fips')}, {_pool('pc', 'worst', 'fips')}, {_pool('ps', 'bad', 'state')},
u as (select *, {_U.format("'severe-event', sim_id, state, k")} as x from chosen)
select sim_id, u.state, k, u.fips, coalesce(pc.event_id, ps.event_id) as event_id, coalesce(pc.hours, ps.hours) as hours, pc.event_id is null as pooled from u left join pc on pc.fips = u.fips and pc.n >= 2 and pc.i = floor(x * pc.n) left join ps on ps.state = u.state and ps.i = floor(x * ps.n)""", "hours")
def l07_severe(t: Tables):
    """Events of the severe tenth; counties with fewer than two of them borrow from the state."""
    past = t.fx_outages.select("event_id", "state", "fips", (F.col("duration_min") / 60.0).alias("hours"), "mean_customers")
    return D.bootstrap_events(counts(t), rates(t), past, "severe", severe="mean_customers", least=2)


_YEARS = "select year as sim_id, state, rate * theta as rate from srate join fx_coverage using (state) where year >= 2021"
_YEAR_KEYS = "sim_id, sim_id, state, k"


def year_counts(t: Tables, seed: str):
    """Counts of the years by the states' rates and multipliers; the year is the simulation's number."""
    state = rates(t).groupBy("state").agg(F.sum("rate").alias("rate"))
    years = t.fx_coverage.select("state", "year", "theta").where("year >= 2021")
    scaled = state.join(years, "state").select(F.col("year").alias("sim_id"), "state", (F.col("rate") * F.col("theta")).alias("rate"))
    return D.poisson_counts(scaled, ["sim_id", "state"], "rate", seed)


@query("l07_year_ladder", f"""with recursive {_RATES}, {_poisson(_YEARS, 'ladder')}, {_chosen('ladder', _YEAR_KEYS)}, past as (select *, duration_min / 60.0 as hours from fx_outages where event_id % 7 = 0 and (state <> 'S3' or year < 2021)), {_pool('pc', 'past', 'fips, year')}, {_pool('py', 'past', 'state, year')}, {_pool('ps', 'past', 'state')},
u as (select *, {_U.format(f"'ladder-event', {_YEAR_KEYS}")} as x from chosen)
select sim_id, sim_id as year, u.state, k, u.fips, coalesce(pc.event_id, py.event_id, ps.event_id) as event_id, coalesce(pc.hours, py.hours, ps.hours) as hours, case when pc.event_id is not null then 'county' when py.event_id is not null then 'state_year' else 'state_pooled' end as level from u
left join pc on pc.fips = u.fips and pc.year = sim_id and pc.n >= 2 and pc.i = floor(x * pc.n) left join py on py.state = u.state and py.year = sim_id and py.i = floor(x * py.n) left join ps on ps.state = u.state and ps.i = floor(x * ps.n) where coalesce(pc.event_id, py.event_id, ps.event_id) is not null""", "hours")
def l07_ladder(t: Tables):
    """A study with gaps: a seventh of the events are kept, and one state has none of late years."""
    past = t.fx_outages.where("event_id % 7 = 0 and (state <> 'S3' or year < 2021)").select("event_id", "state", "fips", "year", (F.col("duration_min") / 60.0).alias("hours"))
    asks = year_counts(t, "ladder").withColumn("year", F.col("sim_id"))
    return D.bootstrap_year_events(asks, rates(t), past, "ladder", least=2)


@query("l09_draw_posterior", f"with s as (select distinct sim_id from fx_epicenters), d as (select sim_id, cast(floor({_U.format(chr(39) + 'post' + chr(39) + ', sim_id')} * 40) as bigint) as draw_id from s) select d.sim_id, d.draw_id, count(*) as n from d join events e on e.event_id % 40 = d.draw_id group by 1, 2")
def l09(t: Tables):
    draws = t.events.select((F.col("event_id") % 40).alias("draw_id"), "value")
    out = D.draw_posterior(draws, t.fx_epicenters.select("sim_id").distinct(), 40, "post")
    return out.groupBy("sim_id", "draw_id").agg(F.count("*").alias("n"))


def triangle(west, south, side: float):
    """The half of a square below its diagonal."""
    corners = ((0.0, 0.0), (side, 0.0), (side, side))
    return F.array(*(F.struct((west + x).alias("lon"), (south + y).alias("lat")) for x, y in corners))


def tracts(t: Tables):
    """Three tracts of most counties; every fifth has none."""
    out = t.fx_county.where("cast(fips as int) % 5 <> 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    south, west = F.col("centroid_lat") + F.col("k") * 0.1, F.col("centroid_lon") + F.col("k") * 0.1
    return out.select("fips", F.concat("fips", F.col("k").cast("string")).alias("tract"), (F.col("population") * F.col("k")).alias("population"), triangle(west, south, 0.1).alias("ring"))


def county_rings(t: Tables):
    return t.fx_county.where("cast(fips as int) % 25 <> 0").select("fips", triangle(F.col("centroid_lon"), F.col("centroid_lat"), 1.0).alias("ring"))


def _picked(asks: str, keys: str, seed: str) -> str:
    """Tracts by population, triangles as corner and side, and the first of a hundred draws below the diagonal."""
    u = lambda part, *more: _U.format(", ".join([f"'{seed}-{part}'", keys, *more]))
    return f"""tr as (select fips, fips || k as tract, population * k as w, centroid_lat + k * 0.1 as south, centroid_lon + k * 0.1 as west, 0.1 as side from fx_county, (select unnest([1, 2, 3]) as k) q where cast(fips as int) % 5 <> 0),
cum as (select *, sum(w) over (partition by fips order by tract) / sum(w) over (partition by fips) as hi, sum(w) over (partition by fips order by tract) / sum(w) over (partition by fips) - w / sum(w) over (partition by fips) as lo from tr),
pick as materialized (select a.*, c.tract, coalesce(c.south, n.centroid_lat) as south, coalesce(c.west, n.centroid_lon) as west, coalesce(c.side, 1.0) as side, case when c.tract is not null then 'tract' when cast(a.fips as int) % 25 <> 0 then 'county' else 'none' end as placed
  from {asks} a join (select fips, centroid_lat, centroid_lon from fx_county) n on n.fips = a.fips left join cum c on c.fips = a.fips and {u("tract")} >= lo and ({u("tract")} < hi or hi > 1 - 1e-9)),
spots as (select {keys}, draw_no, {u("lat", "draw_no")} as y, {u("lon", "draw_no")} as x from pick, range(1, 101) r(draw_no)),
firsts as (select {keys}, min(draw_no) as draw_no from spots where y < x group by all),
epi as materialized (select pick.*, case when placed <> 'none' then south + y * side end as lat, case when placed <> 'none' then west + x * side end as lon from pick join firsts using ({keys}) join spots using ({keys}, draw_no))"""


@query("l10_draw_epicenter", f"with {_picked('(select event_id, fips from fx_outages)', 'event_id', 'epi')} select event_id, tract, placed, lat, lon from epi", "lat lon")
def l10(t: Tables):
    out = D.epicenters(t.fx_outages.select("event_id", "fips"), tracts(t), county_rings(t), "epi", ["event_id"])
    return out.select("event_id", "tract", "placed", "lat", "lon")


@query("l12_smooth_draw", f"""with past as (select fips, event_id, duration_min / 60.0 as hours, row_number() over (partition by fips order by event_id) - 1 as i, count(*) over (partition by fips) as n from fx_outages where duration_min > 0),
spread as (select fips, coalesce(stddev_samp(ln(hours)), 0) as s from past group by 1), asks as (select fips, event_id as ask from fx_outages)
select ask, a.fips, exp(ln(hours) + sqrt(-2.0 * ln(greatest({_U.format("'kde-a', ask")}, 1e-12))) * cos(2 * 3.141592653589793 * {_U.format("'kde-b', ask")}) * s * 0.2) as hours from asks a join spread using (fips) join past p on p.fips = a.fips and p.i = floor({_U.format("'kde-base', ask")} * p.n)""", "hours")
def l12(t: Tables):
    asks = t.fx_outages.select("fips", F.col("event_id").alias("ask"))
    past = history(t).where("hours > 0").select("fips", "event_id", "hours")
    return D.smooth_draw(asks, past, "fips", "hours", "kde", ["ask"]).select("ask", "fips", "hours")


@query("l14_event_days", f"select event_id, cast(floor({_U.format(chr(39) + 'days' + chr(39) + ', fips, year, event_id')} * 365) as int) + 1 as day, concat_ws('_', fips, year, event_id) as stable_id from fx_outages")
def l14(t: Tables):
    return D.event_days(t.fx_outages, "days", ["fips", "year", "event_id"]).select("event_id", "day", "stable_id")


@query("a36_bootstrap_spearman", f"""with s as (select unit, family, loss, row_number() over (partition by unit, family order by year, sim_id) - 1 as i, count(*) over (partition by unit, family) as n from fx_sims),
d as (select boot, a.unit, a.family, b.loss from s a, range(20) r(boot) join s b on b.unit = a.unit and b.family = a.family and b.i = floor({_U.format("'boot', boot, a.unit, a.family, a.i")} * a.n)),
w as (select boot, unit, avg(loss) filter (family = 'A') as x, avg(loss) filter (family = 'B') as y from d group by 1, 2),
k as (select boot, rank() over (partition by boot order by x) + (count(*) over (partition by boot, x) - 1) / 2.0 as rx, rank() over (partition by boot order by y) + (count(*) over (partition by boot, y) - 1) / 2.0 as ry from w where x is not null and y is not null)
select boot, corr(rx, ry) as rho, count(*) as n from k group by 1 having count(*) >= 3""", "rho")
def a36(t: Tables):
    return D.bootstrap_spearman(t.fx_sims, 20, "boot").select("boot", "rho", "n")


@query("j21_draw_year_events", f"""with recursive {_RATES}, {_poisson(_YEARS, 'year')}, {_drawn('year')}, {_picked("drawn", "sim_id, state, k", "year")}
select sim_id, state, k, fips, event_id, lat, lon, least(150.0, greatest(5.0, sqrt(least(hours * 20, customers) / (greatest(customers / area_km2, 1e-6) * pi())))) as radius_km from epi join (select fips, customers, area_km2 from fx_county) c using (fips)""", "lat lon radius_km")
def j21(t: Tables):
    """Rates by multiplier, counts, events, radii and epicentres in one chain."""
    from stormgrid.functions import columns as C

    n = year_counts(t, "year")
    events = D.bootstrap_events(n, rates(t), history(t), "year")
    placed = D.epicenters(events, tracts(t), county_rings(t), "year", ["sim_id", "state", "k"])
    county = t.fx_county.select("fips", "customers", "area_km2")
    radius = C.impact_radius(F.col("hours") * 20, F.lit(1.0), F.col("customers") / F.col("area_km2"), F.col("customers"), 5, 150)
    return placed.join(county, "fips").select("sim_id", "state", "k", "fips", "event_id", "lat", "lon", radius.alias("radius_km"))
