"""Column expressions: outage, severity, distance and scenario arithmetic. All are built-ins."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
MERCATOR_M = 6378137.0

# Severity tiers as (hours, share of customers).
TIERS = {"tier1": (2.0, 0.005), "tier2": (4.0, 0.01), "tier3": (12.0, 0.02), "tier4": (24.0, 0.05)}

# Radii in km of the window strata.
STRATUM_RADII = {"urban": 10.0, "suburban": 30.0, "rural": 80.0}

# States of the study's regions, close to the census regions.
REGIONS = {
    "northeast": "CT DE MA MD ME NH NJ NY PA RI VT DC",
    "midwest": "IL IN MI OH WI IA KS MN MO NE ND SD",
    "south": "AL AR FL GA KY LA MS NC OK SC TN TX VA WV",
    "west": "AZ CO ID MT NV NM UT WY AK CA HI OR WA",
}

# Counties of Connecticut before the planning regions.
LEGACY_CT = ["09001", "09003", "09005", "09007", "09009", "09011", "09013", "09015"]


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def to_number(c: Column, default: float | None = None) -> Column:
    """Text as a number; what is none, or not a number, becomes the default."""
    x = F.nanvl(c.cast("string").try_cast("double"), F.lit(None).cast("double"))
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def capacity(n_l1: Column, n_l2: Column, n_dc: Column) -> Column:
    return 5.0 * n_l1 + 25.0 * n_l2 + 300.0 * n_dc


def norm_fips(c: Column, width: int = 5) -> Column:
    return F.lpad(to_number(c).cast("bigint").cast("string"), width, "0")


def clean_key(c: Column, collapse: bool = False) -> Column:
    key = F.lower(F.trim(c))
    return F.regexp_replace(key, r"\s+", " ") if collapse else key


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def end_time(start: Column, minutes: Column) -> Column:
    seconds = F.round(minutes * 60.0, 6).cast("decimal(18,6)")
    return start + F.make_interval(secs=seconds)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60e6


def log_logit(minutes: Column, share: Column) -> tuple[Column, Column]:
    p = clip(share, 0.001, 0.999)
    return F.ln(minutes + 0.1), F.ln(p / (1.0 - p))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2.0), 2
    )
    return 2.0 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def mercator_m(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2.0)) * MERCATOR_M


def disk_overlap(r1: Column, r2: Column, d: Column) -> Column:
    """Share of the smaller disk that the other covers."""
    small = F.least(r1, r2)
    c1 = clip((d * d + r1 * r1 - r2 * r2) / (2.0 * d * r1), -1, 1)
    c2 = clip((d * d + r2 * r2 - r1 * r1) / (2.0 * d * r2), -1, 1)
    k = (r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)
    lens = r1 * r1 * F.acos(c1) + r2 * r2 * F.acos(c2) - 0.5 * F.sqrt(F.greatest(F.lit(0.0), k))
    return (
        F.when(d >= r1 + r2, 0.0)
        .when(d <= F.abs(r1 - r2), 1.0)
        .otherwise(clip(lens / (math.pi * small * small), 0, 1))
    )


def min_separation(r1: str, r2: str, most: float, steps: int = 40) -> Column:
    """The centre distance from which disks overlap by at most ``most``, by bisection."""
    mid = "(s.lo + s.hi) / 2D"
    c1 = f"greatest(-1D, least(1D, (m * m + {r1} * {r1} - {r2} * {r2}) / (2D * m * {r1})))"
    c2 = f"greatest(-1D, least(1D, (m * m + {r2} * {r2} - {r1} * {r1}) / (2D * m * {r2})))"
    k = f"greatest(0D, ({r1} + {r2} - m) * (m + {r1} - {r2}) * (m - {r1} + {r2}) * (m + {r1} + {r2}))"
    lens = f"({r1} * {r1} * acos({c1}) + {r2} * {r2} * acos({c2}) - sqrt({k}) / 2D) / (pi() * pow(least({r1}, {r2}), 2))"
    share = f"case when m <= abs({r1} - {r2}) then 1D else {lens} end"
    halved = f"transform(array({mid}), m -> case when {share} > {most}D then named_struct('lo', m, 'hi', s.hi) else named_struct('lo', s.lo, 'hi', m) end)[0]"
    return F.expr(f"aggregate(sequence(1, {steps}), named_struct('lo', 0D, 'hi', {r1} + {r2}), (s, i) -> {halved}, s -> s.hi)")


def in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def bbox_meets(south: Column, west: Column, north: Column, east: Column, box: tuple[float, float, float, float]) -> Column:
    return (south <= box[2]) & (north >= box[0]) & (west <= box[3]) & (east >= box[1])


def in_ring(lat: str, lon: str, ring: str) -> Column:
    """Even-odd rule on a ring, an array of structs lon, lat."""
    return F.expr(_in_ring(lat, lon, ring))


def _sides(ring: str) -> str:
    """Each point of a ring with the next one."""
    return f"concat(slice({ring}, 2, size({ring}) - 1), slice({ring}, 1, 1))"


def _in_ring(lat: str, lon: str, ring: str) -> str:
    crosses = (
        f"((a.lat > {lat}) <> (b.lat > {lat})) and "
        f"{lon} < (b.lon - a.lon) * ({lat} - a.lat) / (b.lat - a.lat + 1e-15D) + a.lon"
    )
    sides = f"zip_with({ring}, {_sides(ring)}, (a, b) -> coalesce({crosses}, false))"
    return f"aggregate({sides}, false, (odd, c) -> odd <> c)"


def rings_meet(one: str, other: str) -> Column:
    """Whether two polygons (rings) share a point: a corner inside the other, or sides that cross or touch."""
    turn = "({b}.lon - {a}.lon) * ({c}.lat - {a}.lat) - ({b}.lat - {a}.lat) * ({c}.lon - {a}.lon)"
    side = lambda a, b, c: turn.format(a=a, b=b, c=c)
    lines = (
        f"signum({side('s.p', 's.q', 't.p')}) * signum({side('s.p', 's.q', 't.q')}) <= 0 and "
        f"signum({side('t.p', 't.q', 's.p')}) * signum({side('t.p', 't.q', 's.q')}) <= 0 and "
        "greatest(s.p.lon, s.q.lon) >= least(t.p.lon, t.q.lon) and greatest(t.p.lon, t.q.lon) >= least(s.p.lon, s.q.lon) and "
        "greatest(s.p.lat, s.q.lat) >= least(t.p.lat, t.q.lat) and greatest(t.p.lat, t.q.lat) >= least(s.p.lat, s.q.lat)"
    )
    pairs = [f"zip_with({r}, {_sides(r)}, (p, q) -> named_struct('p', p, 'q', q))" for r in (one, other)]
    return F.expr(
        f"exists({one}, v -> {_in_ring('v.lat', 'v.lon', other)}) or exists({other}, v -> {_in_ring('v.lat', 'v.lon', one)}) "
        f"or exists({pairs[0]}, s -> exists({pairs[1]}, t -> {lines}))"
    )


def stratum_from_ruca(code: Column) -> Column:
    """Codes are rounded (halves to even) first."""
    code = F.rint(code.cast("double"))
    return F.when(code <= 3, "urban").when(code <= 6, "suburban").when(code > 6, "rural").otherwise("suburban")


def stratum_from_urban_share(share: Column) -> Column:
    """A share that is null or not a finite number gives suburban."""
    share = F.when(F.abs(share) < float("inf"), share)  # NaN sorts above infinity
    return F.when(share >= 0.75, "urban").when(share <= 0.10, "rural").otherwise("suburban")


def stratum_from_radius(r: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, km in STRATUM_RADII.items():
        out = F.when(F.abs(r - km) <= 0.5, name).otherwise(out)
    return out


# State names and the codes that they become; other names become their first two letters.
STATE_NAMES = """alabama AL, alaska AK, arizona AZ, arkansas AR, california CA, colorado CO, connecticut CT, delaware DE, florida FL, georgia GA,
iowa IA, maine ME, maryland MD, massachusetts MA, michigan MI, minnesota MN, mississippi MS, missouri MO, montana MT, nebraska NE, nevada NV,
new hampshire NH, new jersey NJ, new mexico NM, new york NY, north carolina NC, north dakota ND, ohio OH, oklahoma OK, oregon OR, pennsylvania PA,
rhode island RI, south carolina SC, south dakota SD, tennessee TN, texas TX, utah UT, vermont VT, virginia VA, washington WA, west virginia WV,
wisconsin WI, wyoming WY, district of columbia DC"""


def state_code(name: Column) -> Column:
    """The two-letter code of a state's name or code; UNK for null, blank and UNK."""
    bare = F.trim(name)
    pairs = [x.rsplit(" ", 1) for x in STATE_NAMES.replace("\n", " ").split(", ")]
    codes = F.create_map(*(F.lit(v) for pair in pairs for v in pair))
    key = F.replace(F.lower(bare), F.lit("."), F.lit(""))
    known = F.coalesce(F.try_element_at(codes, key), F.substring(F.upper(bare), 1, 2))
    return F.when(bare.isNull() | (bare == "") | (bare == "UNK"), "UNK").when(F.length(bare) == 2, F.upper(bare)).otherwise(known)


def region_of(code: Column) -> Column:
    out = F.lit("other")
    for name, states in REGIONS.items():
        out = F.when(code.isin(states.split()), name).otherwise(out)
    return out


def impact_radius(customers: Column, coverage: Column, density: Column, most: Column, low: float = 0.0, high: float = 1e9) -> Column:
    """Radius in km of the disk whose customers are out: capped at the county's total."""
    theta = clip(F.coalesce(coverage, F.lit(1.0)), 1e-3, 1)
    rho = F.greatest(density, F.lit(1e-6))
    return clip(F.sqrt(F.least(customers / theta, most) / (rho * math.pi)), low, high)


def recovery_loss(loss: Column, hours: Column, model: str) -> Column:
    if model == "constant":
        return loss * hours
    if model == "exponential":
        tau = hours / 2.0
        return F.when(hours > 0, loss * tau * (1.0 - F.exp(-hours / tau))).otherwise(0.0)
    raise ValueError(f"no recovery model {model}")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def severity_flags(hours: Column, share: Column, customers: Column) -> dict[str, Column]:
    """Threshold flags: duration, share, customers, and pairs of duration and share."""
    out = {f"dur_{h}h": flag(hours >= h) for h in (2, 4, 8, 12, 24)}
    out |= {f"pct_{p}": flag(share >= p / 100) for p in (1, 2, 5, 10)}
    out |= {f"abs_{n}": flag(customers >= n) for n in (100, 1000, 10000)}
    return out | {f"dur_{h}h_pct_{p}": flag((hours >= h) & (share >= p / 100)) for h, p in product((4, 8, 12), (1, 5))}


def severity_tiers(hours: Column, share: Column) -> dict[str, Column]:
    return {k: flag((hours >= h) & (share >= p)) for k, (h, p) in TIERS.items()}


def severity_grid(hours: Column, customers: Column, share: Column) -> dict[str, Column]:
    """27 definitions: hours above T, and customers above A or share above P."""
    grid = product((4, 8, 12), (500, 1000, 5000), (1, 2, 5))
    return {f"t{t}_a{a}_p{p}": flag((hours > t) & ((customers > a) | (share > p / 100))) for t, a, p in grid}


def hash_seed(*parts: Column) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_u(*parts: Column) -> Column:
    """A uniform number in [0, 1) that depends on the parts only."""
    return hash_seed(*parts) / F.lit(4294967296.0)


def event_date(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def corr_strength(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate").when(a < 0.7, "strong")
        .when(a.isNotNull(), "very strong")
    )


def degree_proxy_loss(removed: Column, total: Column, hours: Column, power: float = 0.8) -> Column:
    return F.when(total > 0, clip(F.pow(removed / total, power), 0, 1) * hours).otherwise(0.0)
