"""Crowded places, where plans that list every pair would not end, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stormgrid.operators import disks as D
from stormgrid.operators import removal as R
from stormgrid.operators import sites as X
from stormgrid.operators import spatial as S
from stormgrid.operators import windows as W
from stormgrid.operators.ranking import sample_n
from stormgrid.sources import tables as T


def km(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, a)))


def overlap(r1, r2, d):
    if d >= r1 + r2:
        return 0.0
    if d <= abs(r1 - r2):
        return 1.0
    clip = lambda x: max(-1.0, min(1.0, x))
    lens = r1 * r1 * math.acos(clip((d * d + r1 * r1 - r2 * r2) / (2 * d * r1))) + r2 * r2 * math.acos(clip((d * d + r2 * r2 - r1 * r1) / (2 * d * r2)))
    return (lens - 0.5 * math.sqrt(max(0.0, (r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)))) / (math.pi * min(r1, r2) ** 2)


def windows_of(n, seed):
    rng = random.Random(seed)
    kinds = [("urban", 10.0), ("suburban", 30.0), ("rural", 80.0)]
    return [(f"w{i}", *kinds[i % 3], 35 + rng.random() * 2, -100 + rng.random() * 3, i) for i in range(n)]


SCHEMA = "window_id string, window_stratum string, radius_km double, center_lat double, center_lon double, ord long"


@pytest.mark.parametrize("quota", [None, 3])
def test_spaced_windows_of_a_crowd(spark, quota):
    rows = windows_of(2000, 1)
    kept = []
    for w in rows:
        if quota and sum(k[1] == w[1] for k in kept) == quota:
            continue
        if all(overlap(k[2], w[2], km(*k[3:5], *w[3:5])) <= 0.25 for k in kept if quota is None or k[1] == w[1]):
            kept.append(w)
    quotas = quota and spark.createDataFrame([(s, quota) for s in ("urban", "suburban", "rural")], "window_stratum string, quota int")
    got = W.spaced_windows(spark.createDataFrame(rows, SCHEMA), 0.25, quotas, first=100)
    assert sorted(r.ord for r in got.collect()) == [k[5] for k in kept]


NODES = "graph_id string, group string, node_id long, lat double, lon double, capacity double"


def placed_graphs(seed):
    """Two rings with chords and a path, of two groups."""
    rng = random.Random(seed)
    nodes = [(g, g[0], 100 * k + i, 35 + rng.random(), -100 + rng.random(), float(rng.randrange(5))) for k, g in enumerate(("a1", "a2", "b1")) for i in range(7)]
    edges = [(g, 100 * k + i, 100 * k + (i + s) % 7, 1.0 + rng.randrange(4)) for k, g in enumerate(("a1", "a2")) for i in range(7) for s in (1, 3)]
    return nodes, edges + [("b1", 200 + i, 201 + i, 1.0) for i in range(5)]


def test_events_on_small_graphs_as_on_large_ones(spark):
    nodes, edges = placed_graphs(3)
    events = [(i, "ab"[i % 2], 35 + i % 7 / 7, -100 + i % 5 / 5, 10.0 + i) for i in range(20)]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")
    ev = spark.createDataFrame(events, "case_id long, group string, lat double, lon double, radius_km double")
    hours = spark.createDataFrame([(i, i % 2, h) for i in range(20) for h in range(i % 3, i % 5 + 2)], "case_id long, sim_id int, hour long")
    rows = lambda d: {tuple(r[:2]): tuple(round(float(x), 7) for x in r[2:]) for r in d.collect()}
    few, many = R.event_loss(n, e, ev), R.event_loss(n, e, ev, small=0)
    assert few.columns == many.select(few.columns).columns and few.count() == 30
    assert rows(few) == rows(many.select(few.columns))
    few, many = R.event_timeline_loss(n, e, ev, hours), R.event_timeline_loss(n, e, ev, hours, small=0)
    assert few.count() == 3 and rows(few) == rows(many.select(few.columns))
    lost = {r.case_id: r for r in R.event_loss(n, e, ev).where("graph_id = 'b1'").collect()}
    for i, g, lat, lon, radius in events:
        if g == "b":
            assert lost[i].n_removed == sum(km(lat, lon, *r[3:5]) <= radius for r in nodes if r[0] == "b1")


def test_removals_on_small_graphs_as_on_large_ones(spark):
    nodes, edges = placed_graphs(4)
    rng = random.Random(5)
    removed = [(g, c, 100 * k + i) for k, g in enumerate(("a1", "a2", "b1")) for c in range(4) for i in rng.sample(range(7), 1 + 2 * c)]
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")
    gone = spark.createDataFrame(removed, "graph_id string, case_id int, node_id long")
    few, many = R.removal_loss(n, e, gone, weight="weight"), R.removal_loss(n, e, gone, weight="weight", small=0)
    rows = lambda d: {tuple(r[:2]): tuple(round(float(x), 7) for x in r[2:]) for r in d.select(few.columns).collect()}
    assert few.count() == 12 and rows(few) == rows(many)


def test_disk_sums_of_crowds_poles_and_the_date_line(spark, monkeypatch):
    monkeypatch.setattr(D, "CENTERS", 40)
    monkeypatch.setattr(D, "POINTS", 300)
    rng = random.Random(7)
    spots = [(35.0, -100.0, 0.5), (0.0, 179.9, 0.6), (89.5, 10.0, 0.4), (-45.2, -180.0, 1.5)]
    place = lambda: (lambda s: (min(90.0, s[0] + rng.uniform(-1, 1) * s[2]), (s[1] + rng.uniform(-1, 1) * s[2] + 180) % 360 - 180))(rng.choice(spots))
    points = [(i, "ab"[i % 2], *place(), float(i % 9)) for i in range(1500)] + [(-1, "a", None, 0.0, 1.0)]
    disks = [(i, "ab"[i % 2], *place(), rng.choice([0.0, 3.0, 20.0, 90.0, 400.0, 20100.0][: 5 + (i % 40 == 0)])) for i in range(200)]
    p = spark.createDataFrame(points, "pid long, g string, lat double, lon double, v double")
    c = spark.createDataFrame(disks, "did long, g string, clat double, clon double, radius double")
    for group in (None, "g"):
        got = {r.did: (r.n, r.v, r.least) for r in D.disk_sums(p, c, "did", ["v"], "pid", group).collect()}
        want = {}
        for i, g, lat, lon, radius in disks:
            held = [q for q in points[:-1] if (group is None or q[1] == g) and km(lat, lon, q[2], q[3]) <= radius]
            if held:
                want[i] = (len(held), sum(q[4] for q in held), min(q[0] for q in held))
        assert got == want


def test_nearest_of_a_crowd_and_from_afar(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 100)
    rng = random.Random(9)
    targets = [(f"t{i}", 35 + rng.random() * 0.3, -100 + rng.random() * 0.3) for i in range(600)] + [(f"u{i}", 35.1, -100.1) for i in range(50)] + [("x", 10.0, 179.9)]
    points = [(f"p{i}", *rng.choice([(35.15, -99.9), (38.0, -101.0), (12.0, -179.5), (35.1, -100.1)])) for i in range(40)] + targets[:20] + targets[600:610]
    t, p = spark.createDataFrame(targets, "tid string, lat double, lon double"), spark.createDataFrame(points, "own string, lat double, lon double")

    def want(most):
        best = {k: min((round(km(a, b, c, d), 9), o) for o, c, d in targets if o != k) for k, a, b in points}
        return {k: (v if v[0] <= most else (None, None)) for k, v in best.items()}

    rows = lambda d: {r.own: (r.nearest_km if r.nearest_km is None else round(r.nearest_km, 9), r.nearest_id) for r in d.collect()}
    assert rows(S.nearest_to(p, t, "own", "tid")) == want(1e9)
    assert rows(S.nearest(p, t, 50.0, "own", "tid")) == want(50.0)


def test_first_members_of_crowded_windows(spark):
    rng = random.Random(11)
    points = spark.createDataFrame([(i, 35 + rng.random(), -100 + rng.random()) for i in range(900)], "pid long, lat double, lon double")
    windows = spark.createDataFrame([(f"w{i}", r, 35 + rng.random(), -100 + rng.random()) for i in range(20) for r in [(1.0, 5.0, 60.0)[i % 3]]], "window_id string, radius_km double, clat double, clon double")
    every = S.within_radius(points, windows, F.col("radius_km"))
    want = {tuple(r) for r in sample_n(every, 5, "s", ["window_id"], "pid").select("window_id", "pid").collect()}
    assert want and {tuple(r) for r in W.first_members(points, windows, 5, "s", "pid", first=20).collect()} == want


def test_drawn_sites_where_old_ones_fill_the_state(spark):
    square = [(-100.0, 35.0), (-99.0, 35.0), (-99.0, 36.0), (-100.0, 36.0)]
    areas = [("S", f"a{i}", [(x + i, y) for x, y in square], float(i + 1)) for i in range(2)]
    a = spark.createDataFrame(areas, "state string, area_id string, ring array<struct<lon: double, lat: double>>, w double")
    old = spark.createDataFrame([(f"o{i}", "S", 35 + i % 20 / 20, -100 + i // 20 / 20, 1.0) for i in range(400)], "id string, state string, lat double, lon double, capacity double")
    got = X.expand_drawn(old, a, "w", 0.05, "seed", "even", tries=16).where("is_cf_added").collect()
    draws = X.planar(X.drawn_points(a, spark.createDataFrame([("S", 20 * 16)], "state string, n long"), "w", "seed")).orderBy("ord").collect()
    taken, spots = [], [(r.x, r.y) for r in X.planar(old).collect()]
    for r in draws:
        if len(taken) < 20 and all(math.hypot(r.x - x, r.y - y) >= X.SPACING_KM for x, y in spots):
            taken.append(r.id)
            spots.append((r.x, r.y))
    assert taken and sorted(r.id for r in got) == sorted(taken)


def test_networks_of_many_graphs_share_folders(spark, tmp_path):
    path = str(tmp_path / "net")
    rows = lambda names, v: spark.createDataFrame([(2023, g, v) for g in names], "year int, graph_id string, v int")
    names = [f"g{i}" for i in range(300)]
    T.write_network(*(rows(names, 1) for _ in range(3)), path)
    T.write_network(*(rows(names[:5] + ["new"], 2) for _ in range(3)), path)
    assert len(list((tmp_path / "net" / "nodes" / "year=2023").iterdir())) <= T.SHARDS
    for part in T.read_network(spark, path, 2023):
        assert sorted((r.graph_id, r.v) for r in part.collect()) == sorted([(g, 2 if g in names[:5] else 1) for g in names] + [("new", 2)])
    assert sorted((r.graph_id, r.v) for r in T.read_network(spark, path, graphs=["g1", "g9"])[1].collect()) == [("g1", 2), ("g9", 1)]
