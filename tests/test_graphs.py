"""Weighted centralities, removals, nearest points and hourly streams against plain loops."""

import heapq
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stormgrid.operators import centrality as E
from stormgrid.operators import networks as N
from stormgrid.operators import removal as R
from stormgrid.operators import spatial as S
from stormgrid.operators.filters import efficiency_at
from stormgrid.streaming import outages as T

NODES, EDGES = "graph_id string, node_id int, capacity double", "graph_id string, src int, dst int, weight double"


def random_graphs(seed, count, most):
    """Graphs with many equal path lengths, lone nodes and several components."""
    rnd, nodes, edges = random.Random(seed), [], []
    for g in range(count):
        n = rnd.randrange(1, most)
        nodes += [(f"g{g}", k, float(rnd.randrange(9))) for k in range(n)]
        edges += [(f"g{g}", a, b, rnd.randrange(1, 5) / 10) for a in range(n) for b in range(a + 1, n) if rnd.random() < 2.2 / n]
    return nodes, edges


def neighbours(edges, graph, weighted):
    out = {}
    for g, a, b, w in edges:
        if g == graph:
            w = Fraction(round(w * 10), 10) if weighted else Fraction(1)
            out.setdefault(a, {})[b] = w
            out.setdefault(b, {})[a] = w
    return out


def search(beside, source, gone=()):
    """Distances and numbers of shortest paths, by Dijkstra on fractions."""
    dist, paths, heap, done = {source: Fraction(0)}, {source: 1}, [(Fraction(0), source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        for w, weight in beside.get(v, {}).items():
            if w in gone:
                continue
            if w not in dist or d + weight < dist[w]:
                dist[w], paths[w] = d + weight, paths[v]
                heapq.heappush(heap, (d + weight, w))
            elif d + weight == dist[w] and w not in done:
                paths[w] += paths[v]
    return dist, paths


def plain_betweenness(nodes, beside):
    found = {v: search(beside, v) for v in nodes}
    out = dict.fromkeys(nodes, Fraction(0))
    for s in nodes:
        for t in nodes:
            if s == t or t not in found[s][0]:
                continue
            for v in nodes:
                if v not in (s, t) and v in found[s][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]:
                    out[v] += Fraction(found[s][1][v] * found[v][1][t], found[s][1][t])
    n = len(nodes)
    return {v: float(x / ((n - 1) * (n - 2))) if n > 2 else 0.0 for v, x in out.items()}


@pytest.mark.parametrize("weight", [None, "weight"])
def test_betweenness_equals_a_plain_count(spark, weight):
    nodes, edges = random_graphs(5, 8, 14)
    got = {(r.graph_id, r.node_id): r.betweenness for r in E.betweenness(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), weight).collect()}
    assert len(got) == len(nodes)
    for g in {n[0] for n in nodes}:
        want = plain_betweenness([k for h, k, _ in nodes if h == g], neighbours(edges, g, weight))
        assert {k: got[g, k] for k in want} == pytest.approx(want, abs=1e-9)


def test_betweenness_refuses_weights_of_nothing(spark):
    nodes, edges = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 1.0)], NODES), spark.createDataFrame([("g", 1, 2, 0.0)], EDGES)
    with pytest.raises(ValueError, match="positive"):
        E.betweenness(nodes, edges, "weight")


@pytest.mark.parametrize("weight", [None, "weight"])
def test_removals_equal_whole_searches(spark, weight):
    nodes, edges = random_graphs(8, 6, 13)
    rnd, removed = random.Random(2), []
    for g in sorted({n[0] for n in nodes}):
        own = [k for h, k, _ in nodes if h == g]
        for case in range(8):
            size = len(own) if case == 0 else rnd.randrange(1, len(own) + 1)
            removed += [(g, case, k) for k in rnd.sample(own, size)] + [(g, case, 99)]
    out = R.removal_loss(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(removed, "graph_id string, case_id int, node_id int"), weight=weight)
    rows = out.collect()
    assert len(rows) == len({r[:2] for r in removed})
    searched = whole = 0
    for r in rows:
        own = [k for h, k, _ in nodes if h == r.graph_id]
        beside = neighbours(edges, r.graph_id, weight)
        gone = {k for h, c, k in removed if (h, c) == (r.graph_id, r.case_id)} - {99}
        live, n = [k for k in own if k not in gone], len(own)
        e0 = sum(1 / d for s in own for t, d in search(beside, s)[0].items() if t != s) / (n * (n - 1)) if n > 1 else 0
        m = len(live)
        after = {s: search(beside, s, gone)[0] for s in live}
        e1 = sum(1 / d for s in live for t, d in after[s].items() if t != s) / (m * (m - 1)) if m > 1 else 0
        loss = max(0.0, float(e0 - e1))
        largest = max((len(x) for x in after.values()), default=0)
        capacity = sum(c for h, k, c in nodes if h == r.graph_id and k in gone)
        assert (r.loss, r.lcc, r.n_removed, r.capacity_removed) == pytest.approx((loss, largest / n, len(gone), capacity), abs=1e-9)
        assert r.relative == pytest.approx(loss / float(e0) if e0 else 0.0, abs=1e-9)
        searched, whole = searched + r.searched, whole + m * (m - 1)
    assert 0 < searched < whole / 2


def test_attack_curve_of_random_orders(spark):
    nodes, edges = random_graphs(3, 3, 12)
    df = spark.createDataFrame(nodes, NODES)
    orders = E.random_orders(df, 4, "x").withColumn("strategy", F.lit("random"))
    got = R.attack_curve(df, spark.createDataFrame(edges, EDGES), orders, [0.1, 1.0]).collect()
    assert len(got) == 6 and all(r.n_sims == 4 for r in got)
    assert all((r.loss_pct, r["std"]) == (100.0, 0.0) for r in got if r.pct == 1.0)
    with pytest.raises(ValueError, match="no strategy"):
        E.attack_scores(df, df, "luck")


def test_features_of_a_triangle_with_a_tail(spark):
    nodes = spark.createDataFrame([("g", k, float(k)) for k in range(1, 6)], NODES)
    edges = spark.createDataFrame([("g", 1, 2, 1.0), ("g", 2, 3, 1.0), ("g", 1, 3, 0.125), ("g", 3, 4, 1.0)], EDGES)
    (f,) = E.global_features(nodes, edges, extended=True).collect()
    # Corners 1 and 2 have one pair of neighbours, corner 3 has three pairs; the cube root of 1/8 is 1/2.
    assert f.avg_clustering == pytest.approx((0.5 + 0.5 + 0.5 / 3) / 5)
    assert (f.n_nodes, f.n_edges, f.diameter, f.n_components, f.max_degree) == (5, 4, 2, 2, 3)
    assert f.avg_shortest_path == pytest.approx((1.0 + 0.125 + 1.125 + 1.0 + 2.0 + 1.0) / 6)
    assert f.algebraic_connectivity == pytest.approx(0.0, abs=1e-9)
    (c,) = E.network_characteristics(nodes, edges).collect()
    assert (c.is_connected, c.num_components, c.num_edges, c.min_degree) == (False, 2, 4, 0)


def km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def test_nearest_anywhere_equals_brute_force(spark):
    rnd = random.Random(6)
    points = [(k, rnd.uniform(25, 50), rnd.uniform(-125, -66)) for k in range(60)]
    points += [(100, 0.0, 179.9), (101, 0.0, -179.8), (102, 89.9, 10.0), (103, -89.0, 100.0), (104, 52.0, -175.0), (105, -40.0, 60.0), (106, 30.0, -100.0), (107, 30.0, -100.0)]
    df = spark.createDataFrame([*points, (200, None, 1.0)], "id bigint, lat double, lon double")
    got = {r["id"]: r for r in S.nearest_other(df, "id").collect()}
    assert len(got) == len(points) + 1 and got[200].nearest_km is None
    for i, *a in points:
        best = min((km(a, b), j) for j, *b in points if j != i)
        assert got[i].nearest_km == pytest.approx(best[0], abs=1e-6) and km(a, next(b for j, *b in points if j == got[i].nearest_id)) == pytest.approx(best[0], abs=1e-6)
    far = S.nearest_to(df.where("id = 105"), df.where("id = 102"), "id", "id").collect()
    assert far[0].nearest_id == 102 and S.nearest_to(df.where("id = 105"), df.where("id = 105"), "id", "id").collect()[0].nearest_id is None


def test_hourly_stream_with_late_rows_equals_the_batch(spark, tmp_path):
    """Rows an hour late, and outages of ten days, change no closed hour."""
    base = 1_700_000_000
    rnd = random.Random(1)
    minutes = sorted(rnd.randrange(60 * 24 * 20) for _ in range(300))
    rows = [(m, rnd.choice([0.0, 5.0, 90.0, 60.0 * 24 * 10]), rnd.choice("AB"), float(k % 7)) for k, m in enumerate(minutes)]
    schema = "m int, duration_min double, state string, mean_customers double"
    # Each part brings rows that began up to an hour before the newest of the parts before it.
    parts = [rows[:100]] + [[(rows[at - 1][0] - rnd.randrange(60), 30.0, "A", 1.0) for _ in range(5)] + rows[at : at + 100] for at in (100, 200)]
    for part, own in enumerate([*parts, [(60 * 24 * 90, 0.0, "A", 1.0)]]):
        df = spark.createDataFrame(own, schema).withColumn("start_time", F.timestamp_seconds(F.lit(base) + F.col("m") * 60)).drop("m")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")
    whole = spark.read.schema(df.schema).parquet(*(f"{tmp_path}/in{k}" for k in range(4)))
    batch = {(r.hour, r.state): (r.n, r.customers) for r in T.hourly_active(whole).collect()}
    source = f"{tmp_path}/all"
    for part in range(4):
        spark.read.parquet(f"{tmp_path}/in{part}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        query = T.hourly_active_stream(stream, 1, 24 * 11).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.hour, r.state): (r.n, r.customers) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = max(batch)[0]
    assert {k: v for k, v in batch.items() if k[0] != last} == got and len(got) > 500


def test_every_asked_removal_has_an_efficiency(spark):
    samples = spark.createDataFrame([("g", 2.0, 0.6), ("g", 2.0, 0.4), ("g", 6.0, 0.2)], "graph_id string, x double, y double")
    base = spark.createDataFrame([("g", 0.9, 10), ("h", 0.7, 4)], "graph_id string, baseline double, n int")
    asked = spark.createDataFrame([("g", float(x)) for x in (0, 1, 2, 4, 6, 8, 20)] + [("h", 3.0)], "graph_id string, x double")
    got = {(r.graph_id, r.x): r.y for r in efficiency_at(asked, samples, base, "graph_id").collect()}
    want = {("g", 0.0): 0.9, ("g", 1.0): 0.9 - 0.3 * 0.5, ("g", 2.0): 0.5, ("g", 4.0): 0.35, ("g", 6.0): 0.2, ("g", 8.0): 0.2 * 0.8, ("g", 20.0): 0.0, ("h", 3.0): 0.7}
    assert got == pytest.approx(want)


def test_points_in_odd_rings(spark):
    """Every point lies in its ring, also in a notch and in a sliver that a hundred draws miss; areas are hit in proportion."""
    from stormgrid.functions import columns as C
    from stormgrid.operators import draws as D

    notch = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (3.0, 4.0), (3.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    sliver = [(0.0, 0.0), (10.0, 10.0), (10.0, 10.00001)]
    rows = [("n", [{"lon": x, "lat": y} for x, y in notch]), ("s", [{"lon": x, "lat": y} for x, y in sliver])]
    rings = spark.createDataFrame(rows, "name string, ring array<struct<lon: double, lat: double>>")
    keyed = rings.crossJoin(spark.range(1500)).union(spark.createDataFrame([("none", None, 1)], "name string, ring array<struct<lon: double, lat: double>>, id bigint"))
    spot = keyed.withColumn("key", F.col("id").cast("string")).withColumn("spot", D.point_in_ring("ring", "x", "key")).select("name", "ring", "spot.lat", "spot.lon")
    assert spot.where("ring is not null").where(~C.in_ring("lat", "lon", "ring")).count() == 0
    assert spot.where("lat is null").count() == 1
    share = spot.where("name = 'n'").select(F.avg((F.col("lat") < 1).cast("int"))).first()[0]
    assert abs(share - 4 / 10) < 0.05


def test_spaced_seeds_equal_the_greedy_loop(spark):
    from stormgrid.operators import windows as W

    rnd = random.Random(12)
    nodes = [(k, 40 + rnd.uniform(0, 0.6), -100 + rnd.uniform(0, 0.6), rnd.choice(["urban", "rural"])) for k in range(220)]
    tiers = [("urban", 12.0, 9), ("rural", 20.0, 60), ("suburban", 5.0, 3)]
    df, plan = spark.createDataFrame(nodes, "node_id int, lat double, lon double, stratum string"), spark.createDataFrame(tiers, "stratum string, radius_km double, target int")
    order = {}
    for k in (0, 1):
        u = W.hash_u(F.lit(f"t-{k}"), F.col("node_id"))
        order[k] = [r.node_id for r in df.orderBy(u, "node_id").collect()]
    place = {k: (y, x) for k, y, x, _ in nodes}
    want = {}
    for stratum, radius, target in tiers:
        own, kept = {k for k, _, _, s in nodes if s == stratum}, []
        for k, share in enumerate((0.5, 0.35)):
            for i in order[k]:
                if i in own and i not in [x for x, _ in kept] and len(kept) < target and sum(km(place[i], p) <= radius for p in place.values()) >= 4 and all(km(place[i], place[j]) > radius * share for j, _ in kept):
                    kept.append((i, k + 1))
        want[stratum] = kept
    for first_share in (0.5, 50.0):  # many small lots, or one
        rows = W.spaced_seeds(df, plan, "t", least=4, first_share=first_share).orderBy("stratum", "place").collect()
        got = {s: [(r.node_id, r["pass"]) for r in rows if r.stratum == s] for s, *_ in tiers}
        assert got == want and len(want["urban"]) == 9 and {p for _, p in want["rural"]} == {1, 2}


def test_severity_model_equals_newton(spark):
    import numpy as np

    from stormgrid.operators.models import severity_glm

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 2))
    n = rng.integers(1, 60, 80)
    k = rng.binomial(n, 1 / (1 + np.exp(-(0.4 + x @ [0.8, -0.5]))))
    rows = [(int(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(k, n, x, strict=True)] + [(0, 0, 1.0, None)]
    out, found = severity_glm(spark.createDataFrame(rows, "k int, n int, a double, b double"), ["a", "b"])
    design = np.column_stack([np.ones(80), (x - x.mean(0)) / x.std(0, ddof=1)])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]), design.T @ (k - n * p))
    assert [found["intercept"], found["a"], found["b"]] == pytest.approx(beta.tolist(), abs=1e-5)
    assert out.count() == 81 and out.where("predicted is null").count() == 0


def plane(lat, lon):
    return math.radians(lon) * 6378.137, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378.137


def test_corridors_equal_the_plain_loop(spark):
    """Largest gap first, spacing to all, the quota, and the fill for what is missing."""
    from stormgrid.operators import sites as X

    rnd = random.Random(21)
    sites = [(f"n{s}{k}", s, 40 + rnd.uniform(0, 3), -100 + rnd.uniform(0, 4), 5.0) for s, n in (("A", 9), ("B", 3), ("C", 1)) for k in range(n)]
    lines = [("A", "r1", k, 40 + 0.7 * k, -100 + 0.9 * k) for k in range(5)] + [("A", "r2", k, 43 - 0.5 * k, -99.0) for k in range(6)] + [("B", "r1", 0, 41.0, -99.0), ("B", "r1", 1, 41.2, -98.8)]
    fill = [(f"f{s}{k}", s, k, 40 + rnd.uniform(0, 3), -100 + rnd.uniform(0, 4)) for s in "ABC" for k in range(12)]
    frames = (
        spark.createDataFrame(sites, "id string, state string, lat double, lon double, capacity double"),
        spark.createDataFrame(lines, "state string, line_id string, seq int, lat double, lon double"),
        spark.createDataFrame(fill, "id string, state string, ord int, lat double, lon double"),
    )
    corridor = [(r.id, r.state, r.lat, r.lon) for r in X.corridor_points(frames[1], 60.0).collect()]
    got = {(r.id, r.rule) for r in X.expand_corridors(*frames, 0.9, 25.0, 60.0).where("is_cf_added").collect()}
    want = set()
    for s, n in (("A", 9), ("B", 3), ("C", 1)):
        held = [plane(y, x) for _, t, y, x, _ in sites if t == s]
        own = [(i, plane(y, x)) for i, t, y, x in corridor if t == s]
        order = sorted(own, key=lambda c: (-min(math.dist(c[1], h) for h in held), c[0]))
        left = math.ceil(0.9 * n)
        for rule, points in (("corridor", order), ("fill", [(i, plane(y, x)) for i, t, _, y, x in fill if t == s])):
            for i, p in points:
                if left and all(math.dist(p, h) >= 25.0 for h in held):
                    held.append(p)
                    want.add((i, rule))
                    left -= 1
    assert got == want and {r for _, r in want} == {"corridor", "fill"}


def test_drawn_sites_equal_the_plain_loop(spark):
    """Lots of draws give what one pass over all draws gives; crowded states stay short."""
    from stormgrid.operators import sites as X

    rnd = random.Random(22)
    sites = [(f"n{s}{k}", s, 40 + rnd.uniform(0, 1), -100 + rnd.uniform(0, 1), 5.0) for s, n in (("A", 8), ("B", 2), ("C", 9)) for k in range(n)]
    square = lambda y, x, d: [{"lon": x + a, "lat": y + b} for a, b in ((0.0, 0.0), (d, 0.0), (d, d), (0.0, d))]
    areas = [("A", "a1", 3.0, square(40.0, -100.0, 1.0)), ("A", "a2", 1.0, square(41.0, -100.0, 0.5)), ("B", "b1", 0.0, square(40.0, -100.0, 2.0)), ("B", "b2", 2.0, square(40.0, -100.0, 1.0)), ("C", "c1", 1.0, square(40.0, -100.0, 0.1))]
    frames = (
        spark.createDataFrame(sites, "id string, state string, lat double, lon double, capacity double"),
        spark.createDataFrame(areas, "state string, area_id string, population double, ring array<struct<lon: double, lat: double>>"),
    )
    out = X.expand_drawn(*frames, "population", 0.7, "t", "population", 15.0, 40).collect()
    target = {"A": 6, "B": 2, "C": 7}
    asks = spark.createDataFrame([(s, n * 40) for s, n in target.items()], "state string, n int")
    want = set()
    held = {s: [plane(y, x) for _, t, y, x, _ in sites if t == s] for s in target}
    left = dict(target)
    for r in sorted(X.drawn_points(frames[1], asks, "population", "t").collect(), key=lambda r: (r.state, r.ord)):
        p = plane(r.lat, r.lon)
        if left[r.state] and all(math.dist(p, h) >= 15.0 for h in held[r.state]):
            held[r.state].append(p)
            want.add(r.id)
            left[r.state] -= 1
    assert {r.id for r in out if r.is_cf_added} == want and left["A"] == left["B"] == 0 < left["C"]
    assert len(out) == len(sites) + len(want) and all(r.capacity == 1 and r.rule == "population" for r in out if r.is_cf_added)


def test_sites_densified_in_place(spark):
    from stormgrid.operators import sites as X

    sites = spark.createDataFrame([(f"{s}{k}", s, None if k == 0 else k) for s, n in (("A", 10), ("B", 1)) for k in range(n)], "id string, state string, n_stations int")
    out = {r.id: r for r in X.tag_within(sites, 0.25, "t").collect()}
    tagged = [r for r in out.values() if r.densify_mode]
    assert len(out) == 11 and sorted(r.state for r in tagged) == ["A", "A", "A", "B"]
    assert all(r.n_stations == (int(r.id[1:]) or 1) + 1 for r in tagged)
    assert all(r.n_stations == (int(r.id[1:]) or None) for r in out.values() if not r.densify_mode)
    assert X.tag_within(sites, 0.0, "t").where("densify_mode is not null").count() == 0


def test_split_protocols_and_their_scores(spark):
    from stormgrid.operators import models as M

    rows = [(k, ("T", "N", "C")[k % 3], ("TX", "NY", "CA")[k % 3], ("urban", "rural")[k % 2], float(k % 7), -110.0 + k if k != 5 else None, float(k % 7) if k != 4 else None) for k in range(30)] + [(99, None, None, "rural", 1.0, -90.0, 1.0)]
    df = spark.createDataFrame(rows, "ord int, state string, code string, window_stratum string, x double, center_lon double, y double")
    splits = M.protocols(df, "ord", "t", regions=["northeast"], least=5, states=["T", "N"])
    assert set(splits) == {"east_west", "stratified_stratum", "stratified_state", "region_northeast", "state_T", "state_N"}
    parts = {k: {r.ord: r.split for r in v.collect()} for k, v in splits.items()}
    assert parts["east_west"] == {r[0]: "train" if r[5] > -100 else "test" for r in rows if r[5] is not None}
    assert parts["region_northeast"] == {r[0]: "test" if r[2] == "NY" else "train" for r in rows}
    assert parts["state_T"] == {r[0]: "test" if r[1] == "T" else "train" for r in rows if r[1]}
    assert sum(v == "test" for v in parts["stratified_stratum"].values()) == 9
    wanted = {k: splits[k] for k in ("east_west", "state_T")} | {"empty": splits["state_T"].where("split = 'train'")}
    out = {r.split: r for r in M.compare_splits(wanted, ["x"], ["y"], 20, 3).collect()}
    assert (out["east_west"].n_train, out["east_west"].n_test) == (20, 9)  # one label and one longitude are missing
    assert (out["state_T"].n_train, out["state_T"].n_test) == (19, 10) and out["empty"].n_test == 0 and out["empty"].r2 is None
    assert out["state_T"].r2 > 0.7 and out["state_T"].overall_r2 == pytest.approx(out["state_T"].r2)


def test_widest_pair_of_odd_shapes(spark):
    from stormgrid.operators import sites as X

    rnd = random.Random(4)
    shapes = {
        "cloud": [(rnd.gauss(0, 1), rnd.gauss(0, 3)) for _ in range(200)], "ring": [(math.cos(k), math.sin(k)) for k in range(60)],
        "line": [(k * 1.0, 2.0 * k) for k in range(30)], "one": [(3.0, 3.0)], "same": [(1.0, 1.0)] * 5,
    }
    df = spark.createDataFrame([(g, x, y) for g, own in shapes.items() for x, y in own], "graph_id string, x double, y double")
    got = {r.graph_id: r.widest for r in X.widest(df, ["x", "y"]).collect()}
    assert got == pytest.approx({g: max(math.dist(a, b) for a in own for b in own) for g, own in shapes.items()}, abs=1e-9)


def test_voronoi_neighbours_by_near_witnesses(spark):
    """Clusters, lone points and a border, against all triples; small graphs, and graphs below four points."""
    import numpy as np

    from stormgrid.operators.delaunay import voronoi_edges

    rnd = random.Random(1)
    graphs = {
        "clusters": [(rnd.gauss(c, 0.02), rnd.gauss(c * c, 0.05)) for c in (0, 1, 3) for _ in range(50)] + [(9.0, 9.0), (-5.0, 2.0)],
        "uniform": [(rnd.random(), rnd.random()) for _ in range(150)], "small": [(rnd.random(), rnd.random()) for _ in range(12)],
        "three": [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], "two": [(0.0, 0.0), (1.0, 1.0)],
    }
    df = spark.createDataFrame([(g, k, x, y) for g, own in graphs.items() for k, (x, y) in enumerate(own)], "graph_id string, node_id int, x double, y double")
    got = {}
    for r in voronoi_edges(df).collect():
        assert (r.src, r.dst) not in got.setdefault(r.graph_id, set())
        got[r.graph_id].add((r.src, r.dst))
    for g, own in graphs.items():
        p, want = np.array(own), set()
        for a in range(len(p)):
            for b in range(a + 1, len(p)):
                r = np.delete(p, [a, b], 0)
                u, v = p[a] - r, p[b] - r
                dot, cross = (u * v).sum(1), u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
                left, right = dot[cross > 0] / cross[cross > 0], -dot[cross < 0] / cross[cross < 0]
                if len(p) < 4 or not len(left) or not len(right) or left.min() + right.min() > 1e-12:
                    want.add((a, b))
        assert got[g] == want, g
