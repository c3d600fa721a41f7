"""Micro graphs with known answers, greedy loops, streams and draws."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid.functions import columns as C
from stormgrid.operators import centrality as E
from stormgrid.operators import draws as D
from stormgrid.operators import networks as N
from stormgrid.operators.spectrum import algebraic_connectivity
from stormgrid.operators import outages as O
from stormgrid.operators import removal as R
from stormgrid.operators.filters import add_event_times
from stormgrid.streaming import outages as T

GRAPHS = {
    "path": (3, [(1, 2), (2, 3)], 5 / 6, {2: 1.0}),
    "triangle": (3, [(1, 2), (2, 3), (1, 3)], 1.0, {}),
    "star": (4, [(1, 2), (1, 3), (1, 4)], 0.75, {1: 1.0}),
    "pairs": (4, [(1, 2), (3, 4)], 1 / 3, {}),
}


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = [(g, k) for g, (n, *_) in GRAPHS.items() for k in range(1, n + 1)]
    edges = [(g, a, b, 1.0) for g, (_, e, *_) in GRAPHS.items() for a, b in e]
    return spark.createDataFrame(nodes, "graph_id string, node_id int"), spark.createDataFrame(edges, "graph_id string, src int, dst int, weight double")


def test_efficiency_and_betweenness(graphs):
    got = {r.graph_id: r.efficiency for r in N.global_efficiency(*graphs).collect()}
    assert got == pytest.approx({g: e for g, (_, _, e, _) in GRAPHS.items()})
    between = {(r.graph_id, r.node_id): r.betweenness for r in E.betweenness(*graphs).collect()}
    for g, (n, _, _, known) in GRAPHS.items():
        assert {k: between[g, k] for k in range(1, n + 1)} == pytest.approx({k: known.get(k, 0.0) for k in range(1, n + 1)})


def test_removal(spark, graphs):
    removed = spark.createDataFrame([("path", 1, 2), ("triangle", 1, 1), ("star", 1, 1), ("star", 2, 1), ("pairs", 1, 1)], "graph_id string, case_id int, node_id int")
    got = {(r.graph_id, r.case_id): (r.relative, r.lcc) for r in R.removal_loss(*graphs, removed).collect()}
    assert got["path", 1] == pytest.approx((1.0, 1 / 3))
    assert got["triangle", 1] == pytest.approx((0.0, 2 / 3))
    assert got["star", 1] == got["star", 2] == pytest.approx((1.0, 1 / 4))
    assert got["pairs", 1][1] == pytest.approx(2 / 4)


def test_independent_set_is_the_greedy_loop(spark):
    rnd = random.Random(4)
    pairs = {(a, b) for a in range(80) for b in range(a + 1, 80) if rnd.random() < 0.06}
    kept: list[int] = []
    for k in range(80):
        if not any((j, k) in pairs for j in kept):
            kept.append(k)
    items = spark.range(80).withColumnRenamed("id", "ord")
    got = N.independent_set(items, spark.createDataFrame(sorted(pairs), "a bigint, b bigint"))
    assert sorted(r.ord for r in got.where("kept").collect()) == kept


def test_stream_merges_as_the_batch(spark, tmp_path):
    rows = [("f1", m, 30.0) for m in (0, 20, 200, 205, 500)] + [("f2", m, 5.0) for m in (0, 66, 200)] + [("f1", 5000, 1.0), ("f2", 5000, 1.0)]
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)
    df = spark.createDataFrame(rows, "fips string, m int, duration_min double").withColumn("start_time", base)
    df = df.withColumns({"max_customers": F.lit(1.0), "min_customers": F.lit(1.0), "mean_customers": F.lit(1.0), "state": F.lit("S"), "event_id": F.monotonically_increasing_id()}).drop("m")
    df.write.parquet(f"{tmp_path}/in")
    batch = O.merge_outages(add_event_times(df), 60)
    twin = T.session_merge(df, 60)
    key = lambda d: sorted((r.fips, r.start_time, r.n_merged) for r in d.collect())
    assert key(batch) == key(twin)
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    T.run_to_table(T.merge_outages_stream(stream, 60), "merged", f"{tmp_path}/cp")
    closed = [x for x in key(batch) if x[1].timestamp() < 1_700_000_000 + 4000 * 60]
    assert key(spark.table("merged")) == closed


def test_draws_do_not_depend_on_partitions(spark):
    rates = spark.createDataFrame([(f"s{k}", float(k * 7)) for k in range(60)], "state string, rate double")
    a = D.poisson_counts(rates, ["state"], "rate", "x").collect()
    b = D.poisson_counts(rates.repartition(13), ["state"], "rate", "x").collect()
    assert sorted(a) == sorted(b)
    total, mean = sum(r.n for r in a), sum(7 * k for k in range(60))
    assert abs(total - mean) < 5 * mean**0.5


def test_min_separation_inverts_overlap(spark):
    df = spark.createDataFrame([(10.0, 30.0), (30.0, 30.0), (80.0, 10.0)], "r1 double, r2 double")
    df = df.withColumn("d", C.min_separation("r1", "r2", 0.25))
    got = df.withColumn("o", C.disk_overlap(F.col("r1"), F.col("r2"), F.col("d"))).collect()
    assert all(abs(r.o - 0.25) < 1e-6 for r in got)


def test_required_columns_and_vintage(spark):
    df = spark.createDataFrame([("09110",)], "fips string")
    with pytest.raises(ValueError):
        C.require_columns(df, {"state"})
    from stormgrid.operators.filters import assert_fips_vintage

    with pytest.raises(ValueError):
        assert_fips_vintage(df)


def test_removal_keeps_cases_that_remove_nothing(spark, graphs):
    removed = spark.createDataFrame([("path", 1, 2)], "graph_id string, case_id int, node_id int")
    cases = spark.createDataFrame([("path", 1), ("path", 2), ("star", 2)], "graph_id string, case_id int")
    got = {(r.graph_id, r.case_id): (r.loss, r.relative, r.lcc) for r in R.removal_loss(*graphs, removed, cases).collect()}
    assert got.keys() == {("path", 1), ("path", 2), ("star", 2)}
    assert got["path", 1] == pytest.approx((5 / 6, 1.0, 1 / 3))
    assert got["path", 2] == got["star", 2] == (0.0, 0.0, 1.0)


def test_timeline_counts_active_events_that_miss(spark, graphs):
    rows = [(0, 0, 1, "path", 2), (0, 0, 2, "path", None), (0, 1, 2, "path", None), (1, 0, 3, "star", None)]
    active = spark.createDataFrame(rows, "sim_id int, hour int, event_id int, graph_id string, node_id int")
    got = {(r.sim_id, r.graph_id): (r.loss, r.hours, r.max_simultaneous) for r in N.timeline_loss(*graphs, active).collect()}
    assert got == {(0, "path"): (pytest.approx(1.0), 2, 2), (1, "star"): (0.0, 1, 1)}


def test_outages_reach_as_far_and_last_as_long_as_given(spark):
    from stormgrid.plans import networks as P
    from stormgrid.plans.registry import Tables, queries

    sf_dir = "/root/testdata/sf0.001"
    t = Tables(spark, sf_dir)
    nodes, events = t.fx_nodes.collect(), t.fx_epicenters.collect()
    graphs = {}
    for n in nodes:
        graphs.setdefault(n.graph_id.split("_")[0], set()).add(n.graph_id)

    def km(a, b):
        x = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    hits = {(n.graph_id, e.event_id, n.node_id) for e in events for n in nodes if n.graph_id in graphs.get(e.graph_id, ()) and km(e, n) <= e.radius_km}
    assert {tuple(r) for r in P.disrupted(t).collect()} == hits
    cases = {(g, e.event_id) for e in events for g in graphs.get(e.graph_id, ())}
    got = queries()["g06_outage_loss"](spark, sf_dir).collect()
    assert len(got) == len(cases) and {(r.graph_id, r.case_id) for r in got} == cases
    missed = cases - {h[:2] for h in hits}
    assert missed and all((r.loss, r.relative, r.lcc) == (0, 0, 1) for r in got if (r.graph_id, r.case_id) in missed)
    hours = {}
    for e in events:
        for h in range(math.ceil(e.event_id % 6), math.ceil(e.event_id % 6 + e.duration_hours)):
            for g in graphs.get(e.graph_id, ()):
                hours.setdefault((e.sim_id, g), {}).setdefault(h, set()).add(e.event_id)
    want = {k: (len(v), max(map(len, v.values()))) for k, v in hours.items()}
    assert {(r.sim_id, r.graph_id): (r.hours, r.max_simultaneous) for r in queries()["g23_union_timeline"](spark, sf_dir).collect()} == want


def test_algebraic_connectivity_equals_numpy(spark):
    sizes = {"one": 1, "two": 2, **{f"chain{n}": n for n in (7, 20, 24, 33, 150)}, "apart": 12}
    nodes = [(g, 5 * k) for g, n in sizes.items() for k in range(n)]
    edges = {(g, a, b) for g, n in sizes.items() for a in range(n) for b in (a + 1, a + 5) if b < n and (g != "apart" or (a < 6) == (b < 6))}
    want = {}
    for g, n in sizes.items():
        lap = np.zeros((n, n))
        for h, a, b in edges:
            if h == g:
                lap[a, b] = lap[b, a] = -1
        want[g] = np.linalg.eigvalsh(lap - np.diag(lap.sum(axis=1)))[1] if n > 1 else 0.0
    rows = [(g, 5 * a, 5 * b, 1.0) for g, a, b in sorted(edges)] + [("two", 5, 0, 1.0), ("two", 5, 5, 1.0)]
    out = algebraic_connectivity(spark.createDataFrame(nodes, "graph_id string, node_id int"), spark.createDataFrame(rows, "graph_id string, src int, dst int, weight double"))
    got = {r.graph_id: r.lambda2 for r in out.collect()}
    assert len(got) == out.count() and got == pytest.approx(want, abs=1e-9)
    assert want["chain20"] == pytest.approx(0.563, abs=1e-3) and want["two"] == pytest.approx(2)


def test_algebraic_connectivity_starts_again_from_its_estimate(spark):
    edges = [("g", k, (k + s) % 30, 1.0 + k % 3) for k in range(30) for s in (1, 4)] + [("star", 0, k, 1.0) for k in range(1, 9)] + [("g", 3, 99, 5.0)]
    nodes = [("g", k) for k in range(30)] + [("star", k) for k in range(9)] + [("lone", 1), ("lone", 1), ("two", 1), ("two", 2)]
    lap = np.zeros((30, 30))
    for g, a, b, w in edges[:60]:
        lap[a, b] = lap[b, a] = -w
    want = {"g": np.linalg.eigvalsh(lap - np.diag(lap.sum(axis=1)))[1], "star": 1.0, "lone": 0.0, "two": 0.0}
    tables = spark.createDataFrame(nodes, "graph_id string, node_id int"), spark.createDataFrame(edges, "graph_id string, src int, dst int, weight double")
    got = {r.graph_id: r.lambda2 for r in algebraic_connectivity(*tables, "weight", kept=12).collect()}
    assert got == pytest.approx(want, abs=1e-7)
    assert algebraic_connectivity(tables[0].limit(0), tables[1], "weight").count() == 0


def ring(*corners):
    return [{"lon": float(x), "lat": float(y)} for x, y in corners]


def test_polygons_whose_boxes_meet_need_not_meet(spark):
    from stormgrid.operators.joins import polygons_meet

    schema = "id int, ring array<struct<lon: double, lat: double>>"
    ell = ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))
    others = [(1, ring((2, 2), (5, 2), (5, 5), (2, 5))), (2, ring((0.5, 3), (3, 3), (3, 3.5), (0.5, 3.5))),
              (3, ring((-1, -1), (6, -1), (6, 6), (-1, 6))), (4, ring((4, 1), (6, 1), (6, 3), (4, 3))), (5, ring((0.2, 0.2), (0.4, 0.2), (0.4, 0.4)))]
    got = polygons_meet(spark.createDataFrame([(0, ell)], schema), spark.createDataFrame(others, schema))
    assert sorted(r.id_b for r in got.collect()) == [2, 3, 4, 5]


def test_radius_crosses_the_date_line(spark):
    from stormgrid.operators.spatial import within_radius

    points = spark.createDataFrame([(k, 0.0, lon) for k, lon in enumerate([179.95, -179.95, 179.0, -178.0])], "id int, lat double, lon double")
    centers = spark.createDataFrame([(0.0, 179.99), (0.0, -179.99)], "clat double, clon double")
    got = sorted((r.clon, r.id) for r in within_radius(points, centers, F.lit(30.0)).collect())
    assert got == [(-179.99, 0), (-179.99, 1), (179.99, 0), (179.99, 1)]


def test_strata_of_fractional_and_missing_codes(spark):
    rows = spark.createDataFrame([(3.4, float("nan")), (3.5, None), (6.5, 0.1), (6.6, 0.75), (2.0, float("inf"))], "code double, share double")
    got = [tuple(r) for r in rows.select(C.stratum_from_ruca(F.col("code")), C.stratum_from_urban_share(F.col("share"))).collect()]
    assert got == [("urban", "suburban"), ("suburban", "suburban"), ("suburban", "rural"), ("rural", "urban"), ("urban", "suburban")]


def test_paths_end_only_when_nothing_improves(spark):
    n = 40
    edges = spark.createDataFrame([("g", k, k + 1) for k in range(n)], "graph_id string, src long, dst long")
    got = N.shortest_paths(edges).where("src = 0").agg(F.max("d"), F.count("*")).first()
    assert tuple(got) == (n, n)


def test_regions_are_held_out_whole(spark):
    from stormgrid.operators.ranking import region_holdout

    rows = spark.createDataFrame([("md ",), ("DE",), ("TX",), (None,), ("DC",)], "code string")
    assert [r.split for r in region_holdout(rows, "code", "northeast").collect()] == ["test", "test", "train", "train", "test"]
    with pytest.raises(ValueError):
        region_holdout(rows, "code", "nowhere")


def merged_by_hand(sizes, neighbours, plan, least):
    units, has_unit = {s: u for s, u in plan.items()}, set(plan)
    for state in sorted(sizes):
        if state in has_unit:
            continue
        has_unit.add(state)
        units[state] = state
        options = [o for s, o in neighbours if s == state and o not in plan and o != s]
        if sizes[state] < least and options:
            partner = min(options, key=lambda o: (o not in sizes, sizes.get(o, 0), o))
            if partner not in has_unit:
                has_unit.add(partner)
                units[state] = units[partner] = f"{state}_{partner}"
    return {(u, s) for s, u in units.items()}


def test_small_states_merge_in_order(spark):
    draw = random.Random(3)
    names = [chr(97 + k) for k in range(14)]
    for _ in range(4):
        sizes = {n: draw.randint(1, 90) for n in names[:11]}
        near = [(a, b) for a in names for b in names if draw.random() < 0.25]
        plan = {names[0]: "west", names[5]: "west", names[13]: "west"}
        tables = [(list(sizes.items()), "state string, n long"), (near, "state string, neighbour string"), (list(plan.items()), "state string, unit string")]
        got = N.merge_units(*(spark.createDataFrame(*t) for t in tables))
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == merged_by_hand(sizes, near, plan, 50)


def test_snapshots_have_their_own_headers_and_the_newest_is_found(spark, tmp_path):
    from stormgrid.sources import tables

    paths = [tmp_path / n for n in ("stations (Jan 1 2019).csv", "stations (Jan 1 2021).csv", "notes 2030.csv")]
    paths[0].write_text("State,Latitude,Longitude\nTX,30,-100\n")
    paths[1].write_text("Longitude,State,Latitude,EV DC Fast Count\n-90,LA,31,2\n")
    paths[2].write_text("x\n1\n")
    names = [str(p) for p in paths]
    got = tables.read_station_snapshots(spark, names).select("year", "state", "lat", "capacity").collect()
    assert sorted(tuple(r) for r in got) == [(2019, "TX", 30.0, 0.0), (2021, "LA", 31.0, 600.0)]
    assert [r.year for r in tables.read_station_snapshots(spark, names, latest=True).collect()] == [2021]
    with pytest.raises(ValueError):
        tables.read_station_snapshots(spark, names[2:])


def test_chains_of_a_posterior_are_numbered_on(spark, tmp_path):
    from stormgrid.sources import tables

    rows = [(c, d, 1001, float(10 * c + d)) for c in range(3) for d in range(4)]
    spark.createDataFrame(rows, "chain long, draw long, fips long, `lambda` double").write.parquet(str(tmp_path / "p"))
    got = sorted(tuple(r) for r in tables.read_posterior(spark, str(tmp_path / "p")).collect())
    assert got == [(4 * c + d, "01001", float(10 * c + d)) for c in range(3) for d in range(4)]


def test_areas_become_closed_rings(spark):
    import json

    from stormgrid.sources import tables

    schema = "id string, ring array<struct<lon: double, lat: double>>, south double, north double, west double, east double"
    tri, far = ring((0, 0), (2, 0), (1, 3)), ring((50, 50), (51, 50), (51, 51), (50, 50))
    rows = [("b", tri, 0.0, 3.0, 0.0, 2.0), ("c", far, 50.0, 51.0, 50.0, 51.0), ("a", [], None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    made = json.loads(tables.geojson_areas(df, ["id"], 10).first()[0])
    assert [f["properties"]["id"] for f in made["features"]] == ["b", "c"]
    assert made["features"][0]["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [1, 3], [0, 0]]]}
    assert len(made["features"][1]["geometry"]["coordinates"][0]) == 4
    near = json.loads(tables.geojson_areas(df, ["id"], 10, (1.0, 1.0, 5.0, 5.0)).first()[0])
    assert [f["properties"]["id"] for f in near["features"]] == ["b"]
