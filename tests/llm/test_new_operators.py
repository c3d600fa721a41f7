"""Centroids, conversations and personal data against their SQL and plain versions."""

import random
import re
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest

from stormgrid.llm import centroids, conversations, personal
from stormgrid.llm.common import spread_join

random.seed(7)


def same_as_sql(module, spark, path, **tables):
    con = duckdb.connect()
    for name in tables:
        con.sql(f"create view {name} as from '{path}/{name}.parquet/*.parquet'")
    want = con.sql(module.SQL).df()
    got = module.query(spark, path).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    plain = [sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in df[names].itertuples(index=False)), key=repr) for df in (got, want)]
    assert len(plain[0]) == len(plain[1])
    for a, b in zip(*plain, strict=True):
        assert a == b
    return got


def stored(path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# centroids

VECTORS = "vec_id bigint, embedding array<float>, cluster int, distance string"


def vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 64) / 8 + (i % 5)], 1, "x") for i in range(n)]
    rows += [(500, None, 1, "x"), (501, [], 1, "x"), (502, [1.0] * 63, 1, "x"), (503, [None] + [1.0] * 63, 1, "x"), (504, [float("nan")] + [1.0] * 63, 1, "x"), (505, [float("inf")] * 64, 1, "x")]
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("n", [0, 3, 8, 90])
def test_centroids_equal_sql(spark, tmp_path, n):
    df = vectors(spark, n)
    if n == 90:  # equal vectors, equal rows, an id twice
        df = df.unionAll(df.where("vec_id < 20").selectExpr("vec_id + 1000", "embedding", "cluster", "distance")).unionAll(df.where("vec_id = 3"))
    got = same_as_sql(centroids, spark, stored(tmp_path, embeddings=df), embeddings=df)
    assert len(got) == (n if n < 90 else 111)


def test_threshold_walk_is_exact():
    rng = np.random.default_rng(1)
    for k, dim, spread in product((1, 2, 8, 13), (1, 3, 64), (2, 1000)):
        c, x = rng.integers(-spread, spread, (k, dim)), rng.integers(-spread, spread, (300, dim))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        which, best = centroids.SortedLists(c).nearest(x)
        assert (which == d.argmin(1)).all() and (best == d.min(1)).all()


def test_null_ids_never_start_a_centroid_before_others(spark):
    rows = [(None, [float(i)] * 64, 1, "x") for i in range(5)] + [(7, [100.0] * 64, 1, "x")]
    found, final = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=1)
    assert found.count() == 6 and final.shape == (1, 64)


# conversations

TURNS = "conv_id bigint, turn bigint, role string, text string, cost int, audit string, part int"


def plain_cheapest(pattern, entry, exits):
    """Dynamic programming over whole labels."""
    row = {entry: (0, "")}

    def grow(row):
        for _ in range(4):
            for q, (c, a) in list(row.items()):
                t = conversations._after(q)
                row[t] = min(row.get(t, (10**9, "")), (c + 5, a + "I"))
        return row

    row = grow(row)
    for symbol in pattern:
        new = {}
        for q, (c, a) in row.items():
            extra = 5 if symbol.isupper() else 0
            ways = [(q, c + 2, "D")]
            if symbol != "X":
                ways.append((conversations._after(q), c + 1 + extra, "R"))
                kept = conversations._keeps(q, symbol.lower())
                if kept is not None:
                    ways.append((kept, c + extra, "K"))
            for t, cost, letter in ways:
                new[t] = min(new.get(t, (10**9, "")), (cost, a + letter))
        row = grow(new)
    return min((row[q] for q in exits if q in row), default=None)


def test_bidirectional_search_equals_dynamic_programming():
    patterns = ["".join(p) for n in range(4) for p in product("suaoXU", repeat=n)]
    patterns += ["".join(random.choices("suaoXSUAO", k=random.randrange(4, 30))) for _ in range(300)]
    for p in patterns:
        assert conversations.whole(p) == plain_cheapest(p, 0, (0, 3)), p
        for s, t in product(range(4), repeat=2):
            assert conversations.cheapest(p[:8], s, (t,)) == plain_cheapest(p[:8], s, (t,)), (p, s, t)


def turns(spark):
    texts = ["", " ", "Yes.", "No", "Why?", None, "a\tb! ", "x" * 3000 + ".", "\n"]
    roles = ["user", "assistant", "system", None, "tool", "", "User"]
    rows = []
    for conv in [*range(40), None, 10**12]:
        n = 700 if conv == 5 else random.randrange(0, 12)
        for turn in [None] * (conv == 7) + list(range(n)):
            rows.append((conv, turn if turn is None else turn * (1 + (conv or 0) % 2), random.choice(roles[:2] * 6 + roles), random.choice(texts), 1, "a", 2))
    return spark.createDataFrame(rows, TURNS).repartition(6)


@pytest.mark.parametrize("rows", [512, 4])
def test_conversations_equal_sql(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(conversations, "PART_ROWS", rows)
    df = turns(spark)
    got = same_as_sql(conversations, spark, stored(tmp_path, conversations=df), conversations=df)
    assert got["audit"].map(len).max() > 400


def test_equal_rows_of_one_turn_may_fill_partitions(spark):
    """Repeats of one row lie in many range partitions, and all but the first go."""
    df = spark.range(3000).selectExpr("cast(1 as bigint) conv_id", "cast(0 as bigint) turn", "'user' role", "'Hi.' text", "1 copies")
    (row,) = conversations.repair(df).collect()
    assert (row.duplicate, row.cost, row.gaps, row.audit) == (2999, 2 * 3000, 0, "D" * 3000)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repair(conversations.damaged(empty)).count() == 0
    gone = spark.createDataFrame([(4, 1, "user", "Hi.", 0)], "conv_id bigint, turn bigint, role string, text string, copies int")
    (row,) = conversations.repair(gone).collect()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256[:8]) == (4, 0, 0, "", "e3b0c442")


# personal data

KNOWN = ["10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.c_d@e.f", "300.1.1.1", "1.2.3.4.5.6.7.8", "000255.1.1.1", "x@y@b.c.", "+1 (2) 3", "+12345678901234567", "3782 822463 10005"]


def secret_docs(spark):
    vocab = ["alpha", "Beta", "gamma", "delta", "Zürich", "omega", "one", "two", "it", "(kappa)", "sigma.", "\n", "\t"]
    rows = []
    for i in range(260):
        w = random.choices(vocab, k=random.randrange(40))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = ["project", "bluebird", "call", "+1 (555) 123-4567", "or", "bob.smith@corp.example.com", "Nightjar" if i % 10 else "now"]
        if i % 3 == 0:
            w.insert(0, random.choice(KNOWN))
        rows.append((i if i % 11 else None, " ".join(w) if i % 13 else None, 1, "x", 3))
    rows += [(1000, "", 1, "x", 3), (1001, "x" * 200_000, 1, "x", 3), (1002, "9" * 50_000 + "a@b.co", 1, "x", 3), (1003, "10.0.0.1 " * 3000, 1, "x", 3)]
    rows += [(2000 + i, rows[5][1], 1, "x", 3) for i in range(20)] + [rows[5]] * 2
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans int, term string, id int")


def test_personal_data_equals_sql(spark, tmp_path):
    df = secret_docs(spark)
    got = same_as_sql(personal, spark, stored(tmp_path, documents=df), documents=df)
    assert got["spans"].str.contains("term:").sum() > 40
    assert got["n_ip"].max() == 3000


def test_personal_patterns_equal_plain_ones(spark):
    """The possessive patterns find what the plain ones find, here with Python's engine."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def keeps(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "card":
            odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in odd) % 10 == 0
        return all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 10 <= len(digits) <= 15 if kind == "phone" else True

    texts = ["".join(random.choices("ab1. @-+_(05é\n", k=random.randrange(60))) for _ in range(1500)] + KNOWN + ["4" * n for n in range(12, 21)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["id"]: [tuple(s)[:3] for s in r["spans"] if s["kind"] < 4] for r in personal.find(df).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(plain.items()) for m in re.finditer(p, t) if keeps(n, m[0]))
        assert got[i] == want, t


def test_sanitised_texts_hold_no_secret(spark):
    rows = personal.sanitise(secret_docs(spark)).collect()
    assert len(rows) == 286 and {"spans", "spans_", "sanitised", "term", "id"} <= set(rows[0].asDict())
    for r in rows:
        if r["text"] and "bob.smith" in r["text"]:
            assert "bluebird" not in r["sanitised"] and "@corp" not in r["sanitised"] and "[EMAIL]" in r["sanitised"]
        elif not r["spans_"]:
            assert r["sanitised"] == r["text"]


def test_terms_far_from_their_value_are_found(spark):
    """Against a plain count: a term that reveals a value goes wherever it stands in a text that holds it."""
    rnd = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "delta", "Zürich", "omega", "(kappa)", "sigma."]

    def fill(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    texts = [f'"Nightjar", {fill(400)} mail bob@corp.example {fill(30)} or 10.0.0.{k % 3} then {fill(300)}\tnightjar {fill(20)} Heron' for k in range(6)]
    texts += [f"heron {fill(30)}" for _ in range(3)] + [f"heron {fill(9)} Kestrel +1 555 123 45{k} 67" for k in range(2)] + [fill(40) for _ in range(30)] + [None, ""]
    texts += [texts[0]] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = personal.MARKS
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in personal.find(df).collect()}
    places = [[(m.start() + len(m[0]) - len(m[0].lstrip(marks)), m[0].strip(marks).lower()) for m in re.finditer(r"\S+", t or "")] for t in texts]
    for i, t in enumerate(texts):
        told = {}
        if t and "bob@" in t:  # 8 documents with bob; heron in 13
            told = {"nightjar": 4, "heron": 5, "mail": 4, "or": None, "then": 4}
        want = [(at, told[w], at + len(w)) for at, w in places[i] if told.get(w)]
        assert [s for s in got[i] if s[1] >= 4] == want, i
    (row,) = personal.sanitise(df).where("doc_id = 0").collect()
    assert "ightjar" not in row["sanitised"] and row["sanitised"].startswith('"[REMOVED]", ')


def test_no_documents(spark):
    assert personal.sanitise(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_spread_join_equals_a_plain_join(spark):
    left = spark.range(20_000).selectExpr("if(id % 3 = 0, 1, if(id % 7 = 0, null, id)) as k", "id as salt")
    right = spark.createDataFrame([(1, "a"), (4, "b"), (None, "c"), (5, "d"), (5, "e")], "k bigint, rows string")
    for how in ("inner", "left"):
        want = left.join(right, "k", how)
        got = spread_join(left, right, ["k"], how)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_without_an_id_stay_where_ids_are_only_names(spark):
    from stormgrid.llm import licenses, neighbours, url_filters

    rules = spark.createDataFrame([("a.org", "/x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://b.a.org/xy"), (None, "http://b.a.org/xy"), (1, None)], "page_id bigint, url string")
    got = sorted((r.page_id or 0, r.verdict) for r in url_filters.judge(pages, rules).collect())
    assert got == [(0, "block"), (0, "block"), (1, "allow")]
    docs = spark.createDataFrame([(None, "the mit license"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.n_base for r in licenses.summary(licenses.scan(docs)).collect()) == [0, 1]
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (20, [1.0, 1.0]), (3, [2.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(vectors).collect()] == [(20, 3)]
