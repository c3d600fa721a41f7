"""Each stage on its own input, and the whole run."""

import os

import corpus_pipeline as P
from test_table_operators import edited, plain_components, prose, quality_rows  # noqa: F401
from test_text_operators import plain_dedup
import random


def columns(docs):
    return ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tmp_path):
    rows, labels = quality_rows(600)
    rnd = random.Random(9)
    text = prose(rnd, 120)
    rows += [(10_000 + k, edited(rnd, text, 1)) for k in range(5)] + [(20_000, None), (20_001, "")]
    data = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, frames = str(tmp_path), [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, frames[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(f.columns == docs.columns for f in frames[1:-1])
    texts = [{r.doc_id: r.text for r in f.collect()} for f in frames[:-1]]
    good = {k for k, q, _ in labels if q == 1}
    assert len(good & texts[1].keys()) > 0.98 * len(good)
    assert len(texts[1].keys() & {k for k, q, _ in labels if q == 0}) < 10
    want = {i: t for i, (n, gone, t) in plain_dedup(list(texts[1].items()), P.LINE_DOCUMENTS).items() if not gone or t.strip()}
    assert texts[2] == want
    heads = {i for i, _, c in plain_components(list(texts[2].items())) if i == c}
    assert texts[3].keys() == heads and frames[3].count() == len(heads)
    taken = frames[4].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in taken} <= heads and all(r["count"] <= 3 for r in taken)
    assert frames[5].count() == frames[4].count()
    whole = P.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, frames[5].collect()))
    assert os.path.isdir(f"{tmp_path}/0")


def test_stages_tell_rows_with_null_and_repeated_ids_apart(spark, tmp_path):
    rows, labels = quality_rows(600)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rnd = random.Random(11)
    bad, good = "BUY!! NOW!! " * 30, [prose(rnd, 150) + "." for _ in range(4)]
    near = edited(rnd, good[2], 1)
    rows += [(None, bad), (70_000, bad), (70_000, good[0]), (None, good[1]), (70_001, good[2]), (None, near), (70_002, near), (70_002, good[3])]
    data = [(i, t, "en", "s", len(t)) for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = P.keep_quality(spark, docs, str(tmp_path)).where("doc_id is null or doc_id >= 70000")
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t in rows[600:] if t != bad)
    left = P.drop_near_copies(spark, kept, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(70_000, good[0]), (0, good[1]), (70_001, good[2]), (70_002, good[3])])


def test_mix_of_null_and_repeated_ids_meets_the_targets(spark, tmp_path):
    rows = [(None, f"w{k} " * 10, "en", "a" if k < 300 else "b", 30) for k in range(600)]
    rows += [(5, "same text here now", "en", "c", 18)] * 2500 + [(5, f"word {k} x", "en", "c", 8) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    mixed = P.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    words = {r["source"]: r["w"] for r in mixed.selectExpr("source", "size(split(trim(text), ' ')) as n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "w").collect()}
    targets = {r["source"]: r["target"] for r in P.mixing.source_targets(docs.selectExpr("source", "cast(size(split(trim(text), ' ')) as bigint) as size")).collect()}
    for source, target in targets.items():
        assert abs(words.get(source, 0) - target) <= 10, (source, words, targets)
    most = {}
    for r in mixed.groupBy("doc_id", "text").count().collect():
        most[r["doc_id"], r["text"]] = r["count"]
    assert all(n <= 3 for (i, t), n in most.items() if t != "same text here now") and most[5, "same text here now"] <= 7500
    again = P.mix_sources(spark, docs, str(tmp_path)).groupBy("doc_id", "text").count().collect()
    assert {(r["doc_id"], r["text"]): r["count"] for r in again} == most


def test_one_of_linked_texts_of_one_id_or_none_stays(spark, tmp_path):
    rnd = random.Random(13)
    a, b = prose(rnd, 150), prose(rnd, 150)
    rows = [(None, a), (None, edited(rnd, a, 1)), (7, b), (7, edited(rnd, b, 1)), (8, ""), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = P.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert len(left) == 5 and sum(r.doc_id == 7 for r in left) == 1 and sum(r.doc_id is None and r.text is not None for r in left) == 1
