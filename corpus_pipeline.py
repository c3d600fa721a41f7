"""The training-corpus pipeline: quality, line dedup, near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormgrid.llm import bpe, jaccard, line_dedup, mixing, quality
from stormgrid.llm.common import fresh_names, materialize, small_batches, spread_join, table

#: Lines that two documents share stay here: near copies meet whole in the next stage.
LINE_DOCUMENTS = 3


def with_row(docs: DataFrame, *columns: str) -> tuple[DataFrame, str]:
    """A column, and its name, that tells rows apart also where their id is null or repeated: a hash of id, text and the columns."""
    (name,) = fresh_names(docs, "row_hash")
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), "text", *(F.col(f"`{c}`") for c in columns))), name


def numbered(rows: DataFrame, key: str, nth: str) -> DataFrame:
    """Number the equal rows of each key from 0: inside the parts that they lie in, and then part by part."""
    part, before = fresh_names(rows, "part", "before")
    placed = materialize(rows.withColumn(part, F.spark_partition_id()), "pipeline")
    sizes = placed.groupBy(key, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(0))) - 1
    return placed.withColumn(nth, inside).join(starts, [key, part]).withColumn(nth, F.col(nth) + F.col(before)).drop(part, before)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    small_batches(spark)
    named, row = with_row(docs)
    scored = quality.score(named, table(spark, sf_dir, "labels"), keep=(row,))
    rejected = scored.where("predicted = 0").select(row).distinct()
    return named.join(rejected, row, "left_anti").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and with them documents that have nothing else."""
    small_batches(spark)
    kept = line_dedup.dedup(docs, LINE_DOCUMENTS).where("n_dropped = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: the one with the smallest id, without any the one with the smallest hash.

    Groups are made of rows, not of ids: documents without an id, or with the same one, are linked too.
    """
    small_batches(spark)
    named, row = with_row(docs)
    found = jaccard.join(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id").distinct()
    of_id = named.select(row, F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("own_id")).distinct()
    first = F.min(F.struct("no_id", "own_id", row)).alias("first")
    kept = found.join(of_id, row).groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row))
    return named.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    The mix draws for rows, told apart by a hash of all columns; equal rows share their copies out.
    """
    named, row = with_row(docs, *docs.columns)
    total, of, nth, copies, copy = fresh_names(named, "mix_total", "mix_of", "mix_nth", "mix_copies", "mix_copy")
    drawn = mixing.mix(named.select(F.col(row).alias("doc_id"), "source", "text"))
    drawn = drawn.groupBy(F.col("doc_id").alias(row)).agg(F.sum("copies").alias(total), F.count("*").alias(of))
    drawn = materialize(drawn, "pipeline")
    counts = drawn.where(F.col(of) > 1).select(row, F.col(of).alias("c"))
    joined = spread_join(named, drawn.where(F.col(total) > 0), [row], counts=counts, stored=True)
    alone = joined.where(F.col(of) == 1).withColumn(copies, F.col(total))
    several = numbered(joined.where(F.col(of) > 1), row, nth)
    share = F.floor(F.col(total) / F.col(of)) + (F.col(nth) < F.col(total) % F.col(of)).cast("long")
    several = several.withColumn(copies, share).where(F.col(copies) > 0)
    taken = alone.select(*docs.columns, copies).unionByName(several.select(*docs.columns, copies))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token count and token ids of every row."""
    small_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.tokenizer_path())
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: SQL cannot express the classifier or the encoder; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
