"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.sources.shared import shared_dir  # noqa: F401
from stormgrid.sources.shared import written as materialize  # noqa: F401

#: Arrow batches that go back to Spark hold about this many bytes.
BATCH_BYTES = 8 << 20
MOST_MARK_BITS = 27  # log2 of the bits of the largest bitmap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches of the Python stages, whose rows may hold long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def marks(df: DataFrame, column: str):
    """A bitmap of the values of a hash column, or'ed together by partial aggregation, as a broadcast.

    It has about 16 bits for each row of ``df`` up to ``2**MOST_MARK_BITS`` bits (16 MB), so it may
    let other values pass, above all beyond that size, and callers check what passes.
    """
    bits = min(MOST_MARK_BITS, max(15, df.count().bit_length() + 4))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = df.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("place"))
    flags = np.zeros(1 << bits - 3, np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("place").alias("flags")).toLocalIterator():
        flags[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["flags"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(flags)


def marked(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the bitmap."""
    at = values & (8 * len(flags) - 1)
    return flags[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: int = 1000, counts: DataFrame | None = None, stored: bool = False
) -> DataFrame:
    """An inner or left join in which rows of ``left`` with one key spread over many tasks.

    Keys with more than one in ``share`` of left's rows (and 1000 rows) are fewer than ``share``, so
    their table can be broadcast: their rows get salts by a hash of the whole row, and right's rows
    of such a key as many copies. ``counts`` (the keys and c, their rows) saves a pass over left.
    With ``stored``, for a left that is a written table, equal rows spread as well, by their place.
    """
    salt, copies, rows = fresh_names(left, "salt", "salts", "rows")
    limit = max(left.count() // share, 1000)
    counts = left.groupBy(*on).agg(F.count("*").alias(rows)) if counts is None else counts.select(*on, F.col("c").alias(rows))
    heavy = materialize(counts.where(F.col(rows) > limit).select(*on, F.ceil(F.col(rows) / limit).cast("int").alias(copies)), "heavy")
    place = [F.monotonically_increasing_id()] if stored else []
    whole_row = F.xxhash64(*(F.col(f"`{c}`") for c in left.columns), *place)
    keyed = left.withColumn(salt, whole_row).join(F.broadcast(heavy), on, "left")
    spread = keyed.withColumn(salt, F.pmod(F.col(salt), F.coalesce(copies, F.lit(1)).cast("long")).cast("int"))
    dealt = right.join(F.broadcast(heavy), on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(copies, F.lit(1)) - 1)))
    return spread.drop(copies).join(dealt.drop(copies), [*on, salt], how).drop(salt)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(text: Column) -> Column:
    """How many runs of characters other than blank and tab to carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Join batches until they hold ``most`` bytes, so that work on distinct words is shared."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def sliced(batch: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``most`` bytes."""
    step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
