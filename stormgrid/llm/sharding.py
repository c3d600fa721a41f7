"""Contiguous shards of near equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormgrid.llm.common import materialize, table

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every row into one of ``shards`` contiguous runs of the ``doc_id`` order.

    The rows are range partitioned by doc_id. Each partition gives one total; the prefix sums of
    those few totals, plus a running sum inside each partition, are the global byte offsets. A row
    goes to the shard in which its middle byte falls, so shards differ from an equal share by less
    than one row.

    Null texts count no bytes (size 1, crc32 of no bytes); null ids come first; repeated rows and
    equal ids keep one slot each, ordered by checksum and size; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ("doc_id", "text_crc32", "size")
    # Written once: the ranges come from a sample, which another run of the plan may draw anew.
    ranged = materialize(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sharding"
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range partition: as many as spark.sql.shuffle.partitions, not as the data.
    placed = (
        ranged.withColumn("inside", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumn("row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")
        .select(
            *order,
            F.expr(
                f"cast(((2 * (bytes_before + inside) + size) * {shards}) div (2 * total) as int)"
            ).alias("shard"),
            (F.col("rows_before") + F.col("row")).alias("place"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
