"""Structured Streaming forms of the outage operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_merge(df: DataFrame, gap_min: float) -> DataFrame:
    """Merge outages by session windows that last as long as the outage plus the gap.

    Batch or stream (with a watermark on start_time, a TIMESTAMP). A microsecond makes the gap inclusive.
    """
    seconds = (F.col("duration_min") * 60.0 + gap_min * 60.0 + 0.000001).cast("decimal(18,6)")
    out = df.groupBy("fips", F.session_window("start_time", F.make_interval(secs=seconds)).alias("w")).agg(
        F.min("start_time").alias("start_time"), F.max("max_customers").alias("max_customers"), F.count("*").alias("n_merged")
    )
    return out.select("fips", "start_time", "max_customers", "n_merged")


def merge_outages_stream(stream: DataFrame, gap_min: float, lateness: str = "1 hour") -> DataFrame:
    return session_merge(stream.withWatermark("start_time", lateness), gap_min)


def active_hours(df: DataFrame) -> DataFrame:
    """A row for each hour that an outage touches; an outage without a start or duration touches none."""
    first = F.date_trunc("hour", "start_time")
    last = F.date_trunc("hour", F.col("start_time") + F.make_interval(secs=(F.col("duration_min") * 60.0).cast("decimal(18,6)")))
    return df.withColumn("hour", F.explode(F.sequence(first, last, F.expr("interval 1 hour"))))


def hourly_active(df: DataFrame) -> DataFrame:
    """Events and customers out in each tumbling hour that an outage touches (batch, or a stream of hours with a watermark)."""
    hours = df if "hour" in df.columns else active_hours(df)
    out = hours.groupBy(F.window("hour", "1 hour").alias("w"), "state").agg(F.count("*").alias("n"), F.sum("mean_customers").alias("customers"))
    return out.select(F.col("w.start").alias("hour"), "state", "n", "customers")


def hourly_active_stream(stream: DataFrame, lateness_h: int = 1, longest_h: int = 720) -> DataFrame:
    """:func:`hourly_active` of a stream of outages, each hour once no row can change it any more.

    The watermark is on the hours that outages touch, behind the newest by ``lateness_h`` and the
    longest outage: an outage that arrives at most ``lateness_h`` after a later one never misses its
    hours. Outages over ``longest_h`` hours are left out. The state holds the open hours, at most
    ``lateness_h + 2 * longest_h``, times the states.
    """
    fine = (F.col("duration_min") >= 0) & (F.col("duration_min") <= 60.0 * longest_h)
    hours = active_hours(stream.where(fine)).withWatermark("hour", f"{lateness_h + longest_h} hours")
    return hourly_active(hours)


def run_to_table(stream: DataFrame, name: str, checkpoint: str) -> None:
    """Drain what there is into an in-memory table, for tests and small jobs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
