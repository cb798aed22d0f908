"""Event counts over a stream. An extra of this engine, built on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """start, key, cnt of each tumbling window; rows later than `late` behind the newest are left out."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", every).alias("w"), key).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), key, "cnt")
