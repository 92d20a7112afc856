"""Windowed counts over a stream of events: an extension of ours, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` by tumbling window and keys; rows later than ``late`` behind are dropped by Spark."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = timed.groupBy(F.window("_time", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")
