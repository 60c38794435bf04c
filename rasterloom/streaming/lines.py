"""Streaming forms: statistics and looks over lines as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Per event type and event-time window: count, mean, extrema; rows later than ``late`` are left out."""
    w = F.window("ts", width)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type")
    return out.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
