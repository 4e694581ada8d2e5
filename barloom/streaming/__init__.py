"""Hourly bars of an event stream, closed by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Bars by event type and hour; the same for a table and, with a watermark, for a stream."""
    seen = events.where("value > 0").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    if seen.isStreaming:
        seen = seen.withWatermark("ts", "1 hour")
    bars = seen.groupBy("symbol", F.window("ts", "1 hour").alias("hour")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("hour.start").alias("ts"), "open", "high", "low", "close", "volume")


def append_bars(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each hour once it is closed."""
    return hourly(events).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
