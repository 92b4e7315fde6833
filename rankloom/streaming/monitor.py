"""Running metrics over an event stream (an extension: retrieval experiments have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value), in tumbling windows; for batches and, with a watermark, streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
