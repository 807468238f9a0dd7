"""Stream forms: counts in windows, and first sight of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Works on a stream (``ts`` timestamp) as on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return marked.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_key(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Repeated keys go; on a stream within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
