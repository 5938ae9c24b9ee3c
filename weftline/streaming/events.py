"""Windowed aggregates of an event stream: the same plan over a batch or a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, window: str, slide: str | None = None, keys=(), late: str | None = None) -> DataFrame:
    """Counts for each window and key. late: how long a stream waits for late rows."""
    df = events.withWatermark(time, late) if late and events.isStreaming else events
    return df.groupBy(F.window(time, window, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, gap: str, keys=(), late: str | None = None) -> DataFrame:
    df = events.withWatermark(time, late) if late and events.isStreaming else events
    return df.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
