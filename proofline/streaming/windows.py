"""Windowed aggregates on streams with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, ts: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts by time window and keys: (start, end, keys..., n); rows later than ``late`` behind the newest are dropped on a stream."""
    marked = events.withWatermark(ts, late)
    return marked.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts by session, a run of events of a key with gaps below ``gap``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def first_seen(receipts: DataFrame, ts: str, late: str, key: str) -> DataFrame:
    """The first row of each key, as far back as the watermark."""
    return receipts.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
