"""Additions for event streams: audit tail, daily quotas and first-seen events, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_quota(events: DataFrame, who: str, at: str, limit: int, late: str | None = "1 day") -> DataFrame:
    """Everyone with more events in a day than allowed; works on a stream and on a table. ``late=None`` is for a stream that
    has its watermark already."""
    counted = (events.withWatermark(at, late) if late else events).groupBy(F.window(at, "1 day").alias("w"), F.col(who).alias("who")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select("who", F.to_date("w.start").alias("day"), "n")


def once(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each event once, however often a source delivers it within the lateness."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
