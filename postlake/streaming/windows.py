"""Structured Streaming shapes of the batch functions: scoring and event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(posts: DataFrame, **options) -> DataFrame:
    """``score_posts`` on a stream; the function is narrow, so it keeps no state."""
    from postlake.operators.scoring import score_posts

    return score_posts(posts, **options)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """The watermarked stream; a time stamp without zone is read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per window and event_type; rows later than ``late`` are dropped by the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
