"""Replies joined with the post they answer; one function for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WITHIN, LATE = "30 minutes", "10 minutes"


def join_parents(posts: DataFrame, parents: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """Every row of ``posts`` (conv_id, turn, ts, text) with ``context``, the text of the post one turn before it
    in ``parents`` if that is at most ``within`` older, else null.

    On streams both sides carry a watermark of ``late``; the time bounds let Spark drop rows that no
    later one can match. A parent that comes after its reply, but before the watermark passes, is found; after
    that the reply has gone out without context. A parent without time or key is never one."""
    stamp = lambda df, prefix: df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(*[F.col(c).alias(prefix + c) for c in ("conv_id", "turn", "ts", "text")])
    r, p = stamp(posts, ""), stamp(parents, "p_")
    near = (F.col("p_ts") <= F.col("ts")) & (F.col("p_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    joined = r.join(p, (F.col("conv_id") == F.col("p_conv_id")) & (F.col("turn") - 1 == F.col("p_turn")) & near, "leftOuter")
    return joined.select("conv_id", "turn", "ts", "text", F.col("p_text").alias("context"))


def timed(conversations: DataFrame) -> DataFrame:
    """conversations with a time: turns of a conversation are 1 to 40 minutes apart, by a rule on their numbers."""
    at = F.col("conv_id") * 86400 + F.col("turn") * 1200 + (F.col("conv_id") + F.col("turn") * F.col("turn")) % 1140
    return conversations.select("conv_id", "turn", F.timestamp_seconds(at).alias("ts"), "text")


def _query(s: SparkSession, d: str) -> DataFrame:
    x = timed(s.read.parquet(f"{d}/conversations.parquet"))
    return join_parents(x, x).select("conv_id", "turn", "text", "context")


QUERIES = {"thread_parents_in_time": _query}
ORACLE = {
    "thread_parents_in_time": """WITH x AS (SELECT *, conv_id * 86400 + turn * 1200 + (conv_id + turn * turn) % 1140 AS at FROM conversations)
SELECT r.conv_id, r.turn, r.text, p.text AS context FROM x r LEFT JOIN x p ON p.conv_id = r.conv_id AND p.turn = r.turn - 1 AND p.at <= r.at AND p.at >= r.at - 1800"""
}
