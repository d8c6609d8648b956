"""Sinks and the reads that belong to them: split tables, the feedback queue, reports, requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, target: int | None = None) -> None:
    """JSON lines; with ``target`` at most so many rows."""
    (df if target is None else df.limit(target)).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split; a reader of one split prunes the others."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def append_feedback(scored: DataFrame, path: str, resolved: DataFrame | None = None) -> None:
    """Appends the low-confidence rows of ``scored`` and, as entries of their own, all of ``resolved`` (fallback
    answers of some of them) as JSON lines. Both have text, final_label, final_conf and reason."""
    _feedback(scored, resolved).write.mode("append").json(path)


def _feedback(scored: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    entry = lambda x, why: x.select("text", F.col("final_label").alias("label"), F.col("final_conf").alias("confidence"), "reason", F.lit(why).alias("kind"), F.unix_micros(F.current_timestamp()).alias("at"))
    rows = entry(scored.where("fallback_required"), "low_confidence")
    return rows if resolved is None else rows.unionByName(entry(resolved, "fallback_resolved"))


def feedback_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the low-confidence rows of each batch in a folder named by its number. A batch that is
    run again after a failure writes the same folder anew, so no row is appended twice; one checkpoint, one path."""

    def write(scored: DataFrame, batch: int) -> None:
        _feedback(scored).write.mode("overwrite").json(f"{path}/batch={batch}")

    return write


FEEDBACK = "text string, label string, confidence double, reason string, kind string, at bigint"


def read_feedback(spark: SparkSession, path: str, last: int = 20) -> DataFrame:
    """The last entries, newest first; lines that are no JSON of an entry are skipped."""
    raw = spark.read.schema(FEEDBACK + ", _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    return raw.where("_corrupt_record is null and at is not null").drop("_corrupt_record").orderBy(F.desc("at"), "kind", "text").limit(last)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON object a part: its name and its rows as a list. The parts are aggregates of few rows."""
    rows = [x.agg(F.lit(name).alias("part"), F.collect_list(F.struct(*x.columns)).alias("rows")).select("part", F.to_json("rows").alias("rows")) for name, x in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    out.coalesce(1).write.mode("overwrite").json(path)


def requests(df: DataFrame) -> DataFrame:
    """Rows (request, posts array<struct<text, context>>, texts array<string>) to (request, status, pos, text, context).

    ``posts`` goes before ``texts``. Both null: one row with status 400. An empty list: one row with status 200
    and no post (pos null), so that the request still has an answer of zero posts."""
    item = "array<struct<text:string,context:string>>"
    given = F.coalesce(F.col("posts").cast(item), F.transform("texts", lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("context"))))
    x = df.select("request", F.when(given.isNull(), 400).otherwise(200).alias("status"), F.posexplode_outer(given).alias("pos", "post"))
    return x.select("request", "status", "pos", "post.text", "post.context")
