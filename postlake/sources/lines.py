"""Text files by line number, and pairs of files zipped line by line.

Files are read in splits by whatever store Spark reads. A line's number is its
place in its split plus the lines of the file's splits before it, so it depends
on the bytes alone, not on how a file was cut; only one count a split is
ordered by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, text) of all lines of the files, numbered from 0. Line ends are \\n, \\r\\n or \\r; a last empty line does not count."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("n"))
    # within a task ids rise in the order of reading; a split is read by one task
    place = raw.withColumn("place", F.row_number().over(Window.partitionBy("file", "at").orderBy("n")) - 1)
    before = raw.groupBy("file", "at").agg(F.count("*").alias("lines"))
    before = before.withColumn("before", F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("lines")
    return place.join(before, ["file", "at"]).select("file", (F.col("before") + F.col("place")).alias("line"), "text")


def zip_files(spark: SparkSession, texts: str, labels: str) -> DataFrame:
    """(line, text, label): lines of two files paired by number; a line that one of them lacks has null there."""
    a = numbered_lines(spark, texts).select("line", "text")
    b = numbered_lines(spark, labels).select("line", F.col("text").alias("label"))
    return a.join(b, "line", "full").select("line", "text", "label")


def label_pairs(spark: SparkSession, texts: str, labels: str) -> DataFrame:
    """(line, text, label) with labels 0, 1, 2 as negative, neutral, positive; blank texts and other labels are dropped."""
    named = F.element_at(F.array(*map(F.lit, ("negative", "neutral", "positive"))), F.expr("try_cast(trim(label) as int)") + 1)
    x = zip_files(spark, texts, labels).where(F.expr("try_cast(trim(label) as int) between 0 and 2"))
    return x.select("line", F.trim("text").alias("text"), named.alias("label")).where("text <> ''")
