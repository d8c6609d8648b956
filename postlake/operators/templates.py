"""Synthetic texts from a product of template parts, without building the product.

The rows of a product of k part lists of sizes s1 .. sk are numbered 0 .. N - 1 in
mixed radix. A wanted row i takes number (a * i + b) mod N with a prime to N, which
is a permutation, so any count of rows up to N comes out distinct and spread over
all parts; its digits pick one entry of every list. Only part lists, which are
templates of bounded size, are looked up by broadcast where their counted rows
allow it."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a list up to which it is broadcast.
BROADCAST_ROWS = 100_000


def spread(n: int) -> int:
    """The smallest number from 618 thousandths of n on that is prime to n."""
    a = max(1, n * 618 // 1000)
    while gcd(a, n) != 1:
        a += 1
    return a


def template_product(spark: SparkSession, parts: list[DataFrame], count: int, shift: int = 42) -> DataFrame:
    """(i, text): ``count`` distinct rows of the product of ``parts``, each a table of one column of texts. Equal or null
    entries of a list count once or not at all; an empty list makes an empty product. More rows than the product has are an error."""
    lists, sizes = [], []
    for k, p in enumerate(parts):
        name = p.columns[0]
        words = p.select(F.col(name).cast("string").alias(f"w{k}")).where(f"w{k} is not null").distinct()
        # a list of templates: a few rows, numbered in one window
        words = words.withColumn(f"d{k}", (F.row_number().over(Window.orderBy(f"w{k}")) - 1).cast("long"))
        sizes.append(words.count())
        lists.append(F.broadcast(words) if sizes[-1] <= BROADCAST_ROWS else words)
    n = reduce(lambda x, y: x * y, sizes, 1)
    if count > n:
        raise ValueError(f"{count} rows asked of a product of {n}")
    if count == 0:
        return spark.range(0).select(F.col("id").alias("i"), F.lit("").alias("text"))
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    rows = spark.range(count).withColumn("at", (F.col("id").cast("decimal(19,0)") * F.lit(spread(n)).cast("decimal(19,0)") + big(shift % n)) % big(n))
    below = 1
    for k in reversed(range(len(parts))):
        rows = rows.withColumn(f"d{k}", (F.floor(F.expr(f"at div cast({below} as decimal(38,0))")) % sizes[k]).cast("long"))
        below *= sizes[k]
    for k, words in enumerate(lists):
        rows = rows.join(words, f"d{k}")
    return rows.select(F.col("id").alias("i"), F.concat_ws(" ", *[f"w{k}" for k in range(len(parts))]).alias("text"))


def _query(s: SparkSession, d: str) -> DataFrame:
    """Three quarters of all (nation, market segment, event type) texts of the tables."""
    t = lambda name, c: s.read.parquet(f"{d}/{name}.parquet").select(c)
    parts = [t("nation", "n_name"), t("customer", "c_mktsegment"), t("events", "event_type")]
    n = reduce(lambda x, y: x * y, [p.where(F.col(p.columns[0]).isNotNull()).distinct().count() for p in parts], 1)
    return template_product(s, parts, n * 3 // 4)


_LIST = "l{k} AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS d FROM (SELECT DISTINCT {c} AS w FROM {t} WHERE {c} IS NOT NULL))"
QUERIES = {"template_product": _query}
ORACLE = {
    "template_product": "WITH " + ", ".join(_LIST.format(k=k, t=t, c=c) for k, (t, c) in enumerate([("nation", "n_name"), ("customer", "c_mktsegment"), ("events", "event_type")])) + """,
s AS (SELECT (SELECT count(*) FROM l1) AS s1, (SELECT count(*) FROM l2) AS s2, (SELECT count(*) FROM l0) * (SELECT count(*) FROM l1) * (SELECT count(*) FROM l2) AS n),
a AS (SELECT s.*, (SELECT min(x) FROM range(greatest(1, n * 618 // 1000), n + 2) t(x) WHERE gcd(x, n) = 1) AS a FROM s),
r AS (SELECT i, (a * i + 42 % n) % n AS num, s1, s2 FROM a, range(0, (SELECT n * 3 // 4 FROM s)) t(i))
SELECT i, concat_ws(' ', l0.w, l1.w, l2.w) AS text FROM r JOIN l0 ON l0.d = num // (s1 * s2) JOIN l1 ON l1.d = num // s2 % s1 JOIN l2 ON l2.d = num % s2"""
}
