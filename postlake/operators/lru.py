"""A least-recently-used cache over a whole access log, computed offline.

An access hits a cache of ``capacity`` entries iff its key was used before and fewer
than ``capacity`` other keys were used since. With positions 1, 2, ... and ``last``
the position of the key's last use, the other keys used since are the positions
between, less those that are themselves a repeated use of a key inside that
gap: accesses m' < m whose own last use lies beyond ``last``. So every access
needs the number of earlier accesses with a greater last use, a dominance count.

The count is taken over a tree of position ranges. Ranges of ``width`` positions
are counted by one task each; above, ``fan`` ranges form a node, and a node adds
for every access those of its earlier ranges: per block of ``width`` last uses
by one task each, and between blocks from the numbers of accesses per (block,
range). Last uses are distinct, so a block holds at most ``width`` accesses and
no task sees more of the log; a key in a third of all accesses is no group
anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.operators.model import _KEY, cache_key
from postlake.plans.cut import cut
from postlake.plans.posts import CTE, posts

CELLS = 4096
CAPACITIES = (100, 1000, 10_000)


def as_number(rows: DataFrame, name: str) -> Column:
    """A number or time column as double, in its own order; local times and dates without any time zone."""
    c, kind = F.col(name), rows.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp_ntz":
        return (c - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(38, 6)").cast("double")
    return c.cast("double")


def numbered(rows: DataFrame, order: list[str], name: str, per: int = 1 << 20) -> DataFrame:
    """``rows`` with their position from 1 in ``order``. The first column, a number or a time without nulls,
    is cut at quantiles; cells are numbered apart and shifted by the counts of those before."""
    cells = min(CELLS, rows.count() // per + 1)
    if cells > 1:
        x = rows.withColumn("_x", as_number(rows, order[0]))
        cuts = sorted(set(x.approxQuantile("_x", [i / cells for i in range(1, cells)], 0.1 / cells)))
        dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_x", outputCol="_c").transform(x).withColumn("_c", F.col("_c").cast("int")).drop("_x")
    else:
        dealt = rows.withColumn("_c", F.lit(0))
    before = dealt.groupBy("_c").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("_c").orderBy(*order))
    return dealt.withColumn("_r", at).join(F.broadcast(before), "_c").withColumn(name, F.col("_before") + F.col("_r")).drop("_c", "_r", "_before")


def last_uses(x: DataFrame, key: str, width: int) -> DataFrame:
    """``x`` (position i) with ``last``: within ranges of positions first, then from range to range, so that a frequent key is no single group."""
    y = x.withColumn("_b", F.floor(F.col("i") / width))
    inner = y.withColumn("_l", F.lag("i").over(Window.partitionBy(key, "_b").orderBy("i")))
    ends = y.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_e")).agg(F.max("i").alias("_m"))
    ends = ends.withColumn("_p", F.lag("_m").over(Window.partitionBy("_k").orderBy("_e"))).drop("_m")
    return inner.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_e"))).withColumn("last", F.coalesce("_l", "_p")).drop("_b", "_l", "_k", "_e", "_p")


def earlier(values: np.ndarray, greater: bool) -> np.ndarray:
    """For each element the number of earlier ones that are strictly greater (or smaller), bit by bit."""
    n = len(values)
    out = np.zeros(n, np.int64)
    rank = np.unique(values, return_inverse=True)[1]
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        group = rank[order] >> (bit + 1)
        one = (rank[order] >> bit & 1).astype(bool)
        counted = one if greater else ~one
        total = np.cumsum(counted)
        first = np.searchsorted(group, group)
        base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
        asks = ~counted
        out[order[asks]] += (total - base)[asks]
    return out


def _inside(t: pa.Table) -> pa.Table:
    """Of one range: earlier accesses with a greater last use."""
    m, p = t.column("m").to_numpy(), t.column("p").to_numpy()
    order = np.argsort(m)
    out = np.empty(len(m), np.int64)
    out[order] = earlier(p[order], True)
    return pa.table({"m": m, "c": out})


def _same_block(t: pa.Table) -> pa.Table:
    """Of one block of last uses in a node: accesses of earlier ranges with a greater last use."""
    m, p, child = (t.column(c).to_numpy() for c in ("m", "p", "child"))
    order = np.argsort(-p)
    out = np.empty(len(m), np.int64)
    out[order] = earlier(child[order], False)
    return pa.table({"m": m, "c": out})


def _cells(t: pa.Table) -> pa.Table:
    """Of one node: for every (block, range) the accesses in greater blocks and earlier ranges."""
    vb, child, n = (t.column(c).to_numpy() for c in ("vb", "child", "n"))
    blocks, row = np.unique(-vb, return_inverse=True)
    table = np.zeros((len(blocks), int(child.max()) + 1), np.int64)
    table[row, child] = n
    above = np.cumsum(table, axis=0) - table
    before = np.cumsum(above, axis=1) - above
    return pa.table({"node": t.column("node"), "vb": vb, "child": child, "c": before[row, child]})


def dominated(points: DataFrame, n: int, width: int, fan: int) -> DataFrame:
    """(m, c) with c the number of points m' < m whose p' > p. points: (m, p) with distinct m and distinct p in 1..n."""
    parts = [points.withColumn("node", F.floor(F.col("m") / width)).groupBy("node").applyInArrow(_inside, "m bigint, c bigint")]
    size = width
    while size <= n:
        at = points.withColumn("node", F.floor(F.col("m") / (size * fan))).withColumn("child", F.floor(F.col("m") / size) % fan).withColumn("vb", F.floor(F.col("p") / width))
        parts.append(at.groupBy("node", "vb").applyInArrow(_same_block, "m bigint, c bigint"))
        cells = at.groupBy("node", "vb", "child").agg(F.count("*").alias("n"))
        cells = cells.groupBy("node").applyInArrow(_cells, "node bigint, vb bigint, child bigint, c bigint").where("c > 0")
        parts.append(at.join(cells, ["node", "vb", "child"]).select("m", "c"))
        size *= fan
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("m").agg(F.sum("c").alias("c"))


def reuse_distances(accesses: DataFrame, order: list[str], key: str, width: int = 1 << 18, fan: int = 64) -> DataFrame:
    """``accesses`` with ``others``: the number of other keys used since the last use of the row's key, null at its first use.
    A null key is a key. Rows that agree in ``order`` may stand in either order."""
    x = cut(last_uses(numbered(accesses, order, "i"), key, width))
    n = x.count()
    points = x.where("last is not null").select(F.col("i").alias("m"), F.col("last").alias("p"))
    found = dominated(points, n, width, fan)
    return x.join(found, x["i"] == found["m"], "left").withColumn("others", F.col("i") - F.col("last") - 1 - F.col("c")).drop("i", "last", "m", "c")


def lru_global(accesses: DataFrame, order: list[str], key: str, capacity: int = 10_000, **sizes) -> DataFrame:
    """``accesses`` with ``hit``: whether a cache of ``capacity`` entries for the whole log holds the key when the row comes."""
    return reuse_distances(accesses, order, key, **sizes).withColumn("hit", F.coalesce(F.col("others") < capacity, F.lit(False))).drop("others")


def _log(s: SparkSession, d: str) -> DataFrame:
    """The posts as an access log: each user asks for posts in a session of their own, so keys are many."""
    return posts(s, d).select("ts", "post_id", F.sha2(F.concat(cache_key(F.col("text"), F.col("context")), F.lit("|"), F.col("user_id").cast("string")), 256).alias("key"))


def _curve(s: SparkSession, d: str) -> DataFrame:
    """Hits, misses and hit rate of caches of several capacities over the whole log."""
    x = reuse_distances(_log(s, d), ["ts", "post_id"], "key").select(F.explode(F.array(*map(F.lit, CAPACITIES))).alias("capacity"), "others")
    hit = F.count_if(F.col("others") < F.col("capacity"))
    return x.groupBy(F.col("capacity").cast("long").alias("capacity")).agg(hit.alias("hits"), (F.count("*") - hit).alias("misses"), F.round(100.0 * hit / F.count("*"), 2).alias("hit_rate"))


QUERIES = {"lru_global": _curve}
ORACLE = {
    "lru_global": f"""WITH {CTE},
k AS (SELECT sha256({_KEY} || '|' || CAST(user_id AS VARCHAR)) AS key, row_number() OVER (ORDER BY ts, post_id) AS i FROM posts),
x AS (SELECT i, lag(i) OVER (PARTITION BY key ORDER BY i) AS last, coalesce(lead(i) OVER (PARTITION BY key ORDER BY i), 1e15::BIGINT) AS next FROM k),
d AS (SELECT a.i, count(b.i) AS others FROM x a LEFT JOIN x b ON b.i > a.last AND b.i < a.i AND b.next > a.i WHERE a.last IS NOT NULL GROUP BY a.i),
y AS (SELECT others FROM x LEFT JOIN d USING (i)), c AS (SELECT unnest([100, 1000, 10000])::BIGINT AS capacity)
SELECT capacity, count(*) FILTER (others < capacity) AS hits, count(*) - count(*) FILTER (others < capacity) AS misses, round(100.0 * count(*) FILTER (others < capacity) / count(*), 2) AS hit_rate FROM y, c GROUP BY 1"""
}
