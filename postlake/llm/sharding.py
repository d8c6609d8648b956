"""Operator 9 [native]: reproducible shuffle and sharding by a Feistel permutation.

Rows get global numbers 0..N-1 in order of doc_id (ties by text digest, so
repeated rows take adjacent numbers in any order without changing the result
rows). A balanced or near-balanced Feistel network over the smallest power of
two that holds N, with cycle walking back into range, permutes the numbers; the
permuted number p gives shard = p mod S and slot = p div S. Shard counts differ
by one at most, and slots of a shard are 0, 1, 2, ... without a gap.

Numbering needs no single-partition window: rows are cut into ranges of doc_id
at approximate quantiles, each range is counted, and a row's number is its
range's offset plus its rank inside it. Only (doc_id, size, crc, digest) moves;
texts never do. A doc_id that repeats over a whole quantile step is cut further
by the leading bits of the text digest.

Null doc_id sorts first; null text has size 16 and crc of the empty text; an
empty table gives an empty result; extra columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlake.functions.text import let

from . import common

PRIME = 2147483647
#: Round constants (multiplier, addend), fixed values.
ROUNDS = [(1103515245, 12345), (1664525, 1013904223), (69069, 362437), (1812433253, 907633385)]
#: Steps of the walk, then the most steps of the few rows that are still outside.
STEPS = (4, 64, 4096, 1 << 16)


def feistel(x: Column, bits: int) -> Column:
    """One pass of the network over ``bits`` bits; halves of bits//2 and the rest swap widths each round.
    A fold over the rounds binds both halves, where nesting would repeat one at each of its uses."""
    low = bits // 2
    widths = [(bits - low, low), (low, bits - low)]
    rounds = F.array(*[F.struct(F.lit(mul).alias("mul"), F.lit(add).alias("add"), F.lit((1 << widths[k % 2][0]) - 1).cast("long").alias("mask")) for k, (mul, add) in enumerate(ROUNDS)])

    def one(half: Column, r: Column) -> Column:
        y = (half["r"] * r["mul"] + r["add"]) % F.lit(PRIME)
        f = F.shiftright((y * y + y) % F.lit(PRIME), 3).bitwiseAND(r["mask"])
        return F.struct(half["r"].alias("l"), half["l"].bitwiseXOR(f).alias("r"))

    start = F.struct(F.shiftright(x, low).alias("l"), x.bitwiseAND(F.lit((1 << low) - 1).cast("long")).alias("r"))
    return F.aggregate(rounds, start, one, lambda h: F.shiftleft(h["l"], widths[len(ROUNDS) % 2][1]).bitwiseOR(h["r"]))


def permute(number: Column, n: int) -> Column:
    """Image of a row number under the permutation of 0..n-1: walk until inside. At least half of all
    values are inside after a pass, so most rows take few steps; a walk that never ends is an error."""
    bits = max(2, (max(n, 2) - 1).bit_length())
    bits += bits % 2 if bits < 4 else 0

    def walk(x: Column, steps: tuple) -> Column:
        if not steps:
            return F.raise_error(F.lit("a walk left the range")).cast("long")
        far = F.aggregate(F.sequence(F.lit(1), F.lit(steps[0])), x, lambda acc, _: F.when(acc >= F.lit(n), feistel(acc, bits)).otherwise(acc))
        return let(far, lambda y: F.when(y < F.lit(n), y).otherwise(walk(y, steps[1:])))

    return walk(feistel(number, bits), STEPS)


def _bucket(x: Column, cuts: list[int]) -> Column:
    """Number of cuts that are at most x, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    n = len(cuts)
    arr = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda pos, s: F.when((pos + s <= F.lit(n)) & (F.get(arr, pos + s - 1) <= x), pos + s).otherwise(pos))


def numbered(rows: DataFrame, key: str, tie: str, ranges: int | None = None) -> tuple[DataFrame, int]:
    """``rows`` with ``number`` 0..N-1 by (key, tie), and N.

    The cuts only decide which task ranks a row, never its number. A key value
    that fills a whole quantile step gets a range of its own, cut further by the
    leading bits of ``tie``, which keep the order.
    """
    spark = rows.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    heavy = sorted({c for c, d in zip(found, found[1:]) if c == d})
    cuts = sorted({*found, *(c + 1 for c in heavy)})
    sub = F.when(F.col(key).isin(heavy), F.shiftright(F.col(tie), 58) + F.lit(32)).otherwise(F.lit(0).cast("long")) if heavy else F.lit(0).cast("long")
    cut = rows.withColumn("_part", _bucket(F.col(key), cuts)).withColumn("_sub", sub)
    counts = cut.groupBy("_part", "_sub").count().collect()  # at most ranges + 64 rows for each heavy value
    total, flat, first = 0, [], {}
    sizes = {(r["_part"], r["_sub"]): r["count"] for r in counts}
    for part in range(len(cuts) + 1):
        first[part] = len(flat)
        for k in range(64 if part and cuts[part - 1] in heavy else 1):
            flat.append(total)
            total += sizes.get((part, k), 0)
    if not total:
        return cut.drop("_part", "_sub").withColumn("number", F.lit(0).cast("long")), 0
    # literal arrays bounded by the number of ranges
    starts = F.array(*[F.lit(x).cast("long") for x in flat])
    where = F.array(*[F.lit(first[p]) for p in range(len(cuts) + 1)])
    w = Window.partitionBy("_part", "_sub").orderBy(key, tie)
    offset = F.get(starts, F.get(where, F.col("_part")) + F.col("_sub"))
    ranked = cut.withColumn("_rank", F.row_number().over(w)).withColumn("number", offset + F.col("_rank") - 1)
    return ranked.drop("_part", "_sub", "_rank"), total


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"),
        F.xxhash64(text).alias("_tie"),
    )
    ranked, n = numbered(rows, "_key", "_tie")
    return ranked.withColumn("_p", permute(F.col("number"), n)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {int(shards)}").cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))


def _sql() -> str:
    bits = "greatest(2, CAST(ceil(log2(greatest((SELECT count(*) FROM documents), 2))) AS BIGINT))"
    rounds, left, right, wl, wr = [], "l0", "r0", "high", "low"
    src = "SELECT x, k, x >> low AS l0, x & ((CAST(1 AS BIGINT) << low) - 1) AS r0, low, high FROM {src}"
    for i, (mul, add) in enumerate(ROUNDS):
        y = f"((r{i} * {mul} + {add}) % {PRIME})"
        f = f"((({y} * {y} + {y}) % {PRIME}) >> 3) & ((CAST(1 AS BIGINT) << {wl}) - 1)"
        rounds.append(f"SELECT x, k, r{i} AS l{i + 1}, xor(l{i}, {f}) AS r{i + 1}, low, high FROM ({{src}})")
        wl, wr = wr, wl
    q = src.format(src="dom")
    for r in rounds:
        q = r.format(src=q)
    n = len(ROUNDS)
    return f"""
WITH RECURSIVE size AS (SELECT count(*) AS n, {bits} AS bits FROM documents),
dom AS (SELECT CAST(i AS BIGINT) AS x, 0 AS k, (bits // 2)::INT AS low, (bits - bits // 2)::INT AS high
        FROM size, range(CAST(1 AS BIGINT) << bits::INT) t(i)),
step AS (SELECT x, (l{n} << {wr}) | r{n} AS y FROM ({q})),
walk AS (
  SELECT x AS number, y AS p FROM step WHERE x < (SELECT n FROM size)
  UNION ALL
  SELECT w.number, s.y FROM walk w JOIN step s ON s.x = w.p WHERE w.p >= (SELECT n FROM size)),
crc AS (
  SELECT list(x ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS x
    FROM range(256) r(i))),
rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         CAST(xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS BIGINT) AS text_crc32,
         row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents, crc)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.text_crc32, 'rows' AS law,
       CAST(w.p % 40 AS INTEGER) AS shard, CAST(w.p // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows r JOIN walk w ON w.number = r.number AND w.p < (SELECT n FROM size)
"""
