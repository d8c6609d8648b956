r"""Operator 1 [native]: benchmark decontamination by SimHash windows.

A document leaks a benchmark item if some window of it, as many words long as
the item, has a weighted 5-word-shingle similarity (sum of smaller counts over
sum of larger counts) of at least 0.8 with the item. Words are lower-cased runs
of other characters than the six ASCII spaces.

Windows: every start in the document counts, clipped to the document. The first
best window begins or ends with a shared shingle (or begins the document): else
the next or the previous start is as good. So the windows beginning and those
ending at each shared shingle are taken, where enough shared shingles lie inside
for the similarity to be reached; the sorted positions tell that by one lookup.
A shared shingle is found while the words of a document stream through one
generated loop, by a lookup in the benchmark's shingle table; the texts of
documents that have such windows are read again. Each window gets a SimHash of
20 x 64 bits of its shingles, repeats numbered: the n-th occurrence of a shingle is
a feature of its own, so the weighted similarity of two windows is the plain one of
their features, and no frequent shingle rules the bits.

Multi-index lookup: 60 blocks of 17 bits; an index lists for every item and block
its value and the 17 values one bit away, so all fingerprints within 119 bits in
the blocks are found for certain. A pair of similarity 0.8 differs in a bit with
probability 0.15 (arc cosine of 8/9 over pi), so it lies about 155 of the 1020 bits apart
and meets in each block with probability 0.25: all 60 blocks miss it once in
25 million pairs, more similar ones less. Unrelated pairs meet with 18 in 131072 a
block, 0.8 % in all. A guarantee by counting alone up to 0.8 would need blocks in
which nearly all pairs meet. Pairs within ``RADIUS`` of all 1280 bits (six deviations
beyond the mean of 0.8) are then compared exactly, on the shingle strings. The pairs that
all this leaves out by chance are found for certain by ``rest``: of two sets of similarity
0.8 or more, the first fifth of their features (and one) in one order share one.

The benchmark's shingle table and index are broadcast only when their counted
rows are below ``BROADCAST_ROWS``; beyond that the same joins run shuffled,
on (document key, position, hash) rows without texts. Everything is built-in
functions. A document with a window of an item of fewer than five words matches
if it holds the whole item. Null and empty texts or items match nothing;
repeated rows of one doc_id give one result row; null doc_id is reported as
null; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import let

from . import common

SIZE = 5
LANES = 20
RADIUS = 271
WIDTH, EACH = 17, 3
BLOCKS = LANES * EACH
SIMILARITY = 0.8
BROADCAST_ROWS = 1_000_000
_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACES)), r"[ \t\n\x0B\f\r]+")


def shingle_strings(w: Column) -> Column:
    """All 5-word shingles in order; fewer words make one."""
    n = F.greatest(F.size(w) - F.lit(SIZE - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, SIZE), " "))


def numbered(shingles: Column) -> Column:
    """(shingle, which occurrence it is) for each, in order."""
    before = lambda s, i: F.size(F.filter(F.slice(shingles, F.lit(1), i), lambda x: x == s))
    repeats = F.transform(shingles, lambda s, i: F.struct(s.alias("s"), before(s, i).alias("k")))
    plain = F.transform(shingles, lambda s: F.struct(s.alias("s"), F.lit(0).alias("k")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(repeats)


def simhash(features: Column, lane: Column) -> Column:
    """64-bit SimHash of an array, another one for each ``lane``. Bits k, k + width, ... of all
    hashes are counted together, in the fields of number k of ``width``; a field holds every count."""
    n = F.size(features)
    width = F.when(n < 1 << 7, 8).when(n < 1 << 15, 16).otherwise(32)
    ones_of = F.when(n < 1 << 7, F.lit(sum(1 << k for k in range(0, 64, 8)))).when(n < 1 << 15, F.lit(sum(1 << k for k in range(0, 64, 16)))).otherwise(F.lit(sum(1 << k for k in range(0, 64, 32))))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def counted(c: Column) -> Column:
        return F.aggregate(c["hashes"], F.array_repeat(none, c["width"]), lambda acc, h: F.transform(acc, lambda x, k: x + F.call_function("shiftrightunsigned", h, k).bitwiseAND(c["mask"])))

    def bits(c: Column, counts: Column) -> Column:
        field = lambda j: F.call_function("shiftrightunsigned", F.get(counts, j % c["width"]), j - j % c["width"]).bitwiseAND(F.call_function("shiftleft", one, c["width"]) - 1)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda acc, j: F.when(field(j) * 2 > F.size(c["hashes"]), acc.bitwiseOR(F.call_function("shiftleft", one, j))).otherwise(acc))

    # hashes and counts are bound once; nesting would compute them again at each use
    bound = F.struct(F.transform(features, lambda f: F.xxhash64(f, lane)).alias("hashes"), width.alias("width"), ones_of.alias("mask"))
    return let(bound, lambda c: let(counted(c), lambda counts: bits(c, counts)))


def fingerprint(shingles: Column) -> Column:
    """The SimHashes of all lanes."""
    return let(let(shingles, numbered), lambda f: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: simhash(f, k)))


def blocks(fp: Column) -> Column:
    """(block, value) for the blocks of a fingerprint."""
    value = lambda k: F.call_function("shiftrightunsigned", F.get(fp, (k / EACH).cast("int")), k % EACH * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.struct(k.alias("block"), value(k).alias("value")))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, d: acc + d)


def met(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(wid, item_id) of the windows (wid, n, wfp) and items (item_id, n, ifp) of one length that agree in a block up to one bit."""
    index = items.select("item_id", "n", F.explode(blocks(F.col("ifp"))).alias("b")).select(
        "item_id", "n", F.col("b.block").alias("block"), F.explode(F.array(F.col("b.value"), *[F.col("b.value").bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(WIDTH)])).alias("value")
    )
    probe = windows.select("n", "wid", F.explode(blocks(F.col("wfp"))).alias("b")).select("n", "wid", F.col("b.block").alias("block"), F.col("b.value").alias("value"))
    small = items.count() * BLOCKS * (WIDTH + 1) <= BROADCAST_ROWS
    return probe.join(F.broadcast(index) if small else index, ["n", "block", "value"]).select("wid", "item_id").distinct()


def _rare(shingles: Column, least: float) -> Column:
    """The features of ``shingles`` that come first by hash: two sets of similarity ``least`` or more share one of these."""
    f = F.array_sort(F.transform(numbered(shingles), lambda x: F.xxhash64(x["s"], x["k"])))
    return F.slice(f, F.lit(1), F.size(f) - F.ceil(F.lit(least) * F.size(f) - 1e-9).cast("int") + 1)


def rest(windows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(wid, item_id) of the windows (wid, n, win) and items (item_id, n, ish) of one length that may be ``least`` similar,
    whatever their fingerprints are. What is similar holds ceil(least * size) features of either side at least, so the
    first features of both in one order meet; equal hashes of different features only add pairs."""
    a = windows.select("n", "wid", F.explode(let(shingle_strings(F.split("win", " ")), lambda x: _rare(x, least))).alias("f"))
    b = items.select("n", "item_id", F.explode(let(F.col("ish"), lambda x: _rare(x, least))).alias("f"))
    small = b.count() <= BROADCAST_ROWS
    return a.join(F.broadcast(b) if small else b, ["n", "f"]).select("wid", "item_id").distinct()


def similarity(a: Column, b: Column) -> Column:
    """Sum of smaller counts over sum of larger counts of two string multisets."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words, n, shingles, fp of every item that has words."""
    w = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("iw")).where(F.get("iw", F.lit(0)) != "").dropDuplicates()
    return w.select("item_id", "iw", F.size("iw").alias("n"), shingle_strings(F.col("iw")).alias("ish")).withColumn("ifp", fingerprint(F.col("ish")))


def _hash(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, at + F.lit(k)) for k in range(size)])


def _seed_table(items: DataFrame, size: int) -> DataFrame:
    """Hash of every shingle of the items and the item's length."""
    own = items.where(F.least("n", F.lit(SIZE)) == size)
    out = own.select("n", "iw", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("off"))
    return out.select(_hash(F.col("iw"), F.col("off"), size).alias("h"), "n").distinct()


def _starts(size: int, least: float) -> Column:
    """Starts of the windows of ``n`` words that begin or end at one of the sorted shared
    positions ``at`` and hold enough of them, in a document of ``n_words``."""
    at, full = F.col("at"), F.col("n") - (size - 1)
    # m / (a + b - m) >= least needs m >= least / (1 + least) * (a + b)
    need = lambda a: F.greatest(F.ceil(F.lit(least / (1.0 + least)) * (a + full) - 1e-9), F.lit(1)).cast("int")
    short = lambda s: need(F.least(full, F.col("n_words") - (size - 1) - s))
    begin = F.filter(at, lambda p, i: F.get(at, i + short(p) - 1) < p + full)
    end = F.filter(at, lambda p, i: (p >= full) & (i + 1 >= need(full)) & (F.get(at, i + 1 - need(full)) > p - full))
    head = F.when(F.get(at, short(F.lit(0)) - 1) < full, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(head, begin, F.transform(end, lambda p: p - full + 1)))


def windows(docs: DataFrame, items: DataFrame, size: int, least: float) -> DataFrame:
    """(doc_id, n, start, win): windows of ``n`` words that may reach ``least`` by shared shingles of ``size`` words."""
    seeds = _seed_table(items, size)
    # equal keys of different rows would only add windows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", F.xxhash64("doc_id", "text"))
    at = rows.select("_key", words(F.col("text")).alias("w")).select("_key", "w", F.posexplode_outer("w").alias("pos", "_word")).where(F.col("pos") + size <= F.size("w"))
    light = at.select("_key", F.size("w").alias("n_words"), "pos", _hash(F.col("w"), F.col("pos"), size).alias("h"))
    hits = light.join(F.broadcast(seeds) if seeds.count() <= BROADCAST_ROWS else seeds, "h")
    held = hits.groupBy("_key", "n", "n_words").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    chosen = common.bounded(held.select("_key", "n", _starts(size, least).alias("starts")).where(F.size("starts") > 0), F.size("starts") * 4 + 48)
    found = rows.join(chosen, "_key").select("doc_id", "n", "starts", words(F.col("text")).alias("w"))
    return found.select("doc_id", "n", "w", F.explode("starts").alias("start")).select("doc_id", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("win"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): each leaking pair once, with its best window."""
    items = common.durable(items_of(benchmark))
    sizes = [r[0] for r in items.select(F.least("n", F.lit(SIZE))).distinct().collect()]  # five values at most
    seen = None
    for size in sorted(sizes):
        got = windows(docs, items, size, least)
        seen = got if seen is None else seen.unionByName(got)
    if seen is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word")).limit(0)
    # equal windows of all documents are fingerprinted and compared once; fingerprints meet in the index by number
    found = common.durable(seen.select("doc_id", "n", "start", F.array_join("win", " ").alias("win")))
    # fingerprints are the work of this job: rows of a few bytes, spread over all tasks whatever their size in bytes
    apart = found.select("n", "win").distinct().repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n", "win")
    each = common.durable(apart.withColumn("wid", F.monotonically_increasing_id()).withColumn("wfp", fingerprint(shingle_strings(F.split("win", " ")))))
    near = met(each, items).join(each, "wid").join(items.select("item_id", "n", "ifp"), ["item_id", "n"]).where(distance(F.col("wfp"), F.col("ifp")) <= RADIUS).select("wid", "item_id")
    # fingerprints leave out a few similar pairs, by chance; the rest comes from shared features, for certain
    both = near.unionByName(rest(each, items, least)).distinct()
    pairs = both.join(each, "wid").join(items.select("item_id", "n", "ish"), ["item_id", "n"])
    sure = common.durable(pairs.select("n", "win", "item_id", let(shingle_strings(F.split("win", " ")), lambda a: similarity(a, F.col("ish"))).alias("similarity")).where(F.col("similarity") >= least).distinct())
    best = found.join(sure, ["n", "win"]).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.back")).alias("start_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item. Rows are judged one by one, also where doc_ids repeat or are null."""
    key = common.free_name(docs, "_row")
    rows = common.keyed(docs, key)
    bad = common.bounded(leaks(rows.select(F.col(key).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_bad")).distinct())
    return rows.join(bad, rows[key] == bad["_bad"], "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
its AS (SELECT item_id, len(w) AS n, least(len(w), 5) AS k, i AS off, array_to_string(w[i + 1:i + least(len(w), 5)], ' ') AS s
        FROM iw, range(len(w) - least(len(w), 5) + 1) r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM its),
ds AS (SELECT doc_id, k, len(w) AS n_words, i AS pos, array_to_string(w[i + 1:i + k], ' ') AS s FROM dw, ks, range(len(w) - k + 1) r(i)),
hit AS (SELECT DISTINCT d.doc_id, d.n_words, i.item_id, i.n, i.k, d.pos, d.s FROM ds d JOIN its i ON i.k = d.k AND i.s = d.s),
-- every start whose window holds a shared shingle; other windows share none
begins AS (SELECT DISTINCT doc_id, item_id, n, k, n_words, st AS start FROM hit, range(greatest(pos - (n - k), 0), pos + 1) r(st)),
win AS (SELECT b.doc_id, b.item_id, b.start, b.n, b.k, b.n_words, h.s, count(*) AS a FROM begins b
        JOIN hit h ON h.doc_id = b.doc_id AND h.item_id = b.item_id AND h.pos BETWEEN b.start AND b.start + b.n - b.k GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS b FROM its GROUP BY ALL),
sim AS (SELECT w.doc_id, w.item_id, w.start, any_value(w.n - w.k + 1) AS nb, any_value(least(w.n - w.k + 1, w.n_words - w.k + 1 - w.start)) AS na,
               sum(least(w.a, ic.b)) AS m FROM win w JOIN ic ON ic.item_id = w.item_id AND ic.s = w.s GROUP BY w.doc_id, w.item_id, w.start),
ok AS (SELECT doc_id, item_id, start, m / (na + nb - m) AS similarity FROM sim WHERE m >= 0.8 * (na + nb - m))
SELECT doc_id, item_id, max(similarity) AS similarity,
       CAST(arg_min(start, (-similarity, start)) AS INTEGER) AS start_word
FROM ok GROUP BY doc_id, item_id
"""
