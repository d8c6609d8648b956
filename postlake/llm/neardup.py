"""Operator 3: near-duplicate detection with SetSketch registers.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z)
words; fewer words make one shingle, no words none. Documents with equal sets
form a class first, so thousands of copies cost one candidate. Each class has a
SetSketch: 144 registers that hold the minimum of an exponentially distributed
hash, truncated on a scale spaced by powers of b = 1.001. Minima merge by
maximum of registers, and equal registers are at least as likely as the
similarity. 36 bands of 4 registers give candidate buckets: two sets of
similarity 0.85 share none with probability 3e-12, of 0.8 with 6e-9.

Inside a bucket, every member is paired with the bucket's smallest member only;
the similarity is then estimated jointly with the known set sizes by maximum
likelihood over the counts of greater, smaller and equal registers, and pairs
within six standard deviations of the threshold are confirmed on full sets.
After linking, buckets whose members are still in different components are
worked off exactly: their members form clusters, a cluster is cut into blocks of
bounded size by set size and component, and each pair of blocks that meets in a
bucket and can hold a link between components is one task, which counts all
intersections of its full sets at once and returns a spanning forest of the links. So no
pair that shares a bucket and could join two components goes untested, a task's
size is bounded, and no more links than members leave a task. Components come
from a contraction that runs wholly in Spark.

Null and empty texts have an empty set and stand alone. Every row is a node of its
own, also where doc_ids repeat or are null: a group's component_id is its smallest
doc_id that is not null, or null where it has none, and then one of its rows is
kept. An empty table gives no rows. Columns other than doc_id and text are not
read; ``deduplicated`` returns all columns and one row of each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingle import doc_sets

BANDS, ROWS = 36, 4
M = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
_SEEDS = common.keys(31, M)
_BAND_KEYS = common.keys(32, BANDS)
#: Shingles in a block of a cluster (a row counts 1/1600 of it at least), and the set count up to which a value is counted by pairs.
BLOCK, LIGHT = 400_000, 16


def registers(minima: np.ndarray) -> np.ndarray:
    """SetSketch registers from the minima of uniform 64-bit hashes."""
    u = (minima.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def sketches(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Registers of every document that has shingles, in order; (documents, M)."""
    full = np.flatnonzero(np.diff(begin) > 0)
    at = begin[:-1][full]
    out = np.empty((M, len(full)), np.uint64)
    with np.errstate(over="ignore"):
        h = hashes ^ (hashes >> np.uint64(32))
        for i in range(M):
            out[i] = np.minimum.reduceat(h * _SEEDS[i], at) if len(full) else 0
    return registers(out.T) if len(full) else np.zeros((0, M), np.uint16)


def band_keys(sk: np.ndarray) -> np.ndarray:
    """One int64 key per band and document."""
    r = sk.reshape(len(sk), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        k = (r[:, :, 0] << np.uint64(48)) | (r[:, :, 1] << np.uint64(32)) | (r[:, :, 2] << np.uint64(16)) | r[:, :, 3]
        return common.mix(k ^ _BAND_KEYS[None, :]).view(np.int64)


def summarise(docs: DataFrame) -> DataFrame:
    """id, n_shingles, digest of the set, sketch; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            n = len(offsets) - 1
            counts, digests, sks = np.zeros(n, np.int64), [b""] * n, [b""] * n
            for i, j in common.chunks(offsets):
                h, begin = doc_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sk = sketches(h, begin)
                full = np.flatnonzero(np.diff(begin) > 0)
                for row, d in enumerate(full):
                    u = np.unique(h[begin[d] : begin[d + 1]])
                    counts[i + d] = len(u)
                    digests[i + d] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                    sks[i + d] = sk[row].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sks, pa.binary())], names=["id", "n_shingles", "digest", "sketch"])

    return docs.select("id", "text").mapInArrow(common.task(run), "id bigint, n_shingles bigint, digest binary, sketch binary")


def banded(reps: DataFrame) -> DataFrame:
    """(id, key) for every band of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sk = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(1)])
            keys = band_keys(sk)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], names=["id", "key"])

    return reps.select("id", "sketch").mapInArrow(common.task(run), "id bigint, key bigint")


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity from two sketches and known set sizes."""
    up = (a > b).sum(1).astype(float)
    down = (a < b).sum(1).astype(float)
    same = M - up - down
    u, v = na / (na + nb), nb / (na + nb)
    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    scale = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, None) * scale) / np.log(BASE)

    def score(j):
        pu, pd = p(u - v * j), p(v - u * j)
        return up * np.log(pu) + down * np.log(pd) + same * np.log(np.clip(1 - pu - pd, 1e-12, None))

    for _ in range(30):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = score(x) < score(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose estimate is within six deviations of it."""
    t = percent / 100
    least = t - 6 * (t * (1 - t) / M) ** 0.5
    size = reps.select("id", "n_shingles")
    fits = (
        pairs.join(size.select(F.col("id").alias("a"), F.col("n_shingles").alias("na")), "a")
        .join(size.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb")), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )
    both = fits.join(reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(k)]) for k in (2, 3))
            est = likely(sa, sb, batch.column(4).to_numpy().astype(float), batch.column(5).to_numpy().astype(float))
            keep = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(common.task(run), "a bigint, b bigint")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = common.durable(_full_sets(docs, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common_n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_n >= percent * (len(p) + len(q) - common_n))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    out = common.durable(joined.select("a", "b", "sa", "sb").mapInArrow(common.task(run), "a bigint, b bigint").distinct())
    common.drop(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, root): every linked id and the smallest id reachable, by hooking to the
    smallest neighbour, jumping to the end of the hooks, and contracting."""
    edges = common.durable(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    made = [edges]
    result = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hook = common.durable(ends.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("root")))
        made.append(hook)
        while True:
            far = hook.select(F.col("id").alias("root"), F.col("root").alias("far"))
            nxt = common.durable(hook.join(far, "root", "left").select("id", F.coalesce("far", "root").alias("root"), (F.col("far") < F.col("root")).alias("moved")))
            moved = not nxt.where("moved").isEmpty()
            hook = nxt.select("id", "root")
            made.append(nxt)
            if not moved:
                break
        if result is None:
            result = hook
        else:
            result = result.join(hook.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "left").select("id", F.coalesce("far", "root").alias("root"))
        result = common.durable(result)
        a = hook.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        edges = common.durable(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        made += [result, edges]
    common.drop(*(m for m in made if m is not result))
    return result if result is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)


def intersections(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n x n matrix of the numbers of common values of n sets, given as (row, value) pairs."""
    order = np.argsort(values, kind="stable")
    r, v = rows[order], values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(v)))
    out = np.zeros((n, n), np.float32)
    # values of few sets: all their pairs at once; of many: matrix products over columns
    for size in range(2, LIGHT + 1):
        at = first[length == size]
        step = max(1, 500_000 // (size * size))
        for i in range(0, len(at), step):
            member = r[at[i : i + step, None] + np.arange(size)]
            flat, times = np.unique(member[:, :, None] * n + member[:, None, :], return_counts=True)
            out.reshape(-1)[flat] += times
    heavy = np.flatnonzero(length > LIGHT)
    for i in range(0, len(heavy), 1024):
        own = heavy[i : i + 1024]
        a = np.zeros((n, len(own)), np.float32)
        for k, h in enumerate(own):
            a[r[first[h] : first[h] + length[h]], k] = 1
        for j in range(0, n, 512):
            out[j : j + 512] += a[j : j + 512] @ a.T
    return out


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest over components of the links between the members of one task."""
    ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
    size = np.array([len(x) for x in sets], np.int64)
    n = len(ids)
    common_n = intersections(np.repeat(np.arange(n), size), np.concatenate(sets), n)
    parent = {int(x): int(x) for x in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for i in range(n - 1):
        m = common_n[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero((100 * m >= percent * (size[i] + size[i + 1 :] - m)) & (roots[i + 1 :] != roots[i])):
            p, q = find(int(roots[i])), find(int(roots[i + 1 + j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(int(ids[i]))
                b.append(int(ids[i + 1 + j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the rows whose id is in ``ids``; the sorted full set as bytes."""
    need = docs.select("id", "text").join(common.bounded(ids.select("id"), 8), "id", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            sets: list[bytes] = []
            for i, j in common.chunks(offsets):
                h, begin = doc_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sets += [np.unique(h[begin[d] : begin[d + 1]]).tobytes() for d in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return need.mapInArrow(common.task(full), "id bigint, set binary")


def _blocks(member: DataFrame, percent: int) -> DataFrame:
    """``member`` (id, cluster, root, n_shingles) with ``block``: parts of a cluster of about ``BLOCK``
    shingles, by set size (two sizes that are not neighbours cannot meet the threshold) and by component.
    A large component fills blocks of its own, so that it is never compared with itself; only sums
    by cluster, size and component are shuffled, and no task orders a cluster."""
    cost = F.col("n_shingles") + BLOCK // 1600
    heavy = common.bounded(member.groupBy("cluster").agg(F.sum(cost).alias("all")).where(F.col("all") > BLOCK))
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent)))
    sized = member.join(heavy, "cluster", "left").withColumn("band", F.when(F.col("all").isNotNull(), step).otherwise(F.lit(0))).drop("all")
    weight = sized.groupBy("cluster", "band", "root").agg(F.sum(cost).alias("w")).withColumn("own", F.col("w") > BLOCK // 2)
    rest = weight.where("not own").groupBy("cluster", "band").agg(F.sum("w").alias("rest"))
    parts = common.bounded(weight.join(rest, ["cluster", "band"], "left").select("cluster", "band", "root", "own", F.ceil(F.when(F.col("own"), F.col("w")).otherwise(F.col("rest")) / BLOCK).alias("parts")), 40)
    dealt = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("id")).otherwise(F.col("root"))), F.col("parts"))
    return sized.join(parts, ["cluster", "band", "root"]).select("id", "root", "n_shingles", F.xxhash64("cluster", "band", "own", F.when(F.col("own"), F.col("root")).otherwise(F.lit(0)), dealt).alias("block"))


def _cluster_links(shared: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame | None:
    """Links between components inside buckets that the pivots left open."""
    placed = shared.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    whole = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.min("id").alias("a"))
    open_keys = common.durable(whole.where("lo < hi and n > 2").select("key", "a"))
    if open_keys.isEmpty():
        common.drop(open_keys)
        return None
    inside = common.durable(shared.join(open_keys, "key").select("key", "id", "a"))
    cluster = components(inside.where("id <> a").select("a", F.col("id").alias("b"))).select("id", F.col("root").alias("cluster"))
    member = cluster.join(roots, "id", "left").select("id", "cluster", F.coalesce("root", "id").alias("root")).join(reps.select("id", "n_shingles"), "id")
    member = common.durable(_blocks(member, percent))
    block = member.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    # only blocks that meet in a bucket are compared
    met = common.durable(inside.select("key", "id").join(member.select("id", "block"), "id").select("key", "block").distinct().join(block, "block"))
    other = met.select("key", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "least", "most")])
    pairs = common.durable(
        met.join(other, "key")
        .where("block <= block2")
        .where("not (lo = hi and lo2 = hi2 and lo = lo2)")
        .where((F.col("most") * 100 >= F.col("least2") * percent) & (F.col("most2") * 100 >= F.col("least") * percent))
        .select("block", "block2")
        .distinct()
    )
    ends = pairs.select(F.col("block").alias("at"), "block", "block2").union(pairs.where("block <> block2").select(F.col("block2").alias("at"), "block", "block2"))
    sets = common.durable(_full_sets(docs, member.select("id")))
    # each set meets its id once, and is dealt to pairs of blocks after that
    dealt = member.join(sets, "id").withColumnRenamed("block", "at").join(ends, "at").select("block", "block2", "id", "root", "set")
    found = dealt.groupBy("block", "block2").applyInArrow(lambda t: _block_links(t, percent), "a bigint, b bigint")
    out = common.durable(found)
    common.drop(open_keys, inside, member, met, pairs, sets)
    return out


def linked_classes(reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, root) of the classes that are linked with another. reps: durable (id, n_shingles, sketch)."""
    members = banded(reps)
    pivots = common.durable(members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a"))
    shared = common.durable(members.join(pivots, "key").select("key", "id", "a"))
    common.drop(pivots)
    pairs = shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    likely_pairs = common.durable(_estimated(pairs, reps, percent))
    links = _confirmed(likely_pairs, docs, percent)
    roots = components(links)
    more = _cluster_links(shared.select("key", "id"), roots, reps, docs, percent)
    out = roots if more is None else components(links.unionByName(more))
    common.drop(shared, likely_pairs, links)
    return out


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """docs: (id, text) with unique ids. (id, n_shingles, component) of every row; component is the smallest id of its group."""
    each = common.durable(summarise(docs))
    full = each.where("n_shingles > 0")
    classes = common.durable(full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = common.durable(full.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"]).select("id", "n_shingles", "sketch"))
    roots = linked_classes(reps, docs, percent)
    joined = classes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").where("copies > 1 or root is not null")
    named = common.durable(joined.select("digest", F.coalesce("root", "rep").alias("component")))
    common.drop(classes, reps, roots)
    return each.select("id", "n_shingles", "digest").join(named, "digest", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = common.keyed(docs.select("doc_id", "text"), "id")
    found = grouped(rows.select("id", "text"), percent)
    if not hasattr(rows, "_postlake_path"):
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    # row numbers stand for ids that repeat or are null: a group's name is its smallest doc_id
    named = common.durable(found.join(rows.select("id", F.col("doc_id").cast("long").alias("doc_id")), "id"))
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"))
    kept = F.when(F.col("component_id").isNull(), F.col("id") == F.col("first")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return named.join(first, "component").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``: that of the smallest doc_id (null last)."""
    key = common.free_name(docs, "_row")
    rows = common.keyed(docs, key)
    found = grouped(rows.select(F.col(key).alias("id"), "text"), percent)
    if hasattr(rows, "_postlake_path"):
        named = common.durable(found.join(rows.select(F.col(key).alias("id"), "doc_id"), "id"))
        first = named.groupBy("component").agg(F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("id"))
        gone = named.join(first, ["component", "id"], "left_anti").select(F.col("id").alias("_gone"))
    else:
        gone = found.where("id <> component").select(F.col("id").alias("_gone"))
    gone = common.bounded(gone)
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti").select(*docs.columns)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), 85)
