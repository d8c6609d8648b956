"""Operator 12: similarity join on word shingles by PartEnum signatures.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z)
words; fewer words make one shingle, no words none. Documents with equal sets
form a class first, so thousands of copies cost one set.

Sizes are cut into bands whose ends differ by the similarity, so two sets that
may link lie in one band or in neighbours; each set takes part in the instance
of its own band and of the next. A set and one it links with differ in at most
k shingles, a quarter of its size at 0.8. The instance cuts the domain of shingle
hashes into groups of three partitions, more than k / 2 groups: some group then
holds at most one difference, so two of its three partitions agree. Every subset
of two partitions of a group is a signature, the hash of the shingles that fall
into it, and linked sets share one. Signatures of no shingles are left out: a
group is rich for a set if two of its partitions hold shingles, and where twice
the rich groups exceed k, a linked set shares a signature that is not empty. A
set that is not rich enough adds the signatures of another division of the
domain, and again until one makes it rich; two linked sets meet where the first
of them is rich. The sharing is certain, not likely. Sets for which k is 0 link
with equal ones alone.

Of the sets under one signature, each is paired with the smallest id of the band. A pair
goes on if its sizes allow the threshold and if a second division into cells
(one byte each) differs in no more cells than shingles may differ; both tests
are exact bounds. Full sets then confirm. Signatures whose members are still in
different components are worked off: up to ``FEW`` members by their open pairs,
more in pairs of bounded blocks (see neardup). So no pair that could join two
components goes untested, and rows grow with members, not with pairs of them.

Null and empty texts have an empty set and stand alone. Every row is a node of
its own, also where doc_ids repeat or are null: component_id is a group's
smallest doc_id that is not null, or null where it has none. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, neardup, shingle

PERCENT = 80
#: Members of a signature up to which its open pairs are listed, and signatures in a partition of their shuffle.
FEW, SHARE = 32, 2_000_000
#: Buckets of signatures for each of these partitions, signatures that are packed at a time, and those of a bucket that a task compares at once.
DEAL, PACK, HELD = 8, 1 << 20, 1 << 22
_HEAD = struct.Struct("<qi")
_SEEDS = common.keys(71, 256) | np.uint64(1)
_SUM, _SIGN, _CELL = common.keys(72, 3)


class Bands:
    """Size bands of one threshold: band i holds sizes low[i] to high[i]; instance i also takes band i - 1."""

    def __init__(self, percent: int):
        if not 75 <= percent < 100:
            raise ValueError("similarities from 75 to 99 per cent; below, sets may differ too much to be rich")
        low, high = [1], []
        while low[-1] < 1 << 40:
            high.append(low[-1] * 100 // percent)
            low.append(high[-1] + 1)
        self.percent, self.low, self.high = percent, np.array(low[:-1], np.int64), np.array(high, np.int64)
        most = self.differences(self.high)
        #: groups of an instance, and cells of the second division
        self.groups = most // 2 + 1 + (most + 8) // 16
        self.cells = 1 << np.maximum(5, np.ceil(np.log2(np.maximum(1.25 * most, 1))).astype(np.int64))

    def differences(self, sizes: np.ndarray) -> np.ndarray:
        """Most differences between a set of such a size and one it links with."""
        return sizes * (100 - self.percent) // self.percent

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def divided(h: np.ndarray, begin: np.ndarray, band: np.ndarray, bands: Bands, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature) pairs under the division ``seed`` of each set's instance ``band``, and which sets are rich enough."""
    groups = bands.groups[band]
    size = np.diff(begin)
    owner = np.repeat(np.arange(len(size)), size)
    with np.errstate(over="ignore"):
        x = h if seed == 0 else common.mix(h * _SEEDS[seed % 256] + np.uint64(seed))
        part = ((x >> np.uint64(32)) * (3 * groups[owner]).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(groups)])
        cell = 3 * base[owner] + part
        value = common.mix(h * _SUM)
        if seed:  # only there the hashes do not ascend already
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        total = np.add.reduceat(value, at) if len(at) else value
        cell = cell[at]
        group, row = np.unique(cell // 3, return_inverse=True)
        sums = np.zeros((len(group), 3), np.uint64)
        full = np.zeros((len(group), 3), bool)
        sums[row, cell % 3], full[row, cell % 3] = total, True
        whose = np.searchsorted(base, group, side="right") - 1
        rich = full.sum(1) > 1
        enough = 2 * np.bincount(whose[rich], minlength=len(size)) > bands.differences(size)
        # leave one partition out: the other two, if they hold anything
        left = (sums.sum(1, keepdims=True) - sums) + (np.uint64(3) * (group - base[whose]).astype(np.uint64)[:, None] + np.arange(3, dtype=np.uint64)) * _SIGN
        place = (band[whose].astype(np.uint64) * np.uint64(1 << 16) + np.uint64(seed))[:, None]
        sign = common.mix(common.mix(left) ^ common.mix(place))
    keep = (full.sum(1, keepdims=True) - full) > 0
    return np.repeat(whose, 3)[keep.ravel()], sign[keep], enough


def signatures(h: np.ndarray, begin: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, guest) of all sets, given as ascending distinct hashes; a guest is in the next band's instance."""
    sets, signs, guests = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    size = np.diff(begin)
    own = bands.band(np.maximum(size, 1))
    for step in (0, 1):
        band = own + step
        todo = np.flatnonzero(bands.differences(size) > 0)
        seed = 0
        while len(todo):
            take = np.repeat(begin[todo] - np.concatenate([[0], np.cumsum(size[todo])[:-1]]), size[todo]) + np.arange(int(size[todo].sum()))
            which, sign, enough = divided(h[take], np.concatenate([[0], np.cumsum(size[todo])]), band[todo], bands, seed)
            sets.append(todo[which])
            signs.append(sign)
            guests.append(np.full(len(sign), bool(step)))
            todo = todo[~enough]
            seed += 1
    return np.concatenate(sets), np.concatenate(signs), np.concatenate(guests)


def cells(h: np.ndarray, begin: np.ndarray, bands: Bands) -> list[bytes]:
    """One byte for each cell of every set: the sum of the hashes that fall into it. Cells fold by halves: adding both halves gives the set's half as many cells."""
    size = np.diff(begin)
    many = bands.cells[bands.band(np.maximum(size, 1)) + 1]
    owner = np.repeat(np.arange(len(size)), size)
    base = np.concatenate([[0], np.cumsum(many)])
    with np.errstate(over="ignore"):
        byte = (common.mix(h * _CELL) >> np.uint64(56)).astype(np.float64)
    place = base[owner] + (h & (many[owner] - 1).astype(np.uint64)).astype(np.int64)
    got = np.bincount(place, weights=byte, minlength=int(base[-1])).astype(np.int64).astype(np.uint8)
    return [got[base[i] : base[i + 1]].tobytes() if size[i] else b"" for i in range(len(size))]


def differing(a: bytes, b: bytes) -> int:
    """Cells in which two sets differ; at most as many as shingles in which they do."""
    p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    while len(q) > len(p):
        q = q[: len(q) // 2] + q[len(q) // 2 :]
    return int(np.count_nonzero(p != q))


# --------------------------------------------------------------------------
# the Spark job


def summarise(docs: DataFrame, percent: int) -> DataFrame:
    """id, n_shingles, digest of the set, cells; one pass, no shuffle."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            counts, digests, cell = [], [], []
            for i, j in common.chunks(offsets):
                h, begin = shingle.distinct_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts += np.diff(begin).tolist()
                digests += [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                cell += cells(h, begin, bands)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(cell, pa.binary())], names=["id", "n_shingles", "digest", "cells"])

    return docs.select("id", "text").mapInArrow(common.task(run), "id bigint, n_shingles bigint, digest binary, cells binary")


def pack(sign: np.ndarray, guest: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Signatures by bucket, and those of a bucket as bytes: smallest id, number, 31 bits and the guest's bit of each, and the
    gaps between the ids, which ascend, byte by byte (the high ones are nearly all 0). Bucket and bits stand for the signature;
    the rare two that differ and have them in common are one more pair for the bounds."""
    order = np.argsort(ids, kind="stable")
    bucket = (sign >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.uint64), kind="stable")]
    bucket, ids = bucket[order], ids[order].astype("<i8")
    value = (sign[order].astype(np.uint32) & ~np.uint32(1) | guest[order]).astype("<u4")
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    gap = np.append(ids[:1], ids[1:] - ids[:-1]).view("<u8")
    gap[at] = 0
    out = []
    for i, j, most in zip(at.tolist(), np.append(at[1:], len(ids)).tolist(), np.maximum.reduceat(gap, at).tolist(), strict=True):
        planes = gap[i:j].view(np.uint8).reshape(-1, 8)[:, : (most.bit_length() + 7) // 8].T
        out.append(_HEAD.pack(ids[i], j - i) + value[i:j].tobytes() + planes.tobytes())
    return bucket[at].astype(np.int32), out


def unpack(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Values (bits and guest) and ids of what ``pack`` made."""
    first, n = _HEAD.unpack_from(data)
    value = np.frombuffer(data, "<u4", n, _HEAD.size)
    planes = np.frombuffer(data, np.uint8, offset=_HEAD.size + 4 * n).reshape(-1, n)
    gap = np.zeros((n, 8), np.uint8)
    gap[:, : len(planes)] = planes.T
    return value, np.cumsum(gap.view("<u8").ravel()).view(np.int64) + first


def packs(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, data) of signatures that come as (sign, guest, id)."""

    def packed() -> pa.RecordBatch:
        bucket, data = pack(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(data, pa.binary())], names=["bucket", "data"])

    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= PACK:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def signed(docs: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(bucket, data) of all signatures of every text, packed."""
    bands = Bands(percent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = common.buffers(batch.column(1))
            for i, j in common.chunks(offsets):
                h, begin = shingle.distinct_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                which, sign, guest = signatures(h, begin, bands)
                yield sign, guest, ids[i + which]

    return docs.select("id", "text").mapInArrow(common.task(lambda batches: packs(found(batches), buckets)), "bucket int, data binary")


def meeting(packed: DataFrame, partitions: int) -> DataFrame:
    """What ``shared`` gives, for packed signatures, with the number n of rows that have the signature; those of a bucket of
    more than ``HELD`` come all, without ``a`` and n. Buckets pass by one after the other, and a task holds one."""

    def rows(bucket: int, value: np.ndarray, ids: np.ndarray, a: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
        sign = np.int64(bucket) << 31 | (value >> np.uint32(1)).astype(np.int64)
        known = [pa.nulls(len(ids), pa.int64()) if x is None else pa.array(x) for x in (a, n)]
        return pa.RecordBatch.from_arrays([pa.array(sign), pa.array((value & np.uint32(1)).astype(bool)), pa.array(ids), *known], names=["sign", "guest", "id", "a", "n"])

    def met(bucket: int, held: list) -> pa.RecordBatch:
        value, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        bits = np.sort(value >> np.uint32(1))
        often = np.unique(bits[1:][bits[1:] == bits[:-1]])
        own = np.isin(value >> np.uint32(1), often)
        value, ids = value[own], ids[own]
        order = np.lexsort((ids, value))  # hosts before guests
        value, ids = value[order], ids[order]
        first = np.searchsorted(value >> np.uint32(1), value >> np.uint32(1))
        hosted = value[first] & np.uint32(1) == 0
        n = np.bincount(first, minlength=len(ids))[first]
        return rows(bucket, value[hosted], ids[hosted], ids[first[hosted]], n[hosted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], 0
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != at:
                    if held:
                        yield met(at, held)
                    at, held, n = bucket, [], 0
                held.append(unpack(data.as_buffer()))
                n += len(held[-1][0])
                if n > HELD:
                    for value, ids in held:
                        yield rows(bucket, value, ids)
                    held = []
        if held:
            yield met(at, held)

    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(common.task(run), "sign bigint, guest boolean, id bigint, a bigint, n bigint")


def shared(signs: DataFrame, partitions: int) -> DataFrame:
    """(sign, guest, id, a) of signatures that several sets have, one of them no guest; a is the smallest that is none.
    Two guests meet in the instance of their own band. One shuffle; runs of the sorted rows pass by in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, alone = None, None, False  # of the run that ends the batch before; head is None where it has guests alone
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s, guest, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            length = np.diff(np.append(at, n))
            first = np.repeat(ids[at], length)
            hosted = np.repeat(~guest[at], length)
            keep = np.repeat(length > 1, length)
            out = []
            if last is not None and s[0] == last:  # that run goes on
                keep[: length[0]], hosted[: length[0]] = True, head is not None
                if head is not None:
                    first[: length[0]] = head
                    if alone:
                        out = [([last], [False], [head], [head])]
            end = at[-1]
            last, head, alone = s[-1], first[-1] if hosted[end] else None, not keep[end]
            keep &= hosted
            out.append((s[keep], guest[keep], ids[keep], first[keep]))
            for a, g, b, c in out:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(g, pa.bool_()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["sign", "guest", "id", "a"])

    dealt = signs.repartition(partitions, "sign").sortWithinPartitions("sign", "guest", "id")
    return dealt.mapInArrow(common.task(run), "sign bigint, guest boolean, id bigint, a bigint")


def possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and cells allow to link."""
    size = reps.select("id", "n_shingles")
    fits = (
        pairs.join(size.select(F.col("id").alias("a"), F.col("n_shingles").alias("na")), "a")
        .join(size.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb")), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    )
    both = fits.join(reps.select(F.col("id").alias("a"), F.col("cells").alias("ca")), "a").join(reps.select(F.col("id").alias("b"), F.col("cells").alias("cb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (100 - percent) // (100 + percent)
            keep = [differing(x.as_buffer(), y.as_buffer()) <= k for x, y, k in zip(batch.column(4), batch.column(5), most.tolist(), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(common.task(run), "a bigint, b bigint")


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Written links among ``pairs``."""
    likely = common.durable(possible(pairs, reps, percent))
    links = neardup._confirmed(likely, docs, percent)
    common.drop(likely)
    return links


def _met(packed: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Written rows (sign, guest, id, a, n) of the packed signatures that several have, and the table to drop after use."""
    made = common.durable(meeting(packed, partitions))
    loose = made.where("a is null").select("sign", "guest", "id")
    if loose.isEmpty():
        return made, made
    more = common.durable(shared(loose, partitions))
    more = more.join(more.groupBy("sign").agg(F.count("*").alias("n")), "sign").select(*made.columns)
    return made.where("a is not null").unionByName(more), made


def _open(groups: DataFrame, roots: DataFrame, least: int) -> DataFrame:
    """Written (sign, guest, id, root, n) of the groups of ``least`` members or more that are in several components."""
    placed = groups.select("sign", "guest", "id").join(roots, "id", "left").select("sign", "guest", "id", F.coalesce("root", "id").alias("root"))
    left = placed.groupBy("sign").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where(f"lo < hi and n >= {least}").select("sign", "n")
    return common.durable(placed.join(left, "sign"))


def _listed(inside: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one small group that are in different components, not both guests."""
    return (
        inside.where(F.col("n") <= FEW)
        .groupBy("sign")
        .agg(F.array_sort(F.collect_list(F.struct("guest", "id", "root"))).alias("m"))
        .select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.root <> x.root and not x.guest), y -> struct(x.id as a, y.id as b))))")).alias("p"))
        .select("p.a", "p.b")
        .distinct()
    )


def narrowed(ids: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Written (sign, guest, id): groups of the classes ``ids`` (id) by shingles, such that any two of them that link share a group.

    Linked sets of n shingles miss at most n - ceil(n * percent / 100) of each other's, so in any order that holds for all sets,
    the first shingle that both have is among the first so many and one of either. The order is by the number of sets in ``ids``
    that hold a shingle: first come those of one set alone, which join nothing. A passage in many texts that are otherwise
    different thus brings no two of them together; rows grow with shingles."""
    own = common.durable(reps.select("id", "n_shingles").join(ids, "id", "left_semi"))
    sets = common.durable(neardup._full_sets(docs, own))
    partitions = _partitions(own)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                yield h, np.zeros(len(h), bool), np.full(len(h), i, np.int64)

    packed = sets.select("id", "set").mapInArrow(common.task(lambda batches: packs(found(batches), DEAL * partitions)), "bucket int, data binary")
    often, made = _met(packed, partitions)
    each = Window.partitionBy("id")
    ranked = often.select("sign", "guest", "id", F.row_number().over(each.orderBy("n", "sign")).alias("r"), F.count("*").over(each).alias("held")).join(own, "id")
    # the n_shingles - held shingles of this set alone come before
    out = common.durable(ranked.where(f"r + n_shingles - held <= n_shingles - (n_shingles * {percent} + 99) div 100 + 1").select("sign", "guest", "id"))
    common.drop(own, sets, made)
    return out


def _partitions(sized: DataFrame) -> int:
    """Partitions for the signatures or shingles of sets of n_shingles."""
    rows = sized.agg(F.sum("n_shingles")).first()[0] or 0
    return max(int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(rows // SHARE) + 1)


def linked_classes(reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, root) of the classes that are linked with another. reps: written (id, n_shingles, cells); docs: their (id, text)."""
    partitions = _partitions(reps)
    groups, made = _met(signed(docs, percent, DEAL * partitions), partitions)
    links = _confirm(groups.where("id <> a").select("a", F.col("id").alias("b")).distinct(), reps, docs, percent)
    roots = common.durable(neardup.components(links))
    # what the smallest ids left open: signatures of more than two members in several components, and of the many
    # members of large ones again what their rarest shingles bring together, of which no pair is tested yet
    for again in (False, True):
        inside = _open(groups, roots, 2 if again else 3)
        links = common.durable(links.unionByName(_confirm(_listed(inside), reps, docs, percent)))
        roots = common.durable(neardup.components(links))
        large = inside.where(F.col("n") > FEW)
        common.drop(made)
        if again or large.isEmpty():
            break
        groups = made = narrowed(_open(large, roots, 3).select("id").distinct(), reps, docs, percent)
        common.drop(inside)
    if not large.isEmpty():
        rest = neardup._cluster_links(large.select(F.col("sign").alias("key"), "id"), roots, reps, docs, percent)
        if rest is not None:
            roots = neardup.components(links.unionByName(rest))
    common.drop(inside)
    return roots


def grouped(docs: DataFrame, percent: int) -> DataFrame:
    """docs: (id, text) with unique ids. (id, n_shingles, component) of every row; component is the smallest id of its group."""
    each = common.durable(summarise(docs, percent))
    full = each.where("n_shingles > 0")
    classes = common.durable(full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    first = full.join(classes, "digest").where("id = rep")
    reps = common.durable(first.select("id", "n_shingles", "cells"))
    others = each.select("id").join(reps.select("id"), "id", "left_anti")
    roots = linked_classes(reps, docs.join(common.bounded(others, 8), "id", "left_anti"), percent)
    joined = classes.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").where("copies > 1 or root is not null")
    named = common.durable(joined.select("digest", F.coalesce("root", "rep").alias("component")))
    common.drop(classes, reps)
    return each.select("id", "n_shingles", "digest").join(named, "digest", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows = common.keyed(docs.select("doc_id", "text"), "id")
    found = grouped(rows.select("id", "text"), percent)
    if not hasattr(rows, "_postlake_path"):
        return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    # row numbers stand for ids that repeat or are null: a group's name is its smallest doc_id
    named = common.durable(found.join(rows.select("id", F.col("doc_id").cast("long").alias("doc_id")), "id"))
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(first, "component").select("doc_id", "n_shingles", "component_id")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))
