"""Operator 10: removal of long repeats by enhanced suffix arrays.

A byte goes if it lies in a 50-byte string that also starts in a document of
smaller doc_id. Every 50-byte window of every text is judged, on UTF-8 bytes.

Windows meet by content-chosen anchors: a window's anchor is its least-hashed
20-byte gram (leftmost of equals), so equal windows have equal anchors at equal
places, and a text has one anchor per 16 bytes or so. An entry is an anchor
with the run of windows that chose it and their bytes (50 to 80). The work goes

1. texts are packed, about 2 MB together, compressed, to a shared table;
2. packs send the distinct hashes of their anchors to hash buckets; buckets
   answer which occur in two documents;
3. packs send the distinct entries of shared anchors, with the smallest doc_id
   of each, to the buckets. A bucket joins equal entries, builds a suffix array
   with common-prefix lengths over the window starts of each anchor that has
   several different entries, finds the tree of common-prefix intervals of 50
   bytes or more by a stack scan, and for each interval whose occurrences differ
   in the byte before them (the maximal repeats; the others are covered by the
   repeat one byte to the left) lowers the smallest doc_id of all windows inside
   all occurrences. Packs get back each entry's smallest doc_ids;
4. packs mark every window with a smaller doc_id than its document's.

A hash or passage in a third of all documents sends one item per pack, not per
document, so no bucket grows with the copies. Buckets grow in number with the
bytes. Nothing is sampled or capped.

Null text counts as empty. A null doc_id is neither smaller than any nor loses
bytes. Rows that share a doc_id do not remove from each other. An empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, GRAM = 50, 20
REACH = LEAST - GRAM  # farthest an anchor stands from the start of its window
LONGEST = LEAST + REACH
PACK, BUCKET = 2 << 20, 8 << 20
#: Grams whose places are counted from one start; a place has 26 bits.
SEGMENT = 1 << 25
_HIGH = np.uint64(0xFFFFFFFFFFFFFFFF << 26 & 0xFFFFFFFFFFFFFFFF)
_POS = np.uint64((1 << 26) - 1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD_KEYS = common.keys(51, LONGEST // 8 + 1)
NONE = np.iinfo(np.int64).min


# --------------------------------------------------------------------------
# suffix arrays


def suffix_array(texts: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes texts[row, start:end] and common-prefix length of each with the one before it."""
    n = len(rows)
    width = texts.shape[1]
    cols = starts.astype(np.int32)[:, None] + np.arange(width, dtype=np.int32)[None, :]
    inside = cols < ends[:, None]
    body = np.where(inside, texts[rows[:, None], np.minimum(cols, width - 1)], 0).astype(np.uint8)
    words = np.ascontiguousarray(np.pad(body, ((0, 0), (0, -width % 8)))).view(">u8")
    size = (ends - starts).astype(np.int64)
    order = np.lexsort([size, *words.T[::-1]])
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = body[order[1:]], body[order[:-1]]
        differ = a != b
        first = np.where(differ.any(1), differ.argmax(1), width)
        lcp[1:] = np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of every node of the common-prefix interval tree with length >= least, by a stack scan."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        cur = int(lcp[i]) if i < n else 0
        start = i - 1
        while stack and stack[-1][0] > cur:
            length, start = stack.pop()
            out.append((start, i - 1, length))
        if cur >= least and (not stack or stack[-1][0] < cur):
            stack.append((cur, start))
    return out


def maximal_groups(texts: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members, length) of every maximal repeat: members index rows/starts; all occurrences
    agree on ``length`` bytes and no byte more on either side. ``first`` is where each row's
    judged starts begin; before it the left neighbour counts as different."""
    order, lcp = suffix_array(texts, rows, starts, ends)
    left = np.where(starts > first, texts[rows, np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(rows)))
    for a, b, length in intervals(lcp, least):
        members = order[a : b + 1]
        before = left[members]
        if (before != before[0]).any() or before[0] < 0:
            yield members, length


# --------------------------------------------------------------------------
# anchors and entries of a pack


def least_grams(gram: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Place of the least-hashed usable gram (leftmost of equals) of every REACH + 1 neighbours. Places
    share a word with the hash, so they are counted within segments and texts may have any length."""
    out = []
    last = max(1, len(gram) - REACH)
    for begin in range(0, last, SEGMENT):
        end = min(begin + SEGMENT, last)
        v = (gram[begin : end + REACH] & _HIGH) | np.arange(min(end + REACH, len(gram)) - begin, dtype=np.uint64)
        v[~usable[begin : end + REACH]] = _TOP
        span, width = 1, REACH + 1
        m = v
        while span * 2 <= width:
            m = np.minimum(m[: len(m) - span], m[span:])
            span *= 2
        if span < width:
            gap = width - span
            m = np.minimum(m[: len(m) - gap], m[gap:])
        out.append((m & _POS).astype(np.int64) + begin)
    return np.concatenate(out)


class Entries:
    """Anchors of a pack: parallel arrays doc, anchor, lo, hi (window starts), gram."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        n = len(data)
        self.data, self.offsets, self.ids = data, offsets, ids
        if n < LEAST:
            self.doc = self.anchor = self.lo = self.hi = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        up, down = common.powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(common._LETTERS[data] * up[:n], out=total[1:])
            gram = common.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        size = np.diff(offsets)
        end_of = np.repeat(offsets[1:], size)
        real = np.repeat(ids != NONE, size)
        at = np.arange(n - GRAM + 1)
        usable = at + GRAM <= end_of[: n - GRAM + 1]
        m = least_grams(gram, usable)
        p = np.flatnonzero((np.arange(len(m)) + LEAST <= end_of[: len(m)]) & real[: len(m)])
        a = m[p]
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        i = np.flatnonzero(new)
        self.lo, self.anchor = p[i], a[i]
        self.hi = p[np.append(i[1:], len(p)) - 1] if len(p) else p[:0]
        self.gram = gram[self.anchor]
        self.doc = np.searchsorted(offsets, self.lo, side="right") - 1

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, sorted, and which occur in several of the pack's doc_ids."""
        order = np.lexsort([self.ids[self.doc], self.gram]) if len(self.gram) else np.zeros(0, np.int64)
        g, d = self.gram[order], self.ids[self.doc][order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        i = np.flatnonzero(new)
        if not len(i):
            return g, np.zeros(0, bool)
        last = np.append(i[1:], len(g)) - 1
        return g[i], d[i] != d[last]

    def distinct(self, shared: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Distinct entries among those of ``shared`` hashes (sorted): arrays gram, lo, hi (from the
        anchor), doc (smallest) and text; the distinct one of each chosen entry, and the chosen entries."""
        if not len(shared) or not len(self.gram):
            pick = np.zeros(0, np.int64)
        else:
            pick = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, self.gram), len(shared) - 1)] == self.gram)
        lo, hi, a, g, d = self.lo[pick], self.hi[pick], self.anchor[pick], self.gram[pick], self.ids[self.doc[pick]]
        cols = lo.astype(np.int32)[:, None] + np.arange(LONGEST, dtype=np.int32)[None, :]
        text = np.where(cols < (hi + LEAST)[:, None], self.data[np.minimum(cols, max(len(self.data) - 1, 0))], 0).astype(np.uint8) if len(pick) else np.zeros((0, LONGEST), np.uint8)
        table = {"gram": g, "lo": (a - lo).astype(np.uint8), "hi": (a - hi).astype(np.uint8), "doc": d, "text": text}
        t, place = unify(table)
        return t, place, pick


def unify(t: dict) -> tuple[dict, np.ndarray]:
    """Equal entries as one with the smallest doc, sorted by gram; and each row's place among them."""
    n = len(t["gram"])
    if not n:
        return t, np.zeros(0, np.int64)
    words = np.ascontiguousarray(t["text"]).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (t["lo"].astype(np.uint64) << np.uint64(8)) | t["hi"].astype(np.uint64)
        for k in range(words.shape[1]):
            h = common.mix(h ^ (words[:, k] * _WORD_KEYS[k]))
    order = np.lexsort([h, t["gram"]])
    g, hs, w, lo, hi = t["gram"][order], h[order], words[order], t["lo"][order], t["hi"][order]
    new = np.ones(n, bool)
    # neighbours are one entry only where all bytes agree; a hash collision splits, it never joins
    new[1:] = (g[1:] != g[:-1]) | (hs[1:] != hs[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (w[1:] != w[:-1]).any(1)
    i = np.flatnonzero(new)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[i]
    return {"gram": t["gram"][first], "lo": t["lo"][first], "hi": t["hi"][first], "doc": np.minimum.reduceat(t["doc"][order], i), "text": t["text"][first]}, place


def settle(t: dict) -> np.ndarray:
    """Smallest doc of every window of distinct entries (rows; column j is the j-th window of the entry)."""
    n = len(t["gram"])
    best = np.repeat(t["doc"][:, None], REACH + 1, 1)
    if not n:
        return best
    flat = best.reshape(-1)
    new = np.ones(n, bool)
    new[1:] = t["gram"][1:] != t["gram"][:-1]
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    count = (t["lo"].astype(np.int64) - t["hi"] + 1)[several]
    rows = np.repeat(several, count)
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    ends = np.repeat(count + LEAST - 1, count)
    step = 40_000
    cut = 0
    while cut < len(rows):
        # whole anchors at a time
        end = min(cut + step, len(rows))
        while end < len(rows) and group[rows[end]] == group[rows[end - 1]]:
            end += 1
        r, s, e = rows[cut:end], starts[cut:end], ends[cut:end]
        for members, length in maximal_groups(t["text"], r, s, e, np.zeros(len(r), np.int64), LEAST):
            docs = t["doc"][r[members]]
            low = docs.min()
            later = members[docs > low]
            at = (r[later] * (REACH + 1) + s[later])[:, None] + np.arange(length - LEAST + 1)
            flat[at] = np.minimum(flat[at], low)
        cut = end
    return best


# --------------------------------------------------------------------------
# messages between packs and buckets


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _open(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _entries_blob(t: dict, rows: np.ndarray) -> bytes:
    return _squeeze(np.array([len(rows)], np.int64), t["gram"][rows], t["doc"][rows], t["lo"][rows], t["hi"][rows], t["text"][rows])


def _entries_of(blob: bytes) -> dict:
    raw = _open(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8, {}
    for name, kind, size in (("gram", np.uint64, 1), ("doc", np.int64, 1), ("lo", np.uint8, 1), ("hi", np.uint8, 1), ("text", np.uint8, LONGEST)):
        out[name] = np.frombuffer(raw, kind, n * size, at)
        at += out[name].nbytes
    out["text"] = out["text"].reshape(n, LONGEST)
    return out


class Dealt:
    """Rows dealt to hash buckets: sorted once, then cut; ``of(b)`` are the rows of bucket b, in order."""

    def __init__(self, g: np.ndarray, buckets: int):
        b = (common.mix(g) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(b, kind="stable")
        self.found, first = np.unique(b[self.order], return_index=True)
        self.cuts = np.append(first, len(b))

    def of(self, bucket: int) -> np.ndarray:
        i = int(np.searchsorted(self.found, bucket))
        return self.order[self.cuts[i] : self.cuts[i + 1]] if i < len(self.found) and self.found[i] == bucket else self.order[:0]

    def parts(self) -> list[np.ndarray]:
        return np.split(self.order, self.cuts[1:-1]) if len(self.found) else []


def packs(docs: DataFrame, size: int = PACK) -> DataFrame:
    """Texts in packs: pack, ids, offsets, body (compressed), n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            ids = batch.column(0).fill_null(int(NONE)).to_numpy(zero_copy_only=False).astype(np.int64)
            null = np.asarray(batch.column(0).is_null())
            out: list[tuple] = []
            for i, j in common.chunks(offsets, size):
                o = offsets[i : j + 1] - offsets[i]
                raw = data[offsets[i] : offsets[j]]
                out.append((uuid.uuid4().int >> 65, ids[i:j].tobytes(), null[i:j].tobytes(), o.astype(np.int64).tobytes(), _squeeze(raw), len(raw)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["pack", "ids", "nulls", "offsets", "body", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.task(run), "pack bigint, ids binary, nulls binary, offsets binary, body binary, n_bytes bigint")


def _read(batch: pa.RecordBatch, k: int) -> tuple[int, Entries]:
    row = {c: batch.column(c)[k].as_py() for c in ("pack", "ids", "offsets", "body")}
    data = np.frombuffer(_open(row["body"]), np.uint8)
    return row["pack"], Entries(data, np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["ids"], np.int64))


def _shared(e: Entries, bits: list, buckets: int) -> np.ndarray:
    """The pack's hashes that the buckets answered to be shared."""
    g, _ = e.hashes()
    dealt = Dealt(g, buckets)
    keep = np.zeros(len(g), bool)
    for x in bits:
        at = dealt.of(x["bucket"])
        keep[at] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(at)).astype(bool)
    return g[keep]


def remove_repeats(docs: DataFrame, pack_bytes: int = PACK, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row. Remaining bytes are digested,
    not returned as text, since cuts may split characters."""
    spark = docs.sparkSession
    pack = common.durable(packs(docs, pack_bytes))
    total = pack.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, e = _read(batch, k)
                g, several = e.hashes()
                dealt = Dealt(g, buckets)
                found = dealt.found
                blobs = [g[x].tobytes() + several[x].tobytes() for x in dealt.parts()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), p), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "pack", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        gs, flags = [], []
        for x in table.column("blob"):
            raw = x.as_py()
            n = len(raw) // 9
            gs.append(np.frombuffer(raw, np.uint64, n))
            flags.append(np.frombuffer(raw, bool, n, 8 * n))
        g, f = np.concatenate(gs), np.concatenate(flags)
        order = np.argsort(g, kind="stable")
        s = g[order]
        twice = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        # a hash that one pack flags is in one pack only or twice here anyway
        shared = f.copy()
        shared[order] |= twice
        ends = np.cumsum([len(x) for x in gs])
        bits = [np.packbits(shared[e - len(x) : e]).tobytes() for x, e in zip(gs, ends, strict=True)]
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    first = pack.mapInArrow(common.task(ask), "bucket bigint, pack bigint, blob binary").groupBy("bucket").applyInArrow(answer, "pack bigint, bucket bigint, bits binary")
    bits = common.durable(first.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, e = _read(batch, k)
                t, _, _ = e.distinct(_shared(e, batch.column("bits")[k].as_py() or [], buckets))
                dealt = Dealt(t["gram"], buckets)
                found = dealt.found
                blobs = [_entries_blob(t, x) for x in dealt.parts()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), p), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "pack", "blob"])

    def judge(table: pa.Table) -> pa.Table:
        parts = [_entries_of(x.as_py()) for x in table.column("blob")]
        sizes = [len(x["gram"]) for x in parts]
        t, place = unify({k: np.concatenate([x[k] for x in parts]) for k in parts[0]})
        best = settle(t)
        out, at = [], 0
        for n in sizes:
            mine = place[at : at + n]
            base = t["doc"][mine]
            low = best[mine]
            r, c = np.nonzero(low < base[:, None])
            out.append(_squeeze(np.array([n, len(r)], np.int64), base, r.astype(np.int64), low[r, c], c.astype(np.uint8)))
            at += n
        return pa.table({"pack": table.column("pack"), "bucket": table.column("bucket"), "best": pa.array(out, pa.binary())})

    known = pack.join(bits, "pack", "left")
    second = known.mapInArrow(common.task(send), "bucket bigint, pack bigint, blob binary").groupBy("bucket").applyInArrow(judge, "pack bigint, bucket bigint, best binary")
    best = common.durable(second.groupBy("pack").agg(F.collect_list(F.struct("bucket", "best")).alias("best")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, e = _read(batch, k)
                t, place, pick = e.distinct(_shared(e, batch.column("bits")[k].as_py() or [], buckets))
                low = np.repeat(t["doc"][:, None], REACH + 1, 1)
                dealt = Dealt(t["gram"], buckets)
                for x in batch.column("best")[k].as_py() or []:
                    raw = _open(x["best"])
                    n, m = (int(v) for v in np.frombuffer(raw, np.int64, 2))
                    at = dealt.of(x["bucket"])
                    low[at] = np.frombuffer(raw, np.int64, n, 16)[:, None]
                    r, lows = np.frombuffer(raw, np.int64, m, 16 + 8 * n), np.frombuffer(raw, np.int64, m, 16 + 8 * n + 8 * m)
                    low[at[r], np.frombuffer(raw, np.uint8, m, 16 + 8 * n + 16 * m)] = lows
                yield _results(e, low, place, pick, np.frombuffer(batch.column("nulls")[k].as_py(), bool))

    out = known.join(best, "pack", "left").mapInArrow(common.task(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out


def _results(e: Entries, low: np.ndarray, place: np.ndarray, pick: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    n = len(e.data)
    change = np.zeros(n + 1, np.int32)
    if len(pick):
        lo, hi = e.lo[pick], e.hi[pick]
        goes = (low[place] < e.ids[e.doc[pick]][:, None]) & (np.arange(REACH + 1)[None, :] <= (hi - lo)[:, None])
        r, c = np.nonzero(goes)
        p = lo[r] + c
        change += np.bincount(p, minlength=n + 1).astype(np.int32)
        change -= np.bincount(p + LEAST, minlength=n + 1).astype(np.int32)
    gone = np.cumsum(change[:n]) > 0
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    starts = e.offsets[:-1]
    edge[starts[starts < n]] = gone[starts[starts < n]]
    removed = np.concatenate([[0], np.cumsum(gone)])
    spans = np.concatenate([[0], np.cumsum(edge)])
    digests = [hashlib.sha256(e.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(e.offsets[:-1], e.offsets[1:], strict=True)]
    ids = pa.array(e.ids, pa.int64(), mask=null)
    take = lambda x: pa.array(x[e.offsets[1:]] - x[e.offsets[:-1]], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(e.offsets), pa.int64()), take(removed), take(spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
