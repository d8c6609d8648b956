"""Operator 13: vector codes from product codebooks fitted by heap-ordered Lloyd rounds.

A vector's components become integers floor(4096 * x); it is cut into 8 equal
consecutive parts, and each part position has a codebook of 16 entries. A round
assigns every part to the nearest entry of its codebook (squared Euclidean
distance, ties to the lower index) and moves each entry to the floor of its
parts' mean.

Vectors lie in blocks of at most ``BLOCK``, each with its own state: the entry
of every part, exact sums and counts of each entry, and one heap per codebook
entry. A heap holds the entry's parts by slack, the distance to the second
nearest entry less that to the nearest at the last exact scan, plus the drift the
entry had gathered by then. Each round adds to every entry's drift its own move
and the largest move of another entry; a part can have a new nearest entry only
if its key is at most that drift. So a round goes down each heap from its root
while keys are violated, scans those parts exactly, and leaves the others
unread. Bounds are floating point and carry a margin; whatever they do not rule
out is scanned in integers, so assignments equal those of the plain method.

Blocks are rows of a table in the shared folder: a round reads it, writes the
next one, and sums the blocks' totals by task and then by cell; only codebooks
(a fixed number of integers) reach the driver. No vector is shuffled.

Rows whose vector is null or holds null, NaN or infinite components are dropped,
and so are vectors whose length is not a positive multiple of 8 or differs from
that of the smallest kept vec_id. Rows without vec_id count, their id stays
null and is taken last as a starting entry; rows of one vec_id are ordered by
their vector. With fewer than 16 rows there are as many entries. Components of
any finite size are worked on exactly; an error beyond the long range is given as
its largest value. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block, and the largest component that plain 64-bit arithmetic takes (with up to 1024 dimensions a part).
BLOCK, PLAIN = 2048, 1 << 25
MOST = (1 << 63) - 1
_LIMBS = 6


def quantised(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as int64, or as Python integers where they are large."""
    x = np.floor(rows.astype(np.float64) * SCALE)
    if x.size and np.abs(x).max() > PLAIN:
        return np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def scan(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), its squared distance, and the distances to the nearest and the second nearest entry."""
    if values.dtype != object and book.dtype == object:
        values = values.astype(object)
    gap = values[:, None, :] - book[None, :, :]
    square = (gap * gap).sum(-1)
    best = np.asarray(square.argmin(1), np.int64) if len(values) else np.zeros(0, np.int64)
    at = np.arange(len(values))
    near = square[at, best]
    if book.shape[0] == 1:
        return best, near, np.sqrt(near.astype(np.float64)), np.full(len(values), np.inf)
    rest = square.astype(np.float64)
    rest[at, best] = np.inf
    return best, near, np.sqrt(near.astype(np.float64)), np.sqrt(rest.min(1))


def violated(keys: np.ndarray, drift: float, margin: float) -> np.ndarray:
    """Places of a binary heap whose key is at most ``drift``; only these and their children are visited."""
    found = []
    level = np.zeros(min(1, len(keys)), np.int64)
    while len(level):
        bad = level[~(keys[level] > drift + margin)]
        found.append(bad)
        level = np.concatenate([2 * bad + 1, 2 * bad + 2])
        level = level[level < len(keys)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class Block:
    """Values (vectors, parts, width), entry of each part, totals of the entries, and a heap (keys, members) per part and entry."""

    def __init__(self, values: np.ndarray, entries: int):
        self.values, self.entries = values, entries
        self.at = np.full((PARTS, len(values)), -1, np.int16)
        self.sums = np.zeros((PARTS, entries, values.shape[2]), values.dtype)
        self.counts = np.zeros((PARTS, entries), np.int64)
        self.heaps = [[(np.zeros(0), np.zeros(0, np.int32)) for _ in range(entries)] for _ in range(PARTS)]
        self.scanned = 0

    def assign(self, books: np.ndarray, drift: np.ndarray) -> None:
        """Bring every part to its nearest entry of ``books`` (parts, entries, width)."""
        self.scanned = 0
        for p in range(PARTS):
            heaps, old = self.heaps[p], self.at[p]
            first = bool(len(old)) and old[0] < 0
            moved = [np.arange(len(old), dtype=np.int32)] if first else []
            cut = []
            for e, (keys, members) in enumerate(heaps):
                places = violated(keys, drift[p, e], margin(keys, drift[p, e]))
                cut.append(places)
                if len(places):
                    moved.append(members[places])
            todo = np.concatenate(moved) if moved else np.zeros(0, np.int32)
            if not len(todo):
                continue
            self.scanned += len(todo)
            values = self.values[todo, p]
            best, _, near, second = scan(values, books[p])
            gap = second - near
            before = old[todo]
            for e in range(self.entries):
                left, come = (before == e) & (best != e), (best == e) & (before != e)
                for chosen, sign in ((left, -1), (come, 1)):
                    if chosen.any():
                        self.sums[p, e] += sign * values[chosen].sum(0)
                        self.counts[p, e] += sign * int(chosen.sum())
                push = best == e
                if len(cut[e]) or push.any():
                    stay = np.ones(len(heaps[e][0]), bool)
                    stay[cut[e]] = False
                    keys = np.concatenate([heaps[e][0][stay], gap[push] + drift[p, e]])
                    members = np.concatenate([heaps[e][1][stay], todo[push].astype(np.int32)])
                    order = np.argsort(keys, kind="stable")  # an ascending array is a heap
                    heaps[e] = keys[order], members[order]
            old[todo] = best

    def totals(self) -> np.ndarray:
        """Counts and sums of all entries, one row of 1 + width cells each."""
        return np.concatenate([self.counts[:, :, None].astype(self.sums.dtype), self.sums], axis=2).reshape(-1)

    def packed(self) -> bytes:
        sizes = np.array([[len(k) for k, _ in row] for row in self.heaps], np.int32)
        keys = np.concatenate([k for row in self.heaps for k, _ in row])
        members = np.concatenate([m for row in self.heaps for _, m in row])
        out = io.BytesIO()
        np.savez(out, at=self.at, counts=self.counts, sizes=sizes, keys=keys, members=members, **whole("values", self.values), **whole("sums", self.sums))
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Block:
        z = np.load(io.BytesIO(raw), allow_pickle=False)
        b = cls.__new__(cls)
        b.at, b.counts, b.values, b.sums = z["at"].copy(), z["counts"].copy(), read(z, "values"), read(z, "sums")
        b.entries = b.counts.shape[1]
        ends = np.cumsum(z["sizes"].reshape(-1))
        keys, members = np.split(z["keys"], ends[:-1]), np.split(z["members"], ends[:-1])
        b.heaps = [[(keys[p * b.entries + e], members[p * b.entries + e]) for e in range(b.entries)] for p in range(PARTS)]
        b.scanned = 0
        return b


def margin(keys: np.ndarray, drift: float) -> float:
    """More than the rounding of the distances, keys and drifts that are compared."""
    top = float(keys[np.isfinite(keys)].max(initial=0.0)) if len(keys) else 0.0
    return 1e-9 * (1.0 + abs(drift) + top) + 1e-6


def whole(name: str, a: np.ndarray) -> dict:
    """Arrays that hold ``a`` without pickling; large integers as decimal strings."""
    if a.dtype == object:
        return {f"{name}_text": np.array([str(v) for v in a.reshape(-1)] or [""]), f"{name}_shape": np.array(a.shape)}
    return {name: a.astype(np.int32) if a.size and np.abs(a).max() < 1 << 31 else a}


def read(z, name: str) -> np.ndarray:
    if name in z:
        return z[name].astype(np.int64)
    shape = tuple(z[f"{name}_shape"])
    return np.array([int(v) for v in z[f"{name}_text"][: int(np.prod(shape))]], dtype=object).reshape(shape)


# --------------------------------------------------------------------------
# the Spark job


def kept(rows: DataFrame, width: int | None = None) -> DataFrame:
    """vec_id, label and vector of the rows that count."""
    cols = {c.lower() for c in rows.columns}
    label = F.col("label") if "label" in cols else F.lit(None).cast("int").alias("label")
    out = rows.select("vec_id", label, F.col("embedding").cast("array<double>").alias("v"))
    out = out.where("v is not null and size(v) > 0 and size(v) % 8 = 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    return out if width is None else out.where(F.size("v") == width)


def _blocks(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks after the first assignment."""
    entries, width = books.shape[1], books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                b = Block(quantised(flat.reshape(part.num_rows, -1)).reshape(part.num_rows, PARTS, width), entries)
                b.assign(books, np.zeros((PARTS, entries)))
                keep = pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["vec_id", "label"])
                yield state(ipc(keep), b)

    return rows.select("vec_id", "label", "v").mapInArrow(common.task(run), STATE)


STATE = "rows binary, block binary, totals binary, scanned bigint"


def state(rows: bytes, b: Block) -> pa.RecordBatch:
    totals = "\n".join(map(str, b.totals().tolist())).encode()
    return pa.RecordBatch.from_arrays([pa.array([rows], pa.binary()), pa.array([b.packed()], pa.binary()), pa.array([totals], pa.binary()), pa.array([b.scanned], pa.int64())], names=["rows", "block", "totals", "scanned"])


def ipc(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _next(blocks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw in zip(batch.column(0), batch.column(1), strict=True):
                b = Block.unpacked(raw.as_py())
                b.assign(books, drift)
                yield state(rows.as_py(), b)

    return blocks.select("rows", "block").mapInArrow(common.task(run), STATE)


def _totals(blocks: DataFrame, cells: int) -> list[int]:
    """Exact sums of all blocks' totals: one row of limbs a task and cell, then summed by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * cells
        for batch in batches:
            for raw in batch.column(0):
                total = [x + int(y) for x, y in zip(total, raw.as_py().split(b"\n"), strict=True)]
        limbs = [[(v >> 32 * i) & 0xFFFFFFFF if i < _LIMBS - 1 else v >> 32 * i for v in total] for i in range(_LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(cells), pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]], names=["cell", *[f"x{i}" for i in range(_LIMBS)]])

    each = blocks.select("totals").mapInArrow(common.task(run), "cell int, " + ", ".join(f"x{i} bigint" for i in range(_LIMBS)))
    got = {r[0]: sum(int(r[i + 1]) << 32 * i for i in range(_LIMBS)) for r in each.groupBy("cell").agg(*[F.sum(f"x{i}") for i in range(_LIMBS)]).collect()}
    return [got.get(i, 0) for i in range(cells)]


def moved(books: np.ndarray, totals: list[int]) -> np.ndarray:
    """Entries at the floor of their parts' mean; entries without parts stay."""
    parts, entries, width = books.shape
    t = np.array(totals, dtype=object).reshape(parts, entries, 1 + width)
    out = books.astype(object)
    for p in range(parts):
        for e in range(entries):
            if t[p, e, 0]:
                out[p, e] = [int(s) // int(t[p, e, 0]) for s in t[p, e, 1:]]
    return narrow(out)


def narrow(a: np.ndarray) -> np.ndarray:
    return a if a.size and max(abs(int(v)) for v in a.reshape(-1)) > PLAIN else a.astype(np.int64)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry its own move and the largest move of another entry of its codebook."""
    gap = new.astype(object) - old.astype(object)
    move = np.sqrt((gap * gap).sum(-1).astype(np.float64)) * (1 + 1e-12)
    if move.shape[1] == 1:
        return move
    order = np.sort(move, axis=1)
    first, second = order[:, -1:], order[:, -2:-1]
    other = np.where(move == first, np.where((move == first).sum(1, keepdims=True) > 1, first, second), first)
    return move + other


def fit(rows: DataFrame) -> tuple[np.ndarray, DataFrame] | None:
    """Codebooks after all rounds, and the blocks assigned to them; None without rows. rows: vec_id, label, v."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    head = rows.orderBy(*order).limit(1).select("vec_id", F.size("v").alias("n")).collect()
    if not head:
        return None
    rows = rows.where(F.size("v") == head[0]["n"])
    seeds = [r["v"] for r in rows.orderBy(*order).limit(ENTRIES).select("v").collect()]
    width = head[0]["n"] // PARTS
    start = quantised(np.array(seeds)).reshape(len(seeds), PARTS, width)
    books = narrow(np.ascontiguousarray(start.transpose(1, 0, 2)))
    drift = np.zeros(books.shape[:2])
    blocks = common.durable(_blocks(rows, books))
    for _ in range(ROUNDS):
        new = moved(books, _totals(blocks, PARTS * len(seeds) * (1 + width)))
        drift = drift + drifts(books, new)
        books = new
        later = common.durable(_next(blocks, books, drift))
        common.drop(blocks)
        blocks = later
    return books, blocks


def coded(blocks: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    """vec_id, label, code, error of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw in zip(batch.column(0), batch.column(1), strict=True):
                b = Block.unpacked(raw.as_py())
                keep = pa.ipc.open_stream(rows.as_py()).read_all().combine_chunks()
                error = np.zeros(len(b.values), object)
                for p in range(PARTS):
                    gap = b.values[:, p].astype(object if books.dtype == object else b.values.dtype) - books[p][b.at[p]]
                    error = error + (gap * gap).sum(1)
                codes = ["".join(f"{x:02x}" for x in col) for col in b.at.T.tolist()]
                error = pa.array([min(int(x), MOST) for x in error], pa.int64())
                yield from pa.table([keep.column(0), keep.column(1), pa.array(codes, pa.string()), error], names=["vec_id", "label", "code", "error"]).to_batches()

    return blocks.select("rows", "block").mapInArrow(common.task(run), f"vec_id {id_type}, label {label_type}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that counts."""
    rows = kept(rows)
    types = dict(rows.dtypes)
    got = fit(rows)
    if got is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    books, blocks = got
    out = common.durable(coded(blocks, books, types["vec_id"], types["label"]))
    common.drop(blocks)
    # sums of a third of all rows under one label: added up in each task first; few labels are broadcast
    by = common.bounded(out.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")), 24)
    return out.join(by, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


# --------------------------------------------------------------------------
# DuckDB SQL: the plain method, every part against every entry in every round


def _sql() -> str:
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        "part AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS v FROM kept, range(8) t(p))",
        "seed AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept QUALIFY e < 16)",
        "book0 AS MATERIALIZED (SELECT p, e, v AS w FROM part JOIN seed USING (vec_id))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"near{i} AS MATERIALIZED (SELECT vec_id, label, p, v, min(d) AS d, min_by(e, d * 16 + e) AS e FROM"
            f" (SELECT vec_id, label, p, v, e, CAST(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM part JOIN book{i} USING (p)) GROUP BY vec_id, label, p, v)"
        )
        if i < ROUNDS:
            steps.append(
                f"mean{i} AS MATERIALIZED (SELECT p, e, list(m ORDER BY k) AS w FROM (SELECT p, e, k,"
                f" CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS k FROM near{i}) GROUP BY p, e, k) GROUP BY p, e)"
            )
            steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{i} b LEFT JOIN mean{i} m USING (p, e))")
    last = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f""",
        sha AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last}),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, sha"""
    )


ORACLE = _sql()
