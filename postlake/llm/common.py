"""Shared pieces of the training-data operators: shared-folder tables and
vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# tables in the folder that all executors share


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a local master
    gets a folder of its own (tests); any other master is an error, as executors share no local folder."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="postlake-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


_SCOPES: list[list[DataFrame]] = []


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage is
    cut and a lost executor loses nothing. The path is kept on the result for ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/postlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._postlake_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Tables that ``durable`` makes inside are removed at the end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        drop(*_SCOPES.pop())


@contextmanager
def apart() -> Iterator[None]:
    """Tables made inside outlive the scope around it."""
    _SCOPES.append([])
    try:
        yield
    finally:
        _SCOPES.pop()


def drop(*frames: DataFrame) -> None:
    """Remove tables made by ``durable`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_postlake_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 8 << 20


def bounded(df: DataFrame, row_bytes: Column | int = 16) -> DataFrame:
    """A written copy of ``df``, marked for broadcast where its counted bytes are at most
    BROADCAST_BYTES; beyond that the same join shuffles."""
    made = durable(df)
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    total = made.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(made) if total <= BROADCAST_BYTES else made


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a column ``key`` (long) that is unique and never null: doc_id itself
    where it is so, else row numbers, fixed by writing the rows once."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.where("id is null").isEmpty() and ids.groupBy("id").count().where("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return durable(docs.withColumn(key, F.monotonically_increasing_id()))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# Python workers


def give_back() -> None:
    """Return unused memory to the system; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def task(run: Callable) -> Callable:
    """A mapInArrow function that leaves its worker small."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# --------------------------------------------------------------------------
# text buffers

#: Bytes of text that are worked on at once: small enough to stay in cache and to keep workers small.
CHUNK = 1 << 18
_MASK = (1 << 64) - 1


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """(first, end) runs of documents of about ``size`` bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def keys(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd uint64 numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + 17)) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return p


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; tables of a few MB are kept."""
    if n > 1 << 22:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if len(_POW.get("up", ())) < n:
        m = max(n, CHUNK + 1)
        _POW["up"], _POW["down"] = _powers(_BASE, m), _powers(_INVERSE, m)
    return _POW["up"][:n], _POW["down"][:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTERS = keys(1, 256)
FOLDED = _LETTERS.copy()
FOLDED[65:91] = _LETTERS[97:123]


class Words:
    """Words (runs of bytes other than the six ASCII spaces, or of the ``member`` bytes) of a run of documents.

    ``hash`` is a 64-bit hash of each word with A-Z folded; word i of document d
    lies in first[d] <= i < first[d + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = FOLDED, member: np.ndarray | None = None):
        n = len(data)
        word = ~SPACE[data] if member is None else member[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & ~(before & ~edge[:-1]))
        self.ends = np.flatnonzero(word & ~(after & ~edge[1:])) + 1
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(letters[data] * up[:n], out=total[1:])
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hash = mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.starts, offsets)
        self._total, self._down = total, down

    def prefix(self, size: int) -> np.ndarray:
        """Hash of each word's first ``size`` bytes; 0 where it has no more than these."""
        long = self.ends - self.starts > size
        at = self.starts[long]
        out = np.zeros(len(self.starts), np.uint64)
        with np.errstate(over="ignore"):
            out[long] = mix((self._total[at + size] - self._total[at]) * self._down[at] + np.uint64(size) * np.uint64(0xA24BAED4963EE407))
        return out


_PLACE = keys(2, 5)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles, documents in order, and where each
    document's begin. A document of 1 to size-1 words has its whole sequence as one."""
    n = len(w.hash)
    counts = np.diff(w.first)
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    with np.errstate(over="ignore"):
        if n >= size:
            acc = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                acc += w.hash[k : n - size + 1 + k] * _PLACE[k]
            acc = mix(acc)
        else:
            acc = np.zeros(0, np.uint64)
        where = np.repeat(w.first[:-1] - begin[:-1], out_counts) + np.arange(begin[-1])
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(acc):
            out = acc[np.minimum(where, len(acc) - 1)]
        else:
            out = np.zeros(int(begin[-1]), np.uint64)
        for d in short:
            v = np.uint64(int(counts[d]) * 0x51ED270B)
            for k in range(counts[d]):
                v = v + w.hash[w.first[d] + k] * _PLACE[k]
            out[begin[d]] = mix(np.array([v], np.uint64))[0]
    return out, begin
