"""Operator 4: quality classifier with supervised subword embeddings.

Each text becomes a bag of hashed features: words, word pairs (a word followed
by itself shares one feature), and the 3- and 4-grams of characters inside words
with the space on either side. Features look up learned vectors, a document is their average, and a softmax over two classes gives the
score. Vectors and output weights are fitted together by stochastic gradient
descent in numpy, on at most ``max_rows`` labelled rows (the documented bound;
lowest hash of doc_id first), which alone reach the driver. As the score is
linear in the average vector, each feature's share of the logit is one number,
so the fitted model that is broadcast is one float32 per bucket (256 KB, fixed).

Every row is scored over its whole text. Null and empty texts get the score of
the bias alone; without labels of both classes the score is the share of label 1
among them (0.5 without any); null labels are left out; a doc_id with several
labels takes the smallest; repeated rows are scored alike; an empty table gives
no rows. Only doc_id and text are read; a column that has the score's name is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 16
DIM = 8
EPOCHS = 4
RATE = 0.6
MAX_ROWS = 2500
THRESHOLD = 0.3
_SHIFT = np.uint64(64 - BITS)
_G3, _G4, _PAIR, _SAME = common.keys(11, 4)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a run of documents, and the document of each."""
    buckets, owner = [], []
    with np.errstate(over="ignore"):
        # characters: code points, and where each document's begin; bytes that are no UTF-8 stand for themselves
        try:
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            first = lead[offsets]
        except UnicodeDecodeError:
            chars, first = data.astype(np.uint32), offsets
        n = len(chars)
        doc_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
        space = common.SPACE[np.minimum(chars, 255)] & (chars < 128)
        c = np.where(space, np.uint32(32), chars).astype(np.uint64)
        for size, key in ((3, _G3), (4, _G4)):
            if n >= size:
                g = c[: n - size + 1].copy()
                for k in range(1, size):
                    g = (g << np.uint64(21)) ^ (g >> np.uint64(43)) ^ c[k : n - size + 1 + k]
                inside = doc_of[: n - size + 1] == doc_of[size - 1 :]
                for k in range(1, size - 1):
                    inside &= ~space[k : n - size + 1 + k]
                buckets.append((common.mix((g + np.uint64(size)) * key) >> _SHIFT)[inside])
                owner.append(doc_of[: n - size + 1][inside])
        w = common.Words(data, offsets, common._LETTERS)
        word_doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(w.first))
        buckets.append(w.hash >> _SHIFT)
        owner.append(word_doc)
        if len(w.hash) > 1:
            a, b = w.hash[:-1], w.hash[1:]
            pair = np.where(a == b, _SAME, (a * _PAIR) ^ b)
            inside = word_doc[:-1] == word_doc[1:]
            buckets.append((common.mix(pair) >> _SHIFT)[inside])
            owner.append(word_doc[:-1][inside])
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owner)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit of label 1, and the bias."""
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        p = float(y.mean()) if len(y) else 0.5
        return np.zeros(1 << BITS, np.float32), math.log(max(p, 1e-3) / max(1 - p, 1e-3))
    rows = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        b, _ = features(raw, np.array([0, len(raw)]))
        idx, cnt = np.unique(b, return_counts=True)
        rows.append((idx, (cnt / max(1, cnt.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    out[:, 0] = rng.uniform(-0.5, 0.5, DIM)
    out[:, 1] = -out[:, 0]
    bias = np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            rate = RATE * (1 - steps / total)
            steps += 1
            idx, x = rows[i]
            if not len(idx):
                continue
            hidden = x @ vectors[idx]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1.0
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            vectors[idx] -= np.outer(x * (rate / float(x @ x)), back)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, column: str, may_learn: Column, max_rows: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_rows`` rows, chosen by hash of doc_id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("_label"))
        .where(F.col("_label").isNotNull() & F.col("doc_id").isNotNull())
        .where(may_learn)
        .groupBy("doc_id")
        .agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "_label").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return [t or "" for t in rows["text"].where(rows["text"].notna(), "")], [int(x) for x in rows["_label"]]


def remainder(doc_id: Column, m: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(m))


def score(docs: DataFrame, share: np.ndarray, bias: float, name: str = "score") -> DataFrame:
    """The columns of ``docs`` and the score of every whole text; no shuffle. An older column of that name goes."""
    spark, docs = docs.sparkSession, docs.drop(name)
    model = spark.sparkContext.broadcast((share.astype(np.float32), bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, b0 = model.value
        for batch in batches:
            data, offsets = common.buffers(batch.column(at))
            z = np.empty(len(offsets) - 1)
            for i, j in common.chunks(offsets):
                o = offsets[i : j + 1] - offsets[i]
                f, owner = features(data[offsets[i] : offsets[j]], o)
                n = np.bincount(owner, minlength=j - i)
                z[i:j] = np.bincount(owner, weights=v[f], minlength=j - i) / np.maximum(n, 1) + b0
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(common.task(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    texts, y = training_rows(docs, labels, "quality", remainder(F.col("doc_id"), 5) != 0, max_rows)
    return fit(texts, y)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share, bias = classifier(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, share, bias).select(
        "doc_id",
        (remainder(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
