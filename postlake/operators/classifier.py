"""Softmax classifier over TF-IDF vectors: fitted by Spark ML, kept as one small table, applied without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from postlake.functions import text as X
from postlake.operators import model as M
from postlake.operators import vectors as V
from postlake.operators.vectors import features_of  # noqa: F401
from postlake.plans.cut import cut

QUERIES: dict = {}
ORACLE: dict = {}


@dataclass(frozen=True)
class SoftmaxModel:
    """Classes in order, and per token its idf and one weight a class. At most max_features tokens, so
    the model is of bounded size and travels with the tasks."""

    classes: tuple[str, ...]
    tokens: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """One gzip Parquet table: idf at 4 places, weights at 5, those up to 1e-4 as zero. Tokens without weight
        stay, they count in a vector's length. The first row, with a null token, holds the classes and the bias."""
        w = np.where(np.abs(self.weights) > 1e-4, np.round(self.weights, 5), 0.0)
        rows = [(None, json.dumps(self.classes), 0.0, self.bias.tolist())] + [(t, None, round(float(i), 4), x) for t, i, x in zip(self.tokens, self.idf, w.tolist(), strict=True)]
        spark.createDataFrame(rows, "token string, classes string, idf double, weights array<double>").coalesce(1).write.option("compression", "gzip").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> SoftmaxModel:
    rows = spark.read.parquet(path).collect()  # as bounded as the model
    head = next(r for r in rows if r.token is None)
    rest = sorted((r for r in rows if r.token is not None), key=lambda r: r.token)
    k = len(head.weights)
    return SoftmaxModel(tuple(json.loads(head.classes)), tuple(r.token for r in rest), np.array([r.idf for r in rest]), np.array([r.weights for r in rest]).reshape(-1, k), np.array(head.weights))


def fit(docs: DataFrame, label: str = "label", max_features: int = 40000, balanced: bool = False, reg: float = 1e-4, steps: int = 50) -> SoftmaxModel:
    """A model of the rows of ``docs`` (doc_id, text, label). doc_id is unique; rows whose doc_id or label is null
    and texts without a known token are left out. With ``balanced`` every class weighs the same in all.

    The driver holds the vocabulary and the weights, both of at most max_features rows; vectors stay in Spark."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    known = docs.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col(label).cast("string").alias("_label"))
    # equal texts of one label are one row that counts as often
    x = cut(known.groupBy("text", "_label").agg(F.count("*").alias("_times")))
    counts = {r["_label"]: r["n"] for r in x.groupBy("_label").agg(F.sum("_times").alias("n")).collect()}  # one row a class
    classes = tuple(sorted(counts))
    voc, at = M.numbered_vocabulary(M.vocabulary(x, max_features, "_times"))
    tokens, idf = tuple(r.token for r in voc), np.array([r.idf for r in voc], dtype=float)
    if len(classes) < 2 or not tokens:
        return SoftmaxModel(classes, tokens, idf, np.zeros((len(tokens), len(classes))), np.zeros(len(classes)))
    n, total = len(tokens), sum(counts.values())
    number = {k: float(i) for i, k in enumerate(classes)}
    share = {k: total / (len(classes) * counts[k]) if balanced else 1.0 for k in classes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in V.chunks(b):
                text, token, tf = V.cells(c.column(0), at)
                w = V.weights(text, token, tf, idf, c.num_rows)
                seen, first = np.unique(text, return_index=True)
                ends = pa.array(np.append(first, len(text)), pa.int32())
                names, times = c.column(1).take(pa.array(seen)).to_pylist(), c.column(2).to_numpy()[seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number[k] for k in names], pa.float64()), pa.array(np.array([share[k] for k in names], float) * times), pa.ListArray.from_arrays(ends, pa.array(token, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))],
                    names=["label", "share", "at", "weight"],
                )

    sparse = F.udf(lambda at, weight: Vectors.sparse(n, at, weight), VectorUDT())
    vectors = x.select(X.model_tokens(F.col("text")).alias("words"), "_label", "_times").mapInArrow(run, "label double, share double, at array<int>, weight array<double>")
    rows = vectors.select("label", "share", sparse("at", "weight").alias("features"))
    lr = LogisticRegression(family="multinomial", weightCol="share", regParam=reg, maxIter=steps, standardization=False).fit(rows)
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    short = len(classes) - len(b)  # a class that has no known token at all is not seen by the fit
    return SoftmaxModel(classes, tokens, idf, np.vstack([w, np.zeros((short, n))]).T, np.concatenate([b, np.full(short, -20.0)]))


def scorer(model: SoftmaxModel):
    """A function from the words of many texts to one row of probabilities a text, in the model's class order; a
    text without known tokens has those of the bias. Per call one sparse product over all texts; a word's own
    features are looked up once a call."""
    at = pa.array(model.tokens, pa.string())

    def many(texts: pa.ListArray) -> np.ndarray:
        text, token, tf = V.cells(texts, at)
        v = V.weights(text, token, tf, model.idf, len(texts))
        z = np.tile(np.asarray(model.bias, float), (len(texts), 1))
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(text, v * model.weights[token, k], len(texts))
        e = np.exp(np.clip(z - z.max(axis=1, keepdims=True), -20, 20))
        return e / e.sum(axis=1, keepdims=True)

    return many


def probabilities(text: Column, model: SoftmaxModel) -> Column:
    many = scorer(model)

    @F.pandas_udf("array<double>")
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(list(many(pa.array([w.tolist() for w in words], pa.list_(pa.string())))), dtype=object)

    return run(X.model_tokens(F.coalesce(text, F.lit(""))))


def with_base(df: DataFrame, text: str, model: SoftmaxModel, labels) -> DataFrame:
    """``df`` with base_label (the first of equals in class order), base_conf and one base_p column a label; a
    label that the model does not know has probability 0. Columns of these names are replaced.

    Probabilities are added to whole Arrow batches: the steps before and after stay two plans of moderate
    size, where one expression over both costs the optimizer minutes."""
    many = scorer(model)
    x = df.withColumn("_p", X.model_tokens(F.coalesce(F.col(text), F.lit(""))))
    at = x.columns.index("_p")
    schema = StructType([f if k != at else StructField("_p", ArrayType(DoubleType())) for k, f in enumerate(x.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = many(b.column(at))
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([p if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    x = x.mapInArrow(run, schema)
    x = x.withColumn("base_conf", F.array_max("_p")).withColumn("base_label", F.get(F.array(*map(F.lit, model.classes)), F.array_position("_p", F.col("base_conf")).cast("int") - 1))
    for k in labels:
        x = x.withColumn(f"base_p_{k}", F.get("_p", F.lit(model.classes.index(k))) if k in model.classes else F.lit(0.0))
    return x.drop("_p")


def fold_mixed(final: Column, base: Column) -> Column:
    """``mixed`` falls back to the base label where only the model's classes count."""
    return F.when(final == "mixed", base).otherwise(final)


def held_out_metrics(docs: DataFrame, label: str, share: int = 5, **options) -> DataFrame:
    """Accuracy per class and in all (class null) on the rows whose crc32(doc_id) mod ``share`` is 0, fitted on the others."""
    out = F.crc32(F.col("doc_id").cast("string")) % share == 0
    model = fit(docs.where(~out), label, **options)
    seen = docs.where(out & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("class"), "text")
    told = with_base(seen, "text", model, ())
    return told.rollup("class").agg(F.count("*").alias("n"), F.avg((F.col("base_label") == F.col("class")).cast("int")).alias("accuracy"))


def train_metrics(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return held_out_metrics(docs, "quality")


QUERIES["train_metrics"] = train_metrics
