"""Corpus pipeline: quality, near-dedup, decontamination, personal data, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes every stage's result as Parquet to the
shared folder and rereads it as the next one's docs. Stages keep the columns of
``documents``; the last returns the token digests of each text that stayed.
Every operator states what it does with nulls, empty texts, repeated rows and
empty tables; stages add nothing to that. Extra columns pass through the
filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import bpe, common, decontaminate, neardup, pii, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score at least 0.3), learnt on labelled rows of docs."""
    share, bias = quality.classifier(docs, common.table(spark, sf_dir, "labels"))
    name = common.free_name(docs, "_quality")
    return quality.score(docs, share, bias, name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group (five words, similarity 0.8)."""
    return neardup.deduplicated(docs, 80)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every text."""
    return bpe.encode_digests(docs, bpe.default_tokenizer())


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark_filter),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: The classifier, the redaction and the tokenizer cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with common.scope():
            made = stage(spark, docs, sf_dir)
            with common.apart():
                docs = common.durable(made)
        common.drop(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
