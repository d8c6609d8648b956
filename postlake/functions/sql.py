"""Functions and views for SQL text: ``register(spark)`` makes them known to a session.

Scalar functions are SQL functions, which the optimizer puts into the query;
``split_clauses`` is a table function over Python text."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

#: The same boundaries as ``text.CLAUSE``, in Python's notation.
_CLAUSE = re.compile(
    r"[.,;!?\n।|]|(?<!\w)(?:but|however|although|though|yet|while|on[ \t\n\x0b\f\r]+the[ \t\n\x0b\f\r]+other[ \t\n\x0b\f\r]+hand)(?!\w)|(?<![\wऀ-ॿ])(?:पण|परंतु|तरी|किंतु)(?![\wऀ-ॿ])"
)


@udtf
class SplitClauses:
    """split_clauses(text): (pos, clause) of the trimmed non-empty clauses of a text; no rows for null.
    split_clauses(TABLE(t)): the same for column ``text`` of a table, with its column ``post_id``."""

    def __init__(self, analyzed=None):
        self._table = analyzed is not None and getattr(analyzed, "whole", False)

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        plain = StructType().add("pos", IntegerType()).add("clause", StringType())
        if not text.isTable:
            return AnalyzeResult(plain)
        names = text.dataType.names
        if "text" not in names or "post_id" not in names:
            raise ValueError("split_clauses needs a table with columns post_id and text")
        schema = StructType().add("post_id", text.dataType["post_id"].dataType)
        for f in plain:
            schema = schema.add(f)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("post_id")])

    def eval(self, row):
        given = row if isinstance(row, str) or row is None else row["text"]
        if given is None:
            return
        head = () if isinstance(row, str) else (row["post_id"],)
        parts = (c.strip(" ") for c in _CLAUSE.split(given.lower()))
        for pos, clause in enumerate(c for c in parts if c):
            yield (*head, pos, clause)


_SCALARS = {
    "squash(t STRING) RETURNS STRING": r"trim(regexp_replace(coalesce(t, ''), '\\s+', ' '))",
    "strip_links(t STRING) RETURNS STRING": r"regexp_replace(coalesce(t, ''), 'https?://\\S+|www\\.\\S+', '')",
    "cache_key(t STRING, context STRING) RETURNS STRING": (
        r"sha2(concat(squash(regexp_replace(strip_links(lower(t)), '^rt\\s+@[a-z0-9_]+:\\s*', '')),"
        r" CASE WHEN squash(lower(context)) <> '' THEN concat('|||ctx:', squash(lower(context))) ELSE '' END), 256)"
    ),
}


def register(spark: SparkSession) -> None:
    """split_clauses, squash, strip_links and cache_key, callable from SQL of this session."""
    spark.udtf.register("split_clauses", SplitClauses)
    for head, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def view_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of Parquet tables, and ``posts``."""
    from postlake.plans.posts import posts

    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    posts(spark, sf_dir).createOrReplaceTempView("posts")


def _clauses(s: SparkSession, d: str):
    register(s)
    view_tables(s, d)
    return s.sql("SELECT p.post_id, CAST(c.pos AS BIGINT) AS pos, c.clause FROM posts p, LATERAL split_clauses(p.text) c")


def _keys(s: SparkSession, d: str):
    register(s)
    view_tables(s, d)
    return s.sql("SELECT cache_key(text, context) AS key, min(post_id) AS first_post, count(*) AS uses FROM posts GROUP BY 1")


QUERIES = {"sql_clauses": _clauses, "sql_dedup_keys": _keys}


def oracles() -> dict:
    """The SQL of the queries that give the same rows through Columns."""
    from postlake.operators import cleaning, model

    return {"sql_clauses": cleaning.ORACLE["clause_split"], "sql_dedup_keys": model.ORACLE["dedup_score_once"]}
