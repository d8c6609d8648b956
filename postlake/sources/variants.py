"""JSON documents on the JVM: parsed to VARIANT and walked by a recursive query.

Strings come depth first. An object's fields are taken in the order of their
names, which is how VARIANT holds them; an array's items by place. Texts that are
no JSON give no strings and are marked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 500


def json_strings(docs: DataFrame, key: str, json: str, longer: int = 3) -> DataFrame:
    """(key, pos, path, text): the trimmed strings of more than ``longer`` characters of the JSON text of every row, numbered
    from 1 in depth-first order. ``path`` holds the places from the root. Nesting beyond LEVELS is an error, not a loss."""
    view = f"json_{uuid.uuid4().hex}"
    docs.select(F.col(key).alias("id"), F.col(json).cast("string").alias("j")).createOrReplaceTempView(view)
    found = docs.sparkSession.sql(f"""
WITH RECURSIVE node(id, v, path) MAX RECURSION LEVEL {LEVELS} AS (
  SELECT id, try_parse_json(j), CAST(array() AS ARRAY<INT>) FROM {view}
  UNION ALL
  SELECT n.id, e.value, array_append(n.path, e.pos) FROM node n, LATERAL variant_explode(n.v) e
)
SELECT * FROM node LIMIT ALL""")
    text = F.expr("trim(CASE WHEN schema_of_variant(v) = 'STRING' THEN variant_get(v, '$', 'string') END)")
    kept = found.select("id", "path", text.alias("text")).where(F.char_length("text") > longer)
    # one document's strings are numbered together; a document is one row of the source
    place = F.row_number().over(_by("id", "path"))
    return kept.select(F.col("id").alias(key), place.cast("long").alias("pos"), "path", "text")


def _by(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def read_json_documents(docs: DataFrame, key: str, json: str, rows: int | None = None) -> DataFrame:
    """(key, text, items_extracted, success): strings joined by line ends, all or the first ``rows`` of each document."""
    s = json_strings(docs, key, json)
    shown = s if rows is None else s.where(F.col("pos") <= rows)
    text = shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    count = s.groupBy(key).agg(F.count("*").alias("items_extracted"))
    ok = docs.select(key, F.try_parse_json(F.col(json).cast("string")).isNotNull().alias("success"))
    return ok.join(text, key, "left").join(count, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("items_extracted", F.lit(0)).cast("long").alias("items_extracted"), "success")


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Events as nested documents around their props."""
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.expr("""concat('{"tags":["', event_type, '",["user ', user_id, '", null]],"props":', props, ',"note":{"b":" ', event_type, ' ","a":"x"}}')""").alias("doc"))


QUERIES = {"doc_json_strings": lambda s, d: json_strings(_nested(s, d), "event_id", "doc").select("event_id", "pos", "text")}
ORACLE = {
    "doc_json_strings": """WITH e AS (SELECT event_id, concat('{"tags":["', event_type, '",["user ', user_id, '", null]],"props":', props, ',"note":{"b":" ', event_type, ' ","a":"x"}}') AS j FROM events),
t AS (SELECT e.event_id, t.fullkey, trim(json_extract_string(e.j, t.fullkey), ' ') AS text FROM e, json_tree(e.j) t WHERE t.type = 'VARCHAR')
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY fullkey) AS pos, text FROM t WHERE length(text) > 3"""
}
