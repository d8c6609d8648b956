r"""Operator 5 [native]: chat formatting with a grammar round trip.

Template of a turn: ``<s>`` role ``[INST]`` text ``[/INST]</s>``. The control
strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``. A field (role or
text) is first tried as it is: the rendered turn is reparsed by the
deterministic parser (next control string ends the field, then one backslash is
taken from every escaped control string), and only where the recovered field
differs from the source is it escaped, which puts one backslash after the first
character of every control string, plain or already escaped. Escaping is a
bijection onto texts without control strings, so the second parse is identical.
The whole render is reparsed as well, and escaped in every field where it should
differ; ``recovered`` keeps what was parsed, ``parsed_ok`` whether it is the source.

A conversation is one output row, so its turns meet in one task; they are
aggregated as an array of small structs per conv_id, and no other key is used.
Null role or text counts as empty; null turn sorts first; rows of equal turn
are ordered by role, then text; null conv_id is a conversation of its own; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLE_OPEN, ROLE_CLOSE, TEXT_CLOSE, TURN_CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: First character, backslashes, rest of a control string.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])"
RAW = r"<s>|</s>|\[INST\]|\[/INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def parsed(rendered: Column) -> Column:
    """What the parser reads back from one field followed by a control string."""
    return unescape(F.split(rendered, RAW, 2)[0])


def settled(field: Column) -> Column:
    """The field as it goes into the template: itself where it reparses to itself, else escaped."""
    plain_ok = parsed(F.concat(field, F.lit(TEXT_CLOSE))) == field
    return F.when(plain_ok, field).otherwise(escape(field))


def format_turns(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, recovered (turns read back from
    formatted), parsed_ok, and loss_text (assistant texts under the mask, unescaped)."""
    one = rows.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "text"))).alias("turns"))
    back = whole.withColumn("first", _render(settled)).withColumn("parsed", _parse(F.col("first")))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # the whole render is reparsed too: where it differs, every field is escaped
    back = back.withColumn("agrees", F.col("parsed") == source).withColumn("formatted", F.when(F.col("agrees"), F.col("first")).otherwise(_render(escape)))
    back = back.withColumn("recovered", F.when(F.col("agrees"), F.col("parsed")).otherwise(_parse(F.col("formatted"))))
    return back.select(
        "conv_id",
        "formatted",
        "recovered",
        (F.col("recovered") == source).alias("parsed_ok"),
        F.array_join(F.transform(F.filter("recovered", lambda t: t["role"] == F.lit("assistant")), lambda t: t["text"]), "").alias("loss_text"),
    )


def _render(field) -> Column:
    """The template over the array ``turns``; ``field`` makes the text of a field."""
    turn = lambda t: F.concat(F.lit(ROLE_OPEN), field(t["role"]), F.lit(ROLE_CLOSE), field(t["text"]), F.lit(TEXT_CLOSE + TURN_CLOSE))
    return F.array_join(F.transform("turns", turn), "")


def _parse(formatted: Column) -> Column:
    """Turns read back: they end at TURN_CLOSE, roles at ROLE_CLOSE; neither is left inside a field."""
    return F.transform(
        F.filter(F.split(formatted, TURN_CLOSE), lambda t: t != F.lit("")),
        lambda t: F.struct(
            unescape(F.split(F.substr(t, F.lit(len(ROLE_OPEN) + 1)), r"\[INST\]", 2)[0]).alias("role"),
            unescape(F.split(F.split(t, r"\[INST\]", 2)[1], r"\[/INST\]", 2)[0]).alias("text"),
        ),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = format_turns(rows.unionByName(extra))
    digest = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "parsed_ok",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS erole,
         regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS etext FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + length(erole) + 6 + length(etext) + 7 + 4) AS BIGINT) AS formatted_chars,
  true AS parsed_ok
FROM e GROUP BY conv_id
"""
