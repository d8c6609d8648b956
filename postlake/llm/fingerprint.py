"""Operator 6: document fingerprints by a canonical exact digest.

The canonical form of a text is NFKC, case folded, NFKC again, with runs of
white space as one space and none at the ends; the fingerprint is the 128-bit
xxhash of its UTF-8 bytes. Rows are grouped by fingerprint, and inside a bucket
of several rows the canonical bytes of each are compared with those of the
bucket's first row, so a collision cannot merge different texts; ``group_id`` is
the smallest doc_id of a group. Likeness of two fingerprints is 1 where the
digests and the canonical bytes are equal, else 0.

The edited text of a document needs the start of the next document by
descending doc_id. Documents are dealt once into ranges of doc_id of about
``RANGE_BYTES`` of text; each range also gets a copy of the first row of the
range below, so one shuffle of the texts serves and no task sees all rows. Rows
of equal doc_id are ordered by text and stand in one range. Only rows of buckets
with several rows are read again for their bytes; a large bucket is spread.

Null text counts as empty, null doc_id comes last; a single document is its own
next; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .sharding import _bucket

#: Bytes of text in a range, and rows of a bucket beyond which it is spread over 16 keys.
RANGE_BYTES, SPREAD = 32 << 20, 1000


def canonical(text: str | None) -> bytes:
    t = text or ""
    if t.isascii():
        return " ".join(t.lower().split()).encode()
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split()).encode()


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first code points of the next document, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(rows: DataFrame, ranges: int | None = None) -> tuple[DataFrame, int]:
    """Rows (row, part, doc_id, text, ghost, key) such that within a part, sorted by key and text
    descending, each real row is followed by its next document; the last row of a part is a ghost.
    And the number of parts."""
    spark = rows.sparkSession
    rows = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    stats = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()
    cuts = sorted(set(stats["cuts"] or []))
    parts = rows.withColumn("part", _bucket(F.col("key"), cuts))
    tops = {r["part"]: r["key"] for r in parts.groupBy("part").agg(F.max("key").alias("key")).collect()}  # one row a range
    order = sorted(tops, reverse=True)
    # the top key of each range and the range that needs it as its end
    needed = {tops[p]: order[i - 1] for i, p in enumerate(order)}
    real = parts.select("row", "part", "doc_id", "text", F.lit(False).alias("ghost"), "key")
    if not needed:
        return real, 1
    goal = F.create_map(*[x for k, p in needed.items() for x in (F.lit(k).cast("long"), F.lit(p))])
    first = parts.where(F.col("key").isin(list(needed))).groupBy("key").agg(F.max("text").alias("text"))
    none = F.lit(None).cast("long")
    ghosts = first.select(none.alias("row"), F.element_at(goal, F.col("key")).alias("part"), none.alias("doc_id"), "text", F.lit(True).alias("ghost"), F.lit(-(1 << 63)).alias("key"))
    return real.unionByName(ghosts), len(cuts) + 1


def _printed(rows: DataFrame) -> DataFrame:
    """rows: (row, doc_id, text). row, doc_id, n_chars, fingerprints of the text and its edited form, likenesses."""
    dealt, parts = with_next(rows)
    ordered = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("part"), F.col("ghost"), F.col("key").desc(), F.col("text").desc()).select("part", "row", "doc_id", "text", "ghost")
    schema = "row bigint, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # part, row, doc_id, text, canonical bytes, digest
        for batch in batches:
            out: list[tuple] = []
            for part, row, doc_id, text, ghost in zip(*(batch.column(k) for k in range(5)), strict=True):
                part, text, ghost = part.as_py(), text.as_py(), ghost.as_py()
                canon = canonical(text)
                digest = xxhash.xxh3_128_hexdigest(canon)
                if held is not None and held[0] == part:
                    _, r, d, t, c, h = held
                    e = edited(t, text)
                    ec = canonical(e)
                    eh = xxhash.xxh3_128_hexdigest(ec)
                    out.append((r, d, len(t), hashlib.sha256(e.encode()).hexdigest(), h, eh, float(eh == h and ec == c), float(digest == h and canon == c)))
                held = None if ghost else (part, row.as_py(), doc_id.as_py(), text, canon, digest)
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(common.task(run), schema)


def _grouped(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(row, group_id) of the rows whose bucket has several. rows: (row, doc_id, text); prints: (row, doc_id, fingerprint)."""

    @F.pandas_udf("binary")
    def canon(text):
        return pd.Series([canonical(t) for t in text], dtype=object)

    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    bucket = prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min_by("row", order).alias("first"), F.min("doc_id").alias("name")).where("n > 1")
    shared = common.bounded(prints.select("row", "fingerprint").join(bucket, "fingerprint").select("row", "fingerprint", "first", "name", F.when(F.col("n") > SPREAD, 16).otherwise(1).alias("salts")), 72)
    texts = rows.select("row", "doc_id", "text").join(shared, "row")
    members = common.durable(texts.select("row", "doc_id", "fingerprint", "first", "name", "salts", canon("text").alias("canon")))
    firsts = members.where("row = first").select("fingerprint", F.col("canon").alias("own"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    judged = members.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).join(firsts, ["fingerprint", "salt"])
    # the first row has the bucket's smallest doc_id, so its group has that name
    same = judged.where("canon = own").select("row", F.col("name").alias("group_id"))
    # a collision of digests: the bucket's other texts are grouped by their bytes
    other = judged.where("canon <> own").select("row", "doc_id", "fingerprint", "canon")
    apart = other.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"))
    return same.unionByName(other.join(apart, ["fingerprint", "canon"]).select("row", "group_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprints of the text and its edited form, their likenesses, and group_id."""
    rows = common.keyed(docs.select("doc_id", "text"), "row")
    each = common.durable(_printed(rows))
    return _with_groups(each, _grouped(rows, each)).drop("row")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, group_id): rows whose canonical bytes are equal share the smallest
    doc_id as group_id, null where they have none."""

    @F.pandas_udf("string")
    def digest(text):
        return pd.Series([xxhash.xxh3_128_hexdigest(canonical(t)) for t in text], dtype=object)

    rows = common.keyed(docs.select("doc_id", "text"), "row")
    prints = common.durable(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("fingerprint")))
    return _with_groups(prints, _grouped(rows, prints)).select("doc_id", "fingerprint", "group_id")


def _with_groups(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """A row of no bucket of several is a group of its own."""
    known = groups.select("row", "group_id", F.lit(True).alias("_known"))
    return prints.join(known, "row", "left").withColumn("group_id", F.when(F.col("_known"), F.col("group_id")).otherwise(F.col("doc_id"))).drop("_known")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
