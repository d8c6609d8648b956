"""Places of dictionary terms in texts: one pass of an automaton, or a shuffled join for a dictionary of any size.

A term stands where its lower-case characters are in the lower-case text with no
word character (letter, digit, underscore) directly before or after. ``kept``
marks a set without overlaps: from the left, and of equal starts the longest.
Null texts and null or empty terms give nothing; repeated terms count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

QUERIES: dict = {}
ORACLE: dict = {}

_TOKEN = re.compile(r"\w+|\W")
_SPARK_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
#: Rows of one outgoing batch.
_ROWS = 20_000


def _word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def _alone(text: str, start: int, end: int) -> bool:
    return not _word(text, start - 1) and not _word(text, end)


class _Rows:
    """Collects (row of the batch, term, start, end, kept) and gives them out as Arrow batches beside their keys."""

    def __init__(self, keys: pa.Array, names: list[str]):
        self.keys, self.names, self.rows = keys, names, []

    def take(self) -> pa.RecordBatch:
        at, *rest = zip(*self.rows, strict=True)
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        self.rows = []
        return pa.RecordBatch.from_arrays([self.keys.take(pa.array(at))] + [pa.array(c, t) for c, t in zip(rest, types, strict=False)], names=self.names[: len(rest) + 1])


def _schema(df: DataFrame, key: str, kept: bool) -> StructType:
    found = [StructField(key, df.schema[key].dataType), StructField("term", StringType()), StructField("start", LongType()), StructField("end", LongType())]
    return StructType(found + [StructField("kept", BooleanType())] * kept)


def terms_of(dictionary: DataFrame, term: str = "term") -> DataFrame:
    """The distinct lower-case terms."""
    return dictionary.select(F.lower(F.col(term).cast("string")).alias("term")).where("term <> ''").distinct()


def hits(df: DataFrame, key: str, text: str, dictionary: DataFrame, term: str = "term", bound: int = 1_000_000) -> DataFrame:
    """Rows (key, term, start, end, kept), one for each place; places count code points of the lower-case text.

    The dictionary's characters are counted first. Up to ``bound`` its terms are broadcast and every task passes
    its texts through one automaton, in time that follows the text and its hits and not the number of terms;
    nothing is shuffled. A larger dictionary is joined by ``hits_by_join`` instead. ``key`` names each row once."""
    terms = terms_of(dictionary, term)
    size = terms.agg(F.sum(F.char_length("term"))).first()[0] or 0
    return hits_by_automaton(df, key, text, terms) if size <= bound else hits_by_join(df, key, text, terms)


def hits_by_automaton(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``hits`` for distinct lower-case terms that fit into one task."""
    schema = _schema(df, key, True)
    known = df.sparkSession.sparkContext.broadcast(sorted(r.term for r in terms.toLocalIterator()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in known.value:
            machine.add_word(t, t)
        if not len(machine):
            return
        machine.make_automaton()
        for b in batches:
            out = _Rows(b.column(0), schema.names)
            for row, low in enumerate(b.column(1).to_pylist()):
                if not low:
                    continue
                places = []
                for last, t in machine.iter(low):
                    if _alone(low, last + 1 - len(t), last + 1):
                        places.append((last + 1 - len(t), -last - 1, t))
                done = 0
                for start, end, t in sorted(places):
                    out.rows.append((row, t, start, -end, start >= done))
                    done = max(done, -end) if start >= done else done
                    if len(out.rows) >= _ROWS:
                        yield out.take()
            if out.rows:
                yield out.take()

    return df.select(key, F.lower(F.col(text)).alias("_low")).mapInArrow(run, schema)


def hits_by_join(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``hits`` for distinct lower-case terms of any number: a term that stands alone covers whole tokens (word runs,
    single other characters), so every run of as many tokens as some term has is a candidate, and candidates meet
    terms in a shuffled join. The hits of a key are then swept in order, one at a time, within sorted partitions."""
    widths = sorted(r.n for r in terms.select(F.size(F.regexp_extract_all("term", F.lit(_SPARK_TOKEN), 0)).alias("n")).distinct().collect())  # one row a token count
    plain, swept = _schema(df, key, False), _schema(df, key, True)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Rows(b.column(0), plain.names)
            for row, low in enumerate(b.column(1).to_pylist()):
                ends = [m.end() for m in _TOKEN.finditer(low or "")]
                for i, start in enumerate([0, *ends[:-1]] if ends else []):
                    for n in widths:
                        if i + n > len(ends):
                            break
                        end = ends[i + n - 1]
                        if _alone(low, start, end):
                            out.rows.append((row, low[start:end], start, end))
                    if len(out.rows) >= _ROWS:
                        yield out.take()
            if out.rows:
                yield out.take()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = object(), 0
        for b in batches:
            keep = []
            for k, start, end in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != now:
                    now, done = k, 0
                keep.append(start >= done)
                done = max(done, end) if start >= done else done
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keep, pa.bool_())], names=swept.names)

    places = df.select(key, F.lower(F.col(text)).alias("_low")).mapInArrow(candidates, plain)
    met = places.join(terms, "term", "left_semi").select(*plain.names)
    return met.repartition(F.col(key)).sortWithinPartitions(F.col(key), "start", F.desc("end")).mapInArrow(sweep, swept)


def word_pairs(df: DataFrame, text: str) -> DataFrame:
    """The distinct lower-case pairs of words with one space between, as a dictionary."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(_SPARK_TOKEN), 0)
    three = F.transform(F.sequence(F.lit(1), F.size("_t") - 2), lambda i: F.slice("_t", i, 3))
    pairs = df.select(tokens.alias("_t")).where(F.size("_t") >= 3).select(F.explode(three).alias("x")).where(F.col("x")[1] == " ")
    return pairs.where(F.col("x")[0].rlike(r"^[\p{L}\p{N}_]") & F.col("x")[2].rlike(r"^[\p{L}\p{N}_]")).select(F.array_join("x", "").alias("term")).distinct()


def dictionary_hits(s: SparkSession, d: str) -> DataFrame:
    """Every document that holds word pairs of the benchmark: their places, the different pairs, and the places without overlaps."""
    docs, items = s.read.parquet(f"{d}/documents.parquet"), s.read.parquet(f"{d}/benchmark.parquet")
    found = hits(docs, "doc_id", "text", word_pairs(items, "text"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.count_distinct("term").alias("n_terms"), F.count_if("kept").alias("n_spans"), F.sum(F.when(F.col("kept"), F.col("end") - F.col("start")).otherwise(0)).alias("n_covered"))


QUERIES["dictionary_hits"] = dictionary_hits
# two pairs overlap only where one's second word is the other's first, so of a run of such pairs every second one is kept
_RUNS = r"""SELECT {key}, i, t[i] || t[i + 1] || t[i + 2] AS term FROM (SELECT {key}, t, unnest(range(1, len(t) - 1)) AS i
FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]') AS t FROM {table}) WHERE len(t) >= 3)
WHERE t[i + 1] = ' ' AND regexp_matches(t[i], '^[\p{{L}}\p{{N}}_]') AND regexp_matches(t[i + 2], '^[\p{{L}}\p{{N}}_]')"""
ORACLE["dictionary_hits"] = f"""WITH dict AS (SELECT DISTINCT term FROM ({_RUNS.format(key="item_id", table="benchmark")})),
h AS (SELECT doc_id, i, term FROM ({_RUNS.format(key="doc_id", table="documents")}) JOIN dict USING (term)),
r AS (SELECT doc_id, i, term, i - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) % 2 = 1 AS kept FROM r)
SELECT doc_id, count(*) AS n_hits, count(DISTINCT term) AS n_terms, count(*) FILTER (WHERE kept) AS n_spans,
CAST(sum(CASE WHEN kept THEN length(term) ELSE 0 END) AS BIGINT) AS n_covered FROM k GROUP BY doc_id"""
