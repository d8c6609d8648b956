"""Operator 11: phrase collocations by language.

Texts, A-Z lower-cased, are cut into pieces at ``.,;:!?`` and line ends, pieces into
words at spaces and tabs. Equal pieces of a language become one with a
multiplicity, so copied passages are counted once with a weight. The distinct
pieces lie in packs of a few MB in the shared folder.

Counting goes in two rounds of messages between packs and hash buckets. A pack
sends the distinct keys of its words and word pairs with their weighted counts,
each to the bucket of its second hash; a bucket adds them up out of core in
duckdb and answers every pack with those of its keys that occur ``LEAST`` times or
more, and names one pack of each as its owner. A longer phrase can be that
frequent only if all its pairs are, so in the second round packs send phrases of
3 to 5 words made of frequent pairs alone. Owners then write the frequent
phrases as text. A word or phrase in a third of all documents is one item a
pack, whatever its copies.

Cuts are scored by lookups: every cut of a candidate asks for the counts of its
two parts, and requests and counts meet by (lang, part) in a shuffle. Both parts
of a frequent phrase are frequent, so no request stays open. Scores are decimals
of 38 digits, exact while 1000 * a * n and l * r have no more. A candidate whose
count a longer one reaches is dropped; as all phrases inside a candidate are
candidates, it is enough to look one word further.

Null text counts as empty, a null lang as ``und``. A text or table without words gives no
rows. Rows count by number, whether or not their doc_ids repeat or are null;
doc_id and all columns other than text and lang are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, repeats, shingle

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of pieces in a pack, counted keys that make a bucket, and duckdb's memory a bucket.
PACK, BUCKET, MEMORY = 4 << 20, 1 << 20, "256MB"
_PLACE = common.keys(81, LONGEST + 1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by one space), weight: distinct pieces that hold words."""
    low = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("raw"))
    squeezed = F.regexp_replace("raw", r"[\x20\x09]+", " ")
    return each.select("lang", F.trim(squeezed).alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("weight"))


def packs(distinct: DataFrame) -> DataFrame:
    """Pieces in packs: pack, langs, body (pieces by line, compressed), code (place in langs) and weight of each, words by lang."""

    def made(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).combine_chunks()
        coded = t.column("lang").combine_chunks().dictionary_encode()
        langs, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        weight = t.column("weight").to_numpy()
        body = "\n".join(t.column("piece").to_pylist()).encode()
        raw = np.frombuffer(body, np.uint8)
        line = np.concatenate([[0], np.cumsum(raw == 10)])
        words = np.bincount(line[:-1][raw == 32], minlength=len(weight)) + 1
        sums = [int((words * weight)[code == c].sum()) for c in range(len(langs))]
        row = [[uuid.uuid4().int >> 65], [langs.to_pylist()], [repeats._squeeze(raw)], [repeats._squeeze(code)], [repeats._squeeze(weight)], [sums], [int(words.sum())]]
        types = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(row, types, strict=True)], names=["pack", "langs", "body", "code", "weight", "sums", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                if part.num_rows:
                    held.append(pa.table(part.columns, names=["lang", "piece", "weight"]))
                    size += part.column(1).get_total_buffer_size() // max(1, batch.num_rows // part.num_rows)
                if size >= PACK:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return distinct.select("lang", "piece", "weight").mapInArrow(common.task(run), "pack bigint, langs array<string>, body binary, code binary, weight binary, sums array<bigint>, words bigint")


class Pack:
    """Words of a pack: start, end, piece of each; hashes for keys and for buckets."""

    def __init__(self, row: dict):
        self.pack, self.langs = row["pack"], row["langs"]
        self.data = np.frombuffer(repeats._open(row["body"]), np.uint8)
        self.code, self.weight = (np.frombuffer(repeats._open(row[c]), np.int64) for c in ("code", "weight"))
        inside = (self.data != 32) & (self.data != 10)
        before = np.concatenate([[False], inside])
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(~np.append(inside[1:], False) & inside) + 1
        self.piece = np.searchsorted(np.flatnonzero(self.data == 10), self.start)
        raw = [x.encode() for x in self.langs]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        self.hashes = []
        for seed in (1, 2):
            lang = shingle.word_hashes(data, ends - [len(x) for x in raw], ends, seed + 2)
            self.hashes.append((shingle.word_hashes(self.data, self.start, self.end, seed), lang[self.code[self.piece]] if len(self.piece) else lang[:0]))

    def phrases(self, n: int) -> np.ndarray:
        """Places where a phrase of n words begins."""
        at = np.arange(max(0, len(self.start) - n + 1))
        return at[self.piece[at] == self.piece[at + n - 1]]

    def keys(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        words, lang = self.hashes[which]
        with np.errstate(over="ignore"):
            h = lang[at] * _PLACE[LONGEST] + np.uint64(n)
            for k in range(n):
                h = h + words[at + k] * _PLACE[k]
            return common.mix(h)

    def counted(self, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the phrases, a second hash of each, and weighted counts."""
        key = np.concatenate([self.keys(at, n) for n, at in places.items()])
        other = np.concatenate([self.keys(at, n, 1) for n, at in places.items()])
        weight = np.concatenate([self.weight[self.piece[at]] for at in places.values()])
        order = np.argsort(key, kind="stable")
        key, other, weight = key[order], other[order], weight[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return key[first], other[first], np.add.reduceat(weight, first) if len(first) else weight

    def longer(self, pairs: np.ndarray) -> dict[int, np.ndarray]:
        """Places of phrases of 3 to LONGEST words whose pairs are all among the ``pairs`` keys (sorted)."""
        often = np.zeros(len(self.start) + 1, bool)
        at = self.phrases(2)
        often[at] = among(self.keys(at, 2), pairs)
        out = {}
        for n in range(3, LONGEST + 1):
            at = self.phrases(n)
            for k in range(n - 1):
                at = at[often[at + k]]
            out[n] = at
        return out


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def answers(rows: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted frequent keys of a pack, their counts, and whether the pack owns them."""
    parts = [np.frombuffer(repeats._open(x["blob"]), np.int64).reshape(3, -1) for x in rows or []]
    got = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    key = got[0].view(np.uint64)
    order = np.argsort(key)
    return key[order], got[1][order], got[2][order].astype(bool)


def add_up(table: pa.Table) -> pa.Table:
    """One bucket: (pack, keys and counts) in, (pack, frequent keys, counts, owned) out; summed in duckdb, which spills beyond MEMORY."""
    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
        con.execute("CREATE TABLE item (pack BIGINT, key BIGINT, n BIGINT)")
        for pack, blob in zip(table.column("pack"), table.column("blob"), strict=True):
            got = np.frombuffer(repeats._open(blob.as_py()), np.int64).reshape(2, -1)
            part = pa.table({"pack": np.full(got.shape[1], pack.as_py()), "key": got[0], "n": got[1]})
            con.register("part", part)
            con.execute("INSERT INTO item SELECT * FROM part")
            con.unregister("part")
        con.execute(f"CREATE TABLE often AS SELECT key, sum(n)::BIGINT AS n, min(pack) AS owner FROM item GROUP BY key HAVING sum(n) >= {LEAST}")
        got = con.execute("SELECT i.pack, i.key, o.n, (o.owner = i.pack)::BIGINT AS own FROM item i JOIN often o USING (key) ORDER BY i.pack").fetchnumpy()
    pack = np.asarray(got["pack"], np.int64)
    first = np.flatnonzero(np.append(True, pack[1:] != pack[:-1])) if len(pack) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(pack))
    blobs = [repeats._squeeze(*(np.asarray(got[c][a:b], np.int64) for c in ("key", "n", "own"))) for a, b in zip(first, ends, strict=True)]
    return pa.table({"pack": pa.array(pack[first], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _round(rows: DataFrame, places, buckets: int) -> DataFrame:
    """Answers (pack, blobs) to the keys that ``places`` (row -> pack, places) chooses."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pack, chosen = places({c: batch.column(c)[k].as_py() for c in batch.schema.names})
                key, other, count = pack.counted(chosen)
                dealt = repeats.Dealt(other, buckets)
                blobs = [repeats._squeeze(key[x].view(np.int64), count[x]) for x in dealt.parts()]
                yield pa.RecordBatch.from_arrays([pa.array(dealt.found, pa.int64()), pa.array(np.full(len(dealt.found), pack.pack), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "pack", "blob"])

    sent = rows.mapInArrow(common.task(ask), "bucket bigint, pack bigint, blob binary")
    counted = sent.groupBy("bucket").applyInArrow(add_up, "pack bigint, blob binary")
    return common.durable(counted.groupBy("pack").agg(F.collect_list(F.struct("blob")).alias("blobs")))


def frequent(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all phrases of 1 to 5 words that occur LEAST times, and (lang, n)."""
    pack = common.durable(packs(pieces(docs)))
    words = pack.agg(F.sum("words")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(words // BUCKET) + 1)
    body = pack.select("pack", "langs", "body", "code", "weight")

    def short(row: dict) -> tuple[Pack, dict]:
        p = Pack(row)
        return p, {n: p.phrases(n) for n in (1, 2)}

    def long(row: dict) -> tuple[Pack, dict]:
        p = Pack(row)
        return p, p.longer(answers(row["blobs"])[0])

    one = _round(body, short, buckets)
    two = _round(body.join(one, "pack", "left"), long, buckets)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                p = Pack(row)
                key, count, own = answers((row["blobs"] or []) + (row["more"] or []))
                key, count = key[own], count[own]
                chosen = {n: p.phrases(n) for n in (1, 2)} | p.longer(answers(row["blobs"])[0])
                for n, at in chosen.items():
                    mine = p.keys(at, n)
                    hit = among(mine, key)
                    at, mine = at[hit], mine[hit]
                    mine, first = np.unique(mine, return_index=True)
                    at = at[first]
                    text = [p.data[a:b].tobytes().decode() for a, b in zip(p.start[at], p.end[at + n - 1], strict=True)]
                    langs = [p.langs[c] for c in p.code[p.piece[at]]]
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.full(len(at), n), pa.int32()), pa.array(text, pa.string()), pa.array(count[np.searchsorted(key, mine)], pa.int64())], names=["lang", "size", "phrase", "a"])

    known = body.join(one, "pack", "left").join(two.withColumnRenamed("blobs", "more"), "pack", "left")
    out = common.durable(known.mapInArrow(common.task(write), "lang string, size int, phrase string, a bigint"))
    totals = common.durable(pack.select(F.explode(F.arrays_zip("langs", "sums")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sums").alias("n")))
    common.drop(pack, one, two)
    return out, totals


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    often, totals = frequent(docs)
    part = often.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    candidate = often.where("size > 1")
    cut = candidate.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("right")
    )
    looked = (
        cut.join(part.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(part.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(totals, "lang")
    )
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = looked.withColumn("top", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("bottom", wide("l") * wide("r")).withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")
    inside = candidate.where("size > 2").select("lang", "a", F.split("phrase", " ").alias("w"))
    inside = inside.select("lang", "a", F.explode(F.expr("array(array_join(slice(w, 1, size(w) - 1), ' '), array_join(slice(w, 2, size(w) - 1), ' '))")).alias("phrase"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(covered, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH piece AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, w FROM (
    SELECT lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')), '[^ \t]+') AS w FROM documents)
  WHERE len(w) > 0),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
often AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS a FROM (
    SELECT lang, s.size AS size, unnest(list_transform(range(1, len(w) - s.size + 2), lambda i: array_to_string(w[i:i + s.size - 1], ' '))) AS phrase FROM piece, (SELECT unnest([1, 2, 3, 4, 5]) AS size) s WHERE len(w) >= s.size)
  GROUP BY lang, size, phrase HAVING count(*) >= 100),
cut AS (
  SELECT lang, size, phrase, a, k, string_split(phrase, ' ') AS w FROM (SELECT *, unnest(range(1, size)) AS k FROM often WHERE size > 1)),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM cut c JOIN total t ON t.lang = c.lang
  JOIN often l ON l.lang = c.lang AND l.size = c.k AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often r ON r.lang = c.lang AND r.size = c.size - c.k AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
whole AS (SELECT lang, size, a, ' ' || phrase || ' ' AS padded FROM often WHERE size > 2),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM whole q WHERE q.lang = b.lang AND q.size > b.size AND 100 * q.a >= 100 * b.a AND contains(q.padded, ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000"""
