"""TF-IDF vocabulary, softmax scores, cache and state, windows, and the rule part of the media front end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.functions import text as X
from postlake.operators import vectors as V
from postlake.plans.cut import cut
from postlake.plans.posts import CTE, posts, q

QUERIES: dict = {}
ORACLE: dict = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def T(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- TF-IDF
def features(text: Column) -> Column:
    """Words, word bigrams and character trigrams of a text, with repeats."""
    return X.let(X.model_tokens(text), lambda w: F.concat(w, X.bigrams(w), X.trigrams(w)))


def terms(docs: DataFrame) -> DataFrame:
    """(doc_id, token, tf) of whole texts; counts are summed before they move."""
    return docs.select("doc_id", F.explode(features(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def doc_frequency(docs: DataFrame, times: str | None = None) -> DataFrame:
    """(token, df): rows whose text holds the token, a row counted as often as column ``times`` says. Counted
    inside tasks first, so that only their sums are shuffled."""
    rows = docs.select(X.model_tokens(F.col("text")).alias("words"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("times"))
    return rows.mapInArrow(V.frequencies, "token string, df bigint").groupBy("token").agg(F.sum("df").alias("df"))


def vocabulary(docs: DataFrame, max_features: int = 40000, times: str | None = None) -> DataFrame:
    """token, df, idf of the most frequent tokens (ties by token), at least 2 documents beyond 100 documents."""
    top = doc_frequency(docs, times).orderBy(F.desc("df"), "token").limit(max_features)
    n = docs.agg((F.coalesce(F.sum(times), F.lit(0)) if times else F.count("*")).alias("n_docs"))  # one row
    known = top.crossJoin(F.broadcast(n)).where(F.col("df") >= F.when(F.col("n_docs") > 100, 2).otherwise(1))
    return known.withColumn("idf", F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).drop("n_docs")


def numbered_vocabulary(voc: DataFrame) -> tuple[list, pa.StringArray]:
    """The vocabulary's rows by token, and the tokens, numbered by their places. At most max_features rows, they travel with the tasks."""
    rows = voc.orderBy("token").collect()
    return rows, pa.array([r.token for r in rows], pa.string())


def by_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose doc_id stands once, and those of the other doc_ids (None: there are none), which make one document together."""
    x = docs.select("doc_id", "text")
    again = cut(x.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if not again.take(1):
        return x, None
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    return x.join(again, same, "left_anti"), x.join(again, same, "left_semi")


def worded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.model_tokens(F.col("text")).alias("words"))


def tfidf(docs: DataFrame, voc: DataFrame | None = None, max_features: int = 40000) -> DataFrame:
    """(doc_id, token, weight and further columns of the vocabulary): sublinear term frequency times idf, unit
    length; unknown tokens are left out. The vocabulary has at most max_features rows and travels with the tasks. A
    text's weights are made in its own task, nothing is shuffled; only rows that share a doc_id are grouped."""
    voc = vocabulary(docs, max_features) if voc is None else voc
    rows, at = numbered_vocabulary(voc)
    idf = np.array([r.idf for r in rows], float)
    more = [c for c in voc.columns if c not in ("token", "idf", "df")]
    known = docs.sparkSession.createDataFrame(rows, voc.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in V.chunks(b):
                text, token, tf = V.cells(c.column(1), at)
                w = V.weights(text, token, tf, idf, c.num_rows)
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(text)), at.take(pa.array(token)), pa.array(w)], names=["doc_id", "token", "weight"])

    single, again = by_repeats(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = worded(single).mapInArrow(run, f"doc_id {kind}, token string, weight double")
    if again is not None:
        raw = terms(again).join(F.broadcast(known), "token").withColumn("v", (1.0 + F.log("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("doc_id")))
        out = out.unionByName(raw.withColumn("norm", norm).select("doc_id", "token", F.when(F.col("norm") > 0, F.col("v") / F.col("norm")).otherwise(0.0).alias("weight")))
    return out.join(F.broadcast(known.select("token", *more)), "token").select("doc_id", "token", "weight", *more) if more else out


def token_counts(docs: DataFrame, voc: DataFrame) -> DataFrame:
    """(token, tf, docs): occurrences of each token of the vocabulary and documents that hold it, summed in tasks first."""
    _, at = numbered_vocabulary(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tfs, held = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for b in batches:
            for c in V.chunks(b):
                _, token, tf = V.cells(c.column(1), at)
                tfs += np.bincount(token, tf, len(at)).astype(np.int64)
                held += np.bincount(token, minlength=len(at))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([at.take(pa.array(seen)), pa.array(tfs[seen]), pa.array(held[seen])], names=["token", "tf", "docs"])

    single, again = by_repeats(docs)
    out = worded(single).mapInArrow(run, "token string, tf bigint, docs bigint")
    if again is not None:
        known = docs.sparkSession.createDataFrame([(t,) for t in at.to_pylist()], "token string")
        out = out.unionByName(terms(again).join(F.broadcast(known), "token").select("token", "tf", F.lit(1).cast("bigint").alias("docs")))
    return out.groupBy("token").agg(F.sum("tf").alias("tf"), F.sum("docs").alias("docs"))


_CH = """ch AS (SELECT doc_id, i, substr(t, i, 1) AS ch FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS i FROM documents)),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch, grp ORDER BY i) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS grp FROM ch)),
lo AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS t FROM rn WHERE k <= 2 OR ch IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY doc_id)"""
_K = _CH + r""",
w AS (SELECT doc_id, regexp_extract_all(t, '[\x{0900}-\x{097f}]+|[\p{L}\p{N}_]+') AS w FROM lo),
k AS (SELECT doc_id, unnest(w) AS token FROM w
 UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w
 UNION ALL SELECT doc_id, unnest(list_transform(range(1, length(x) - 1), lambda i: '#' || substr(x, i, 3) || '#')) FROM (SELECT doc_id, unnest(w) AS x FROM w) WHERE length(x) BETWEEN 4 AND 10 AND NOT starts_with(x, '_'))"""
_DF = f"{_K}, df AS (SELECT token, count(DISTINCT doc_id) AS df FROM k GROUP BY 1)"
_VOC = f"{_DF}, voc AS (SELECT token, df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM (SELECT * FROM df ORDER BY df DESC, token LIMIT 40000) WHERE df >= CASE WHEN (SELECT count(*) FROM documents) > 100 THEN 2 ELSE 1 END)"
_TFI = f"{_VOC}, raw AS (SELECT doc_id, token, (1.0 + ln(count(*))) * any_value(idf) AS v FROM k JOIN voc USING (token) GROUP BY ALL)"
add("doc_frequency", lambda s, d: doc_frequency(T(s, d, "documents")), f"WITH {_DF} SELECT token, df FROM df")
add("vocab_topk", lambda s, d: vocabulary(T(s, d, "documents")).select("token", "df"), f"WITH {_VOC} SELECT token, df FROM voc")
add("idf_weights", lambda s, d: vocabulary(T(s, d, "documents")).select("token", F.round("idf", 6).alias("idf")), f"WITH {_VOC} SELECT token, round(idf, 6) AS idf FROM voc")
add("tfidf_vectors", lambda s, d: tfidf(T(s, d, "documents")).select("doc_id", "token", F.round("weight", 6).alias("weight")), f"WITH {_TFI} SELECT doc_id, token, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw")


def weight_table(voc: DataFrame) -> DataFrame:
    """A fixed weight table over the vocabulary: three weights from the token's length and frequency."""
    a, b = F.char_length("token"), F.col("df")
    return voc.select("token", "idf", ((a % 5 - 2) / 4.0).alias("w0"), ((b % 7 - 3) / 6.0).alias("w1"), (((a + b) % 5 - 2) / 4.0).alias("w2"))


def softmax(vectors: DataFrame, bias: tuple = (0.1, 0.0, -0.1)) -> DataFrame:
    """p_negative, p_neutral, p_positive and label (first of equals in class order) of each doc_id;
    vectors carry their tokens' weights w0, w1, w2."""
    z = vectors.groupBy("doc_id").agg(*[(F.sum(F.col("weight") * F.col(f"w{i}")) + F.lit(bias[i])).alias(f"z{i}") for i in range(3)])
    return probabilities(z)


def probabilities(z: DataFrame) -> DataFrame:
    m = F.greatest("z0", "z1", "z2")
    e = [F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col(f"z{i}") - m))) for i in range(3)]
    out = z.select("doc_id", *[x.alias(f"e{i}") for i, x in enumerate(e)]).withColumn("t", F.col("e0") + F.col("e1") + F.col("e2"))
    p = out.select("doc_id", (F.col("e0") / F.col("t")).alias("p_negative"), (F.col("e1") / F.col("t")).alias("p_neutral"), (F.col("e2") / F.col("t")).alias("p_positive"))
    top = F.greatest("p_negative", "p_neutral", "p_positive")
    return p.withColumn("label", F.when(F.col("p_negative") == top, "negative").when(F.col("p_neutral") == top, "neutral").otherwise("positive"))


def softmax_rows(docs: DataFrame, voc: DataFrame, bias: tuple = (0.1, 0.0, -0.1)) -> DataFrame:
    """What ``softmax`` gives for the vectors of ``docs`` over a vocabulary with weights, each text in its own task. Texts
    without a known token have no row."""
    rows, at = numbered_vocabulary(voc)
    idf, table = np.array([r.idf for r in rows], float), np.array([[r.w0, r.w1, r.w2] for r in rows], float).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in V.chunks(b):
                text, token, tf = V.cells(c.column(1), at)
                w = V.weights(text, token, tf, idf, c.num_rows)
                seen = np.unique(text)
                z = [np.bincount(text, w * table[token, k], c.num_rows)[seen] + bias[k] for k in range(3)]
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(seen)), *map(pa.array, z)], names=["doc_id", "z0", "z1", "z2"])

    single, again = by_repeats(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = probabilities(worded(single).mapInArrow(run, f"doc_id {kind}, z0 double, z1 double, z2 double"))
    return out if again is None else out.unionByName(softmax(tfidf(again, docs.sparkSession.createDataFrame(rows, voc.schema)), bias))


_W = f"{_TFI}, vec AS (SELECT doc_id, token, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM raw), wt AS (SELECT token, (length(token) % 5 - 2) / 4.0 AS w0, (df % 7 - 3) / 6.0 AS w1, ((length(token) + df) % 5 - 2) / 4.0 AS w2 FROM voc), z AS (SELECT doc_id, sum(w * CAST(w0 AS DOUBLE)) + 0.1 AS z0, sum(w * CAST(w1 AS DOUBLE)) AS z1, sum(w * CAST(w2 AS DOUBLE)) - 0.1 AS z2 FROM vec JOIN wt USING (token) GROUP BY 1), e AS (SELECT doc_id, exp(greatest(-20, least(20, z0 - greatest(z0, z1, z2)))) AS e0, exp(greatest(-20, least(20, z1 - greatest(z0, z1, z2)))) AS e1, exp(greatest(-20, least(20, z2 - greatest(z0, z1, z2)))) AS e2 FROM z)"
add(
    "softmax_scores",
    lambda s, d: softmax_rows(T(s, d, "documents"), weight_table(vocabulary(T(s, d, "documents")))).select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_negative", "p_neutral", "p_positive")], "label"),
    f"WITH {_W} SELECT doc_id, round(e0 / (e0 + e1 + e2), 6) AS p_negative, round(e1 / (e0 + e1 + e2), 6) AS p_neutral, round(e2 / (e0 + e1 + e2), 6) AS p_positive, CASE WHEN e0 >= e1 AND e0 >= e2 THEN 'negative' WHEN e1 >= e2 THEN 'neutral' ELSE 'positive' END AS label FROM e",
)
add("join_vocab_weights", lambda s, d: token_counts(T(s, d, "documents"), vocabulary(T(s, d, "documents"))), f"WITH {_VOC} SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS docs FROM k JOIN voc USING (token) GROUP BY 1")
add(
    "model_prune_weights",
    lambda s, d: weight_table(vocabulary(T(s, d, "documents"))).where(F.abs("w1") > 1e-4).select("token", F.bround("w1", 5).alias("w1"), F.bround("idf", 4).alias("idf")),
    f"WITH {_VOC} SELECT token, round_even((df % 7 - 3) / 6.0, 5) AS w1, round_even(idf, 4) AS idf FROM voc WHERE abs((df % 7 - 3) / 6.0) > 1e-4",
)


# ---- cache and state
def cache_key(text, context):
    """SHA-256 of the squashed lower text without links and leading 'rt @user:', and of the context."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://\S+|www\.\S+", ""), r"^rt\s+@[a-z0-9_]+:\s*", "")
    ctx = norm(context)
    return F.sha2(F.concat(norm(bare), F.when(ctx != "", F.concat(F.lit("|||ctx:"), ctx)).otherwise("")), 256)


_NORM = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'), ' ')"
_KEY = "sha256(" + _NORM("regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://[^\\s]+|www\\.[^\\s]+', '', 'g'), '^rt\\s+@[a-z0-9_]+:\\s*', '')") + " || CASE WHEN " + _NORM("context") + " <> '' THEN '|||ctx:' || " + _NORM("context") + " ELSE '' END)"
add("cache_key", lambda s, d: posts(s, d).select("post_id", cache_key(F.col("text"), F.col("context")).alias("key")), f"WITH {CTE} SELECT post_id, {_KEY} AS key FROM posts")


def _keyed(s, d):
    return posts(s, d).select("post_id", "user_id", cache_key(F.col("text"), F.col("context")).alias("key"))


add("dedup_score_once", lambda s, d: _keyed(s, d).groupBy("key").agg(F.min("post_id").alias("first_post"), F.count("*").alias("uses")), f"WITH {CTE}, k AS (SELECT post_id, {_KEY} AS key FROM posts) SELECT key, min(post_id) AS first_post, count(*) AS uses FROM k GROUP BY 1")
add(
    "cache_stats",
    lambda s, d: _keyed(s, d).groupBy("key").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"), F.round(100.0 * F.sum(F.col("n") - 1) / F.sum("n"), 2).alias("hit_rate")),
    f"WITH {CTE}, k AS (SELECT {_KEY} AS key FROM posts) SELECT count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS misses, round(100.0 * (count(*) - count(DISTINCT key)) / count(*), 2) AS hit_rate FROM k",
)
add(
    "cache_hits_by_request",
    lambda s, d: (
        _keyed(s, d).withColumn("request", F.expr("post_id div 50")).withColumn("earlier", F.min("request").over(Window.partitionBy("key")))
        .groupBy("request").agg(F.count_if(F.col("earlier") < F.col("request")).alias("hits"), F.count("*").alias("n"))
    ),
    f"WITH {CTE}, k AS (SELECT post_id // 50 AS request, {_KEY} AS key FROM posts), e AS (SELECT *, min(request) OVER (PARTITION BY key) AS earlier FROM k) SELECT request, count(*) FILTER (earlier < request) AS hits, count(*) AS n FROM e GROUP BY 1",
)


def lru_hits(accesses: DataFrame, part: str, order: str, key: str, capacity: int) -> DataFrame:
    """Exact least-recently-used hits within each ``part``: an access hits iff fewer than
    ``capacity`` other keys were used since its key's last use. The number of distinct keys
    since then is the number of positions whose own next use lies beyond, found by a
    range-limited self-join inside the part."""
    w = Window.partitionBy(part).orderBy(order)
    x = accesses.withColumn("i", F.row_number().over(w)).withColumn("last", F.lag("i").over(Window.partitionBy(part, key).orderBy("i"))).withColumn("next", F.lead("i").over(Window.partitionBy(part, key).orderBy("i")))
    again = x.where(F.col("last").isNotNull()).select(part, F.col(order).alias("_o"), F.col("i").alias("_i"), F.col("last").alias("_l"))
    between = x.select(part, F.col("i").alias("_j"), F.coalesce("next", F.lit(1 << 60)).alias("_n"))
    dist = again.join(between, part).where("_j > _l and _j < _i and _n >= _i").groupBy(part, "_o").agg(F.count("*").alias("others"))
    hits = again.join(dist, [part, "_o"], "left").select(part, F.col("_o").alias(order), (F.coalesce("others", F.lit(0)) < capacity).alias("hit"))
    return x.select(part, order, key).join(hits, [part, order], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


add(
    "lru_reuse_distance",
    lambda s, d: lru_hits(_keyed(s, d), "user_id", "post_id", "key", 5).groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n")),
    f"""WITH {CTE}, k AS (SELECT user_id, post_id, {_KEY} AS key, row_number() OVER (PARTITION BY user_id ORDER BY post_id) AS i FROM posts),
x AS (SELECT *, lag(i) OVER (PARTITION BY user_id, key ORDER BY i) AS last FROM k),
h AS (SELECT a.user_id, a.post_id, a.last IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM k b WHERE b.user_id = a.user_id AND b.i > a.last AND b.i < a.i) < 5 AS hit FROM x a)
SELECT user_id, count(*) FILTER (hit) AS hits, count(*) AS n FROM h GROUP BY 1""",
)
add(
    "running_counters",
    lambda s, d: T(s, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("event_type").orderBy("hour"))).select("event_type", F.unix_timestamp("hour").alias("hour"), "n", "total"),
    "SELECT event_type, hour, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS total FROM (SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL)",
)
# ---- event-time windows (an extension; the same functions serve streams in postlake.streaming)
add("tumbling_label_counts", lambda s, d: T(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n"), "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
add(
    "sliding_counts",
    lambda s, d: T(s, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("start"), "n"),
    "WITH e AS (SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 AS b FROM events) SELECT start, count(*) AS n FROM (SELECT b AS start FROM e UNION ALL SELECT b - 1800 FROM e) GROUP BY 1",
)
add(
    "session_counts",
    lambda s, d: T(s, d, "events").groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
)
