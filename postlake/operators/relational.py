"""Scans, projections, filters, curation, set operations, aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlake.functions import lexicon as L
from postlake.functions import text as X
from postlake.plans.posts import CTE, posts, q

QUERIES: dict = {}
ORACLE: dict = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def T(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def n():
    return F.count("*").alias("n")

# ---- sources
add("scan_documents", lambda s, d: T(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "SELECT doc_id, text, lang, source, n_chars FROM documents")
add(
    "scan_project_filter_nonempty",
    lambda s, d: T(s, d, "documents").where((F.col("text").isNotNull() & (F.col("text") != "")) | (F.col("source") != "")).select(F.trim(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id"), F.trim("text").alias("title"), F.trim("source").alias("source")),
    "SELECT CAST(doc_id AS VARCHAR) AS id, trim(text, ' ') AS title, trim(source, ' ') AS source FROM documents WHERE (text IS NOT NULL AND text <> '') OR source <> ''",
)
add("scan_label_in", lambda s, d: T(s, d, "events").where(F.col("event_type").isin("click", "error")).select("event_id", "user_id", "event_type", "value"), "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'error')")
add(
    "zip_lines_join",
    lambda s, d: _zip_lines(T(s, d, "documents").select("doc_id", "text"), T(s, d, "documents").select("doc_id", F.lower("text").alias("label"))),
    r"""WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS t, string_split(lower(text), chr(10)) AS l FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, t[i] AS line, l[i] AS label FROM (SELECT doc_id, t, l, unnest(range(1, len(t) + 1)) AS i FROM a)""",
)


def _zip_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two files of one key, paired by position."""
    left = a.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    right = b.select("doc_id", F.posexplode(F.split("label", "\n", -1)).alias("pos", "label"))
    return left.join(right, ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line", "label")


add(
    "load_labeled_split",
    lambda s, d: (
        posts(s, d)
        .select("post_id", F.coalesce(F.nullif(F.lit(""), F.lit("")), F.nullif("text", F.lit("")), F.lit("?")).alias("text"), F.lower(F.trim(F.upper("original"))).alias("label"))
        .where(F.col("label").isin(*L.LABELS))
    ),
    f"WITH {CTE} SELECT post_id, coalesce(nullif(text, ''), '?') AS text, original AS label FROM posts WHERE original IN ('negative', 'neutral', 'positive')",
)
add(
    "request_explode",
    lambda s, d: (
        posts(s, d).select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("post_id")) - 1).cast("bigint").alias("pos"), "post_id", "text", "context")
    ),
    f"WITH {CTE} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY post_id) - 1 AS pos, post_id, text, context FROM posts",
)
add(
    "profile_tables",
    lambda s, d: _union([T(s, d, t).agg(F.lit(t).alias("tbl"), F.count("*").alias("rows")) for t in ("documents", "pages", "labels", "conversations", "events")]),
    " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS rows FROM {t}" for t in ("documents", "pages", "labels", "conversations", "events")),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---- projections and filters
add(
    "project_coalesce_text",
    lambda s, d: posts(s, d).select("post_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("context"), F.lit("")), F.lit("")).alias("content")),
    f"WITH {CTE} SELECT post_id, coalesce(nullif(trim(text, ' '), ''), nullif(trim(context, ' '), ''), '') AS content FROM posts",
)
add(
    "project_compose_text",
    lambda s, d: posts(s, d).select("post_id", F.concat_ws(". ", F.nullif("text", F.lit("")), F.nullif("context", F.lit(""))).alias("content")),
    f"WITH {CTE} SELECT post_id, concat_ws('. ', nullif(text, ''), nullif(context, '')) AS content FROM posts",
)
add(
    "filter_nonempty",
    lambda s, d: posts(s, d).agg(F.count_if((F.col("text") != "") | F.col("context").isNotNull()).alias("kept"), F.count_if((F.col("text") == "") & F.col("context").isNull()).alias("skipped")),
    f"WITH {CTE} SELECT count(*) FILTER (text <> '' OR context IS NOT NULL) AS kept, count(*) FILTER (text = '' AND context IS NULL) AS skipped FROM posts",
)
add(
    "recode_labels",
    lambda s, d: T(s, d, "labels").select("doc_id", F.element_at(F.array(*map(F.lit, L.LABELS)), F.col("quality") + F.col("toxic") + 1).alias("label")),
    "SELECT doc_id, (['negative', 'neutral', 'positive'])[quality + toxic + 1] AS label FROM labels",
)
_SPAM = "(?i)" + "|".join(L.SPAM)
add("filter_spam", lambda s, d: posts(s, d).where(~F.col("text").rlike(_SPAM)).select("post_id", "text"), f"WITH {CTE} SELECT post_id, text FROM posts WHERE NOT regexp_matches(text, {q(_SPAM)})")
add("limit_sample", lambda s, d: T(s, d, "documents").orderBy("doc_id").limit(50).select("doc_id", "source"), "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")


# ---- verification of labels
def verified(df: DataFrame) -> DataFrame:
    """reason and label of the verification table; composite is polarity plus positive minus negative words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+"), 0)
    pos = F.size(F.array_intersect(words, F.array(*map(F.lit, L.VERIFY_POSITIVE))))
    neg = F.size(F.array_intersect(words, F.array(*map(F.lit, L.VERIFY_NEGATIVE))))
    x = df.select("*", pos.alias("pos"), neg.alias("neg"), F.round(X.emoji_polarity(F.col("text")), 6).alias("emo")).withColumn("score", F.col("emo") + F.col("pos") - F.col("neg"))
    c, p, g, e = F.col("score"), F.col("pos"), F.col("neg"), F.col("emo")
    o = F.col("original")
    # Reasons and bounds of the verification table
    reason = (
        F.when(F.char_length(F.trim("text")) < 12, "Text too short")
        .when(F.col("text").rlike(_SPAM), "Spam or boilerplate")
        .when(o == "positive", F.when((c >= 1) & (g == 0) & (e >= 0), "Strong positive agreement").when((c < -0.8) | (g >= 2), "Corrupt DB label: labeled positive but content is negative").when((c > 0) & (g == 0), "Moderate positive agreement").otherwise("Insufficient confidence for positive"))
        .when(o == "negative", F.when((c <= -1) & (p == 0) & (e <= 0), "Strong negative agreement").when((c > 0.8) | (p >= 2), "Corrupt DB label: labeled negative but content is positive").when((c < 0) & (p == 0), "Moderate negative agreement").otherwise("Insufficient confidence for negative"))
        .when(o == "neutral", F.when((F.abs(c) <= 0.2) & (p == 0) & (g == 0), "Verified neutral objective").otherwise("Subjective signals present in neutral label"))
        .otherwise("Unknown label")
    )
    return x.withColumn("reason", reason).withColumn("valid", F.col("reason").rlike("agreement$|^Verified"))


_LIST = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
_EM = ", ".join(f"({q(e)}, {w})" for e, (w, *_) in L.EMOJI.items())
VERIFY = rf"""{CTE}, em(e, w) AS (VALUES {_EM}),
m AS (SELECT post_id, unnest(regexp_extract_all(text, {q("|".join(L.EMOJI_LONGEST))})) AS e FROM posts),
ep AS (SELECT post_id, sum(CAST(w AS DOUBLE)) AS emo FROM m JOIN em USING (e) GROUP BY 1),
w AS (SELECT p.*, round(coalesce(ep.emo, 0), 6) AS emo, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS ws FROM posts p LEFT JOIN ep ON ep.post_id = p.post_id),
x AS (SELECT *, len(list_intersect(ws, {_LIST(L.VERIFY_POSITIVE)})) AS pos, len(list_intersect(ws, {_LIST(L.VERIFY_NEGATIVE)})) AS neg FROM w),
v AS (SELECT *, emo + pos - neg AS score FROM x),
r AS (SELECT *, CASE WHEN length(trim(text, ' ')) < 12 THEN 'Text too short' WHEN regexp_matches(text, {q(_SPAM)}) THEN 'Spam or boilerplate'
 WHEN original = 'positive' THEN CASE WHEN score >= 1 AND neg = 0 AND emo >= 0 THEN 'Strong positive agreement' WHEN score < -0.8 OR neg >= 2 THEN 'Corrupt DB label: labeled positive but content is negative' WHEN score > 0 AND neg = 0 THEN 'Moderate positive agreement' ELSE 'Insufficient confidence for positive' END
 WHEN original = 'negative' THEN CASE WHEN score <= -1 AND pos = 0 AND emo <= 0 THEN 'Strong negative agreement' WHEN score > 0.8 OR pos >= 2 THEN 'Corrupt DB label: labeled negative but content is positive' WHEN score < 0 AND pos = 0 THEN 'Moderate negative agreement' ELSE 'Insufficient confidence for negative' END
 WHEN original = 'neutral' THEN CASE WHEN abs(score) <= 0.2 AND pos = 0 AND neg = 0 THEN 'Verified neutral objective' ELSE 'Subjective signals present in neutral label' END
 ELSE 'Unknown label' END AS reason FROM v)"""
add("verify_label", lambda s, d: verified(posts(s, d)).select("post_id", "valid", F.when(F.col("valid"), F.col("original")).otherwise("").alias("label"), "reason"), f"WITH {VERIFY} SELECT post_id, regexp_matches(reason, 'agreement$|^Verified') AS valid, CASE WHEN regexp_matches(reason, 'agreement$|^Verified') THEN original ELSE '' END AS label, reason FROM r")
add("verify_reject_counts", lambda s, d: verified(posts(s, d)).where("not valid").groupBy("reason").agg(n()), f"WITH {VERIFY} SELECT reason, count(*) AS n FROM r WHERE NOT regexp_matches(reason, 'agreement$|^Verified') GROUP BY 1")
add(
    "sample_complaints",
    lambda s, d: verified(posts(s, d)).where("score < 0 and original <> 'negative'").orderBy("post_id").limit(10).select("post_id", F.substring("text", 1, 150).alias("text"), F.upper("original").alias("legacy")),
    f"WITH {VERIFY} SELECT post_id, substr(text, 1, 150) AS text, upper(original) AS legacy FROM r WHERE score < 0 AND original <> 'negative' ORDER BY post_id LIMIT 10",
)

# ---- sets, caps and splits
add("corpus_union", lambda s, d: T(s, d, "documents").select("text", F.lit("documents").alias("origin")).unionByName(T(s, d, "conversations").select("text", F.lit("conversations").alias("origin"))).groupBy("origin").agg(n(), F.sum(F.char_length("text")).alias("chars")), "SELECT origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, 'documents' AS origin FROM documents UNION ALL SELECT text, 'conversations' FROM conversations) GROUP BY 1")
add("oversample", lambda s, d: T(s, d, "labels").where("toxic = 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("copy")), "SELECT doc_id, CAST(copy AS INTEGER) AS copy FROM labels, range(1, 26) r(copy) WHERE toxic = 1")
add(
    "cap_per_class",
    lambda s, d: T(s, d, "documents").withColumn("rk", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("rk <= 100").select("doc_id", "lang", F.col("rk").cast("bigint").alias("rk")),
    "SELECT doc_id, lang, rk FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 100",
)


def split_70_15_15(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """train / val / test by place in the order of a hash, exact sizes int(.7n), int(.15n), rest.

    Places come from counts of the hash's first three hex digits and ranks within
    them, so no task orders all rows; only the 4096 counts meet in one task."""
    h = df.select(key, F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256).alias("h")).withColumn("cell", F.substring("h", 1, 3))
    cells = h.groupBy("cell").agg(F.count("*").alias("rows"))
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("cell", F.coalesce(F.sum("rows").over(whole), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy()).alias("n"))
    placed = h.join(F.broadcast(starts), "cell").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("cell").orderBy("h", key)))
    a, b = F.floor(F.col("n") * 0.7), F.floor(F.col("n") * 0.7) + F.floor(F.col("n") * 0.15)
    return placed.select(key, F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "val").otherwise("test").alias("split"))


add(
    "split_70_15_15",
    lambda s, d: split_70_15_15(T(s, d, "documents"), "doc_id"),
    "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN place <= CAST(floor(n * 0.7) AS BIGINT) + CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM o",
)
_PRE, _SUB, _PRED = ["Honestly", "Today", "Again"], ["the app", "support", "the update"], ["is great", "is slow", "crashed", "went live"]
add(
    "synth_posts",
    lambda s, d: (
        s.range(1).select(F.explode(F.array(*map(F.lit, _PRE))).alias("a"))
        .select("a", F.explode(F.array(*map(F.lit, _SUB))).alias("b"))
        .select("a", "b", F.explode(F.array(*map(F.lit, _PRED))).alias("c"))
        .select(F.concat_ws(" ", "a", "b", "c").alias("text"))
    ),
    f"SELECT a || ' ' || b || ' ' || c AS text FROM (SELECT unnest({_LIST(_PRE)}) AS a), (SELECT unnest({_LIST(_SUB)}) AS b), (SELECT unnest({_LIST(_PRED)}) AS c)",
)

# ---- aggregates
add("label_distribution", lambda s, d: T(s, d, "labels").groupBy("quality", "toxic").agg(n()), "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
add("legacy_distribution", lambda s, d: posts(s, d).groupBy(F.coalesce(F.nullif(F.trim("original"), F.lit("")), F.lit("unlabeled")).alias("label")).agg(n()), f"WITH {CTE} SELECT coalesce(nullif(trim(original), ''), 'unlabeled') AS label, count(*) AS n FROM posts GROUP BY 1")
add("class_counts", lambda s, d: T(s, d, "documents").groupBy("lang", "source").agg(n()), "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
add(
    "latency_percentiles",
    lambda s, d: T(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), *[F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (50, 90, 95, 99)]),
    "SELECT event_type, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM events GROUP BY 1",
)
add(
    "service_metrics",
    lambda s, d: T(s, d, "events").agg(
        n(), F.count_if(F.col("event_type") == "error").alias("fallbacks"),
        F.round(F.when(F.count("*") > 0, 100.0 * F.count_if(F.col("event_type") == "error") / F.count("*")).otherwise(0.0), 2).alias("fallback_pct"),
        F.round(F.when(F.count("*") > 0, F.sum("value") / F.count("*")).otherwise(0.0), 6).alias("avg_value"),
    ),
    "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS fallbacks, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (event_type = 'error') / count(*) ELSE 0 END, 2) AS fallback_pct, round(CASE WHEN count(*) > 0 THEN sum(value) / count(*) ELSE 0 END, 6) AS avg_value FROM events",
)
add("lang_source_cube", lambda s, d: T(s, d, "documents").cube("source", "lang").agg(n()), "SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
add("label_reason_rollup", lambda s, d: verified(posts(s, d)).rollup("original", "reason").agg(n()), f"WITH {VERIFY} SELECT original, reason, count(*) AS n FROM r GROUP BY ROLLUP (original, reason)")
add(
    "label_alignment",
    lambda s, d: T(s, d, "documents").join(T(s, d, "labels"), "doc_id").withColumn("predicted", (F.char_length("text") > 400).cast("int")).agg(
        n(), F.count_if(F.col("predicted") == F.col("quality")).alias("exact"), F.count_if(F.col("predicted") != F.col("quality")).alias("refined"),
        F.round(F.when(F.count("*") > 0, 100.0 * F.count_if(F.col("predicted") == F.col("quality")) / F.count("*")).otherwise(0.0), 2).alias("pct")),
    "SELECT count(*) AS n, count(*) FILTER (p = quality) AS exact, count(*) FILTER (p <> quality) AS refined, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (p = quality) / count(*) ELSE 0 END, 2) AS pct FROM (SELECT quality, CAST(length(text) > 400 AS INTEGER) AS p FROM documents JOIN labels USING (doc_id))",
)
_PRED_CTE = "p AS (SELECT quality AS y, CAST(length(text) > 400 AS INTEGER) AS p FROM documents JOIN labels USING (doc_id))"


def _scored(s, d):
    return T(s, d, "documents").join(T(s, d, "labels"), "doc_id").select(F.col("quality").alias("y"), (F.char_length("text") > 400).cast("int").alias("p"))


add("confusion_matrix", lambda s, d: _scored(s, d).groupBy("y", "p").agg(n()), f"WITH {_PRED_CTE} SELECT y, p, count(*) AS n FROM p GROUP BY ALL")


def per_class(df: DataFrame, classes: list) -> DataFrame:
    """precision, recall and F1 of each class (0 where undefined) in one pass over (y, p)."""
    cls = df.select("y", "p", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    g = cls.groupBy("class").agg(F.count_if((F.col("y") == F.col("class")) & (F.col("p") == F.col("class"))).alias("tp"), F.count_if(F.col("p") == F.col("class")).alias("pp"), F.count_if(F.col("y") == F.col("class")).alias("support"))
    z = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return g.select("class", "support", z(F.col("tp"), F.col("pp")).alias("precision"), z(F.col("tp"), F.col("support")).alias("recall"), z(2.0 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"))


_PRF = f"WITH {_PRED_CTE}, c AS (SELECT class, count(*) FILTER (y = class AND p = class) AS tp, count(*) FILTER (p = class) AS pp, count(*) FILTER (y = class) AS support FROM p, (VALUES (0), (1)) v(class) GROUP BY 1)"
add("per_class_prf", lambda s, d: per_class(_scored(s, d), [0, 1]), _PRF + " SELECT class, support, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN pp + support > 0 THEN 2.0 * tp / (pp + support) ELSE 0 END AS f1 FROM c")
add(
    "macro_f1",
    lambda s, d: per_class(_scored(s, d), [0, 1]).agg(F.round(F.avg("f1"), 9).alias("macro_f1")),
    _PRF + " SELECT round(avg(CASE WHEN pp + support > 0 THEN CAST(2 * tp AS DOUBLE) / (pp + support) ELSE 0 END), 9) AS macro_f1 FROM c",
)
add("class_weights", lambda s, d: T(s, d, "labels").groupBy("quality").agg(n()).crossJoin(F.broadcast(T(s, d, "labels").agg(F.count("*").alias("all"), F.count_distinct("quality").alias("k")))).select("quality", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight")), "SELECT quality, (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)) AS weight FROM labels GROUP BY 1")

# ---- threads
add(
    "thread_context_join",
    lambda s, d: T(s, d, "conversations").alias("c").join(T(s, d, "conversations").alias("p"), (F.col("c.conv_id") == F.col("p.conv_id")) & (F.col("c.turn") - 1 == F.col("p.turn"))).select("c.conv_id", "c.turn", F.col("c.text").alias("text"), F.col("p.text").alias("context")),
    "SELECT c.conv_id, c.turn, c.text, p.text AS context FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn - 1 = p.turn",
)
add(
    "thread_context_lag",
    lambda s, d: T(s, d, "conversations").select("conv_id", "turn", "role", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("context")),
    "SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations",
)

# ---- documents and requests as files
add(
    "doc_format_dispatch",
    lambda s, d: T(s, d, "pages").select("page_id", _format(F.col("url")).alias("format")).groupBy("format").agg(n()),
    "SELECT format, count(*) AS n FROM (SELECT CASE WHEN e IN ('pdf') THEN 'pdf' WHEN e IN ('docx', 'doc') THEN 'docx' WHEN e IN ('csv') THEN 'csv' WHEN e = 'json' THEN 'json' WHEN e IN ('txt', 'md', 'log') THEN 'text' ELSE 'unsupported' END AS format FROM (SELECT lower(string_split(split_part(url, '?', 1), '.')[-1]) AS e FROM pages)) GROUP BY 1",
)


def _format(path):
    e = F.lower(F.element_at(F.split(F.split_part(path, F.lit("?"), F.lit(1)), r"\."), -1))
    return F.when(e == "pdf", "pdf").when(e.isin("docx", "doc"), "docx").when(e == "csv", "csv").when(e == "json", "json").when(e.isin("txt", "md", "log"), "text").otherwise("unsupported")


add(
    "doc_text_plain",
    lambda s, d: T(s, d, "documents").select("doc_id", F.trim(F.decode(F.encode("text", "UTF-8"), "UTF-8")).alias("text")).select("doc_id", "text", F.char_length("text").cast("bigint").alias("char_count")),
    "SELECT doc_id, trim(text, ' ') AS text, length(trim(text, ' ')) AS char_count FROM documents",
)
add(
    "doc_json_flatten",
    lambda s, d: T(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")),
    "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
)
add(
    "webvtt_clean",
    lambda s, d: T(s, d, "documents").select("doc_id", F.array_join(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~F.contains(x, F.lit("-->")) & ~x.startswith("WEBVTT") & ~x.rlike("^[0-9]+$")), " ").alias("text")),
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT contains(x, '-->') AND NOT starts_with(x, 'WEBVTT') AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS text FROM documents",
)
add(
    "active_learning_queue",
    lambda s, d: T(s, d, "events").where("value < 3").select("event_id", F.col("event_type").alias("label"), F.lit("low_confidence").alias("reason")).unionByName(T(s, d, "events").where("value < 3 and event_type = 'error'").select("event_id", F.col("event_type").alias("label"), F.lit("fallback_resolved").alias("reason"))),
    "SELECT event_id, event_type AS label, 'low_confidence' AS reason FROM events WHERE value < 3 UNION ALL SELECT event_id, event_type, 'fallback_resolved' FROM events WHERE value < 3 AND event_type = 'error'",
)
add("active_learning_tail", lambda s, d: T(s, d, "events").where("value < 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE value < 3 ORDER BY ts DESC, event_id DESC LIMIT 20")
