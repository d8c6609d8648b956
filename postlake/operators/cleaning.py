"""Queries over the text functions: cleaning, normalisation, tokens and dictionary lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import indic as I
from postlake.functions import lexicon as L
from postlake.functions import text as X
from postlake.plans.posts import CTE, TPL_CTE, N, posts, q


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet")


def _on(table, key, col, name, f, where=None):
    def run(s, d):
        df = s.read.parquet(f"{d}/{table}.parquet")
        out = df.select(key, f(F.col(col)).alias(name))
        return out.where(where) if where is not None else out

    return run


def _post(name, f):
    return lambda s, d: posts(s, d).select("post_id", f(F.col("text")).alias(name))


QUERIES: dict = {}
ORACLE: dict = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


LIST = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
DW = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

add("clean_nfkd", _on("documents", "doc_id", "text", "folded", X.nfkd_unescape))
add("clean_unescape", _on("pages", "page_id", "html", "text", X.unescape_common), "SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS text FROM pages")
_SARC = "(" + " OR ".join(f"contains(lower({{t}}), {q(k)})" for k in L.SARCASM_KEYWORDS) + ") AND regexp_matches({t}, " + q("(?i)" + "|".join(L.SARCASM_PATTERNS)) + ")"
add("clean_sarcasm_flag", lambda s, d: posts(s, d).select("post_id", X.sarcasm_flag(F.col("text")).alias("flag")), f"WITH {CTE} SELECT post_id, {_SARC.format(t='text')} AS flag FROM posts")
add(
    "clean_sarcasm_tag",
    lambda s, d: posts(s, d).select("post_id", F.when(X.sarcasm_flag(F.col("text")), X.mark_sarcasm(F.col("text"))).otherwise(F.col("text")).alias("text")),
    f"WITH {CTE} SELECT post_id, CASE WHEN {_SARC.format(t='text')} THEN regexp_replace(text, {q(L.SARCASM_TAG)}, ' _sarcasm_tag_ ', 'g') ELSE text END AS text FROM posts",
)
add(
    "clean_hashtag_split",
    lambda s, d: posts(s, d)
    .select("post_id", F.explode(F.regexp_extract_all("text", F.lit("#([A-Za-z0-9_]+)"), 1)).alias("tag"))
    .select("post_id", "tag", F.trim(X.split_hashtags(F.concat(F.lit("#"), F.col("tag")))).alias("words")),
    f"WITH {CTE}, t AS (SELECT post_id, unnest(regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1)) AS tag FROM posts) SELECT post_id, tag, lower(replace(regexp_replace(tag, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')) AS words FROM t",
)
add("clean_strip_html", _on("pages", "page_id", "html", "text", X.strip_html), "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
_URL = "CASE WHEN contains({t}, 'http') OR contains({t}, 'www.') THEN regexp_replace({t}, '(?i)https?://[^ \\t\\n\\x0B\\f\\r]+|www\\.[^ \\t\\n\\x0B\\f\\r]+', ' ', 'g') ELSE {t} END"
#: Unicode white space, as the Java side takes it.
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_URL_U = "CASE WHEN contains({t}, 'http') OR contains({t}, 'www.') THEN regexp_replace({t}, '(?i)https?://[^" + _WS.replace("{", "{{").replace("}", "}}") + "]+|www\\.[^" + _WS.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g') ELSE {t} END"
add("clean_strip_url", _on("pages", "page_id", "html", "text", X.strip_url), f"SELECT page_id, {_URL.format(t='html')} AS text FROM pages")
add("clean_strip_mention", _on("documents", "doc_id", "text", "text", X.strip_mention), r"SELECT doc_id, regexp_replace(text, '@[\p{L}\p{N}_]+', ' ', 'g') AS text FROM documents")
add(
    "clean_elongation",
    _on("documents", "doc_id", "text", "text", X.collapse),
    r"""WITH c AS (SELECT doc_id, i, substr(text, i, 1) AS ch FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS grp FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ch, grp ORDER BY i) AS k FROM g)
SELECT d.doc_id, coalesce(x.t, '') AS text FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(ch, '' ORDER BY i) AS t FROM r WHERE k <= 2 OR ch IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY doc_id) x ON x.doc_id = d.doc_id""",
)
add(
    "clean_text",
    lambda s, d: _docs(s, d).select("doc_id", X.squash(X.strip_mention(X.strip_url(X.strip_html(F.col("text"))))).alias("text")),
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(" + _URL_U.format(t="regexp_replace(text, '<[^>]+>', ' ', 'g')") + rf", '@[\p{{L}}\p{{N}}_]+', ' ', 'g'), '[{_WS}]+', ' ', 'g'), ' ') AS text FROM documents",
)
add("indic_detect", _on("documents", "doc_id", "text", "indic", X.indic_detect), "SELECT doc_id, regexp_matches(text, '[ऀ-ॿ]') AS indic FROM documents")
_emoji_tbl = ", ".join(f"({q(e)}, {w})" for e, (w, *_) in L.EMOJI.items())
_emoji_alt = q("|".join(L.EMOJI_LONGEST))
add(
    "emoji_polarity",
    lambda s, d: posts(s, d).select("post_id", F.round(X.emoji_polarity(F.col("text")), 6).alias("polarity")),
    f"WITH {CTE}, em(e, w) AS (VALUES {_emoji_tbl}), m AS (SELECT post_id, unnest(regexp_extract_all(text, {_emoji_alt})) AS e FROM posts) SELECT p.post_id, round(coalesce(CAST(x.w AS DOUBLE), 0), 6) AS polarity FROM posts p LEFT JOIN (SELECT post_id, sum(CAST(w AS DOUBLE)) AS w FROM m JOIN em USING (e) GROUP BY 1) x ON x.post_id = p.post_id",
)
_mean = "text"
for _e in L.EMOJI_LONGEST:
    _mean = f"replace({_mean}, {q(_e)}, {q(' ' + L.EMOJI[_e][2] + ' ')})"
add("emoji_meaning", _post("text", X.emoji_meaning), f"WITH {TPL_CTE}, m AS (SELECT tpl_id, {_mean} AS text FROM tpl) SELECT CAST(event_id AS BIGINT) AS post_id, m.text FROM events JOIN m ON event_id % {N} = m.tpl_id")
_slang_single = ", ".join(f"({q(t)}, {w})" for t, (w, _) in L.SLANG.items() if " " not in t)
_slang_phrase = ", ".join(f"({q(t)}, {w})" for t, (w, _) in L.SLANG.items() if " " in t)
_SINGLE = {t: x for t, x in L.SLANG.items() if " " not in t}
_PHRASE = {t: x for t, x in L.SLANG.items() if " " in t}
add(
    "slang_token_polarity",
    lambda s, d: _docs(s, d).select("doc_id", F.round(X.slang_polarity(F.col("text"), _SINGLE), 6).alias("polarity")),
    f"WITH sl(t, w) AS (VALUES {_slang_single}), k AS (SELECT doc_id, unnest({DW.format('text')}) AS t FROM documents) SELECT d.doc_id, round(coalesce(x.w, 0), 6) AS polarity FROM documents d LEFT JOIN (SELECT doc_id, sum(CAST(w AS DOUBLE)) AS w FROM k JOIN sl USING (t) GROUP BY 1) x ON x.doc_id = d.doc_id",
)
add(
    "slang_phrase_polarity",
    lambda s, d: posts(s, d).select("post_id", F.round(X.slang_polarity(F.col("text"), _PHRASE), 6).alias("polarity")),
    f"WITH {CTE}, sl(t, w) AS (VALUES {_slang_phrase}) SELECT p.post_id, round(coalesce(x.w, 0), 6) AS polarity FROM posts p LEFT JOIN (SELECT post_id, sum(CAST(w AS DOUBLE)) AS w FROM posts JOIN sl ON contains(' ' || array_to_string({DW.format('text')}, ' ') || ' ', ' ' || t || ' ') GROUP BY 1) x ON x.post_id = p.post_id",
)
_con = "text"
for _a, _b in L.CONTRACTIONS.items():
    _con = f"regexp_replace({_con}, {q('(?i)' + chr(92) + 'b' + _a + chr(92) + 'b')}, {q(_b)}, 'g')"
add("expand_contractions", _post("text", X.expand_contractions), f"WITH {TPL_CTE}, m AS (SELECT tpl_id, {_con} AS text FROM tpl) SELECT CAST(event_id AS BIGINT) AS post_id, m.text FROM events JOIN m ON event_id % {N} = m.tpl_id")
_NEG, _STOP = LIST(L.NEGATION_WORDS), LIST(L.SCOPE_BREAKERS)
add(
    "negation_scope",
    lambda s, d: posts(s, d).select("post_id", X.negation_scope(F.col("text")).alias("text")),
    rf"""WITH RECURSIVE {TPL_CTE},
t AS (SELECT tpl_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b]') AS toks FROM tpl),
st(tpl_id, i, out, remaining) AS (
  SELECT tpl_id, 0, CAST([] AS VARCHAR[]), 0 FROM t
  UNION ALL
  SELECT s.tpl_id, s.i + 1,
    list_append(s.out, CASE WHEN s.remaining > 0 AND NOT list_contains({_NEG}, lower(t.toks[s.i + 1])) AND NOT list_contains({_STOP}, lower(t.toks[s.i + 1]))
      AND regexp_full_match(t.toks[s.i + 1], '[\p{{L}}\p{{N}}]+') THEN 'not_' || t.toks[s.i + 1] ELSE t.toks[s.i + 1] END),
    CASE WHEN list_contains({_NEG}, lower(t.toks[s.i + 1])) THEN 3 WHEN list_contains({_STOP}, lower(t.toks[s.i + 1])) THEN 0
      WHEN s.remaining > 0 AND regexp_full_match(t.toks[s.i + 1], '[\p{{L}}\p{{N}}]+') THEN s.remaining - 1 ELSE s.remaining END
  FROM st s JOIN t ON t.tpl_id = s.tpl_id WHERE s.i < len(t.toks)),
done AS (SELECT t.tpl_id, CASE WHEN len(list_filter(t.toks, lambda x: list_contains({_NEG}, lower(x)))) > 0
  THEN regexp_replace(array_to_string(s.out, ' '), '\s+([^\p{{L}}\p{{N}}_\s])', '\1', 'g') ELSE t.text END AS text
  FROM st s JOIN t ON t.tpl_id = s.tpl_id AND s.i = len(t.toks))
SELECT CAST(e.event_id AS BIGINT) AS post_id, d.text FROM events e JOIN done d ON e.event_id % {N} = d.tpl_id""",
)
add("normalize_text", lambda s, d: X.normalised(posts(s, d).select("post_id", X.nfkd_unescape(F.col("text")).alias("raw")), "raw", "text").select("post_id", "text"))
add(
    "composite_polarity",
    lambda s, d: posts(s, d).select("post_id", F.round(X.emoji_polarity(F.col("text")) + X.slang_polarity(F.col("text"), _SINGLE), 6).alias("polarity")),
    f"WITH {CTE}, em(e, w) AS (VALUES {_emoji_tbl}), sl(t, w) AS (VALUES {_slang_single}), m AS (SELECT post_id, unnest(regexp_extract_all(text, {_emoji_alt})) AS e FROM posts), k AS (SELECT post_id, unnest({DW.format('text')}) AS t FROM posts), a AS (SELECT post_id, CAST(w AS DOUBLE) AS w FROM m JOIN em USING (e) UNION ALL SELECT post_id, CAST(w AS DOUBLE) FROM k JOIN sl USING (t)) SELECT p.post_id, round(coalesce(x.w, 0), 6) AS polarity FROM posts p LEFT JOIN (SELECT post_id, sum(w) AS w FROM a GROUP BY 1) x ON x.post_id = p.post_id",
)
# tokens
_TOK = r"regexp_extract_all({t}, '[\x{{0900}}-\x{{097f}}]+|[\p{{L}}\p{{N}}_]+')"
#: A character goes if it equals the two before it; line ends stay.
_KEEP = "NOT (i > 2 AND x = cs[i - 1] AND x = cs[i - 2] AND NOT list_contains([chr(10), chr(13), chr(133), chr(8232), chr(8233)], x))"
add(
    "tokenize_terms",
    lambda s, d: posts(s, d).select("post_id", F.explode(X.model_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    f"WITH {TPL_CTE}, c AS (SELECT tpl_id, string_split(lower(text), '') AS cs FROM tpl), l AS (SELECT tpl_id, array_to_string(list_filter(cs, lambda x, i: {_KEEP}), '') AS t FROM c), u AS (SELECT event_id % {N} AS tpl_id, count(*) AS uses FROM events GROUP BY 1), "
    f"k AS (SELECT tpl_id, unnest({_TOK.format(t='t')}) AS token FROM l) SELECT token, CAST(sum(uses) AS BIGINT) AS n FROM k JOIN u USING (tpl_id) GROUP BY 1",
)
add(
    "word_bigrams",
    lambda s, d: X.pairs(_docs(s, d).select(F.regexp_extract_all(F.lower("text"), F.lit(f"{X.WORD}+"), 0).alias("w")), "w").groupBy("a", "b").agg(F.count("*").alias("n")).select(F.concat("a", F.lit("_"), "b").alias("bigram"), "n").groupBy("bigram").agg(F.sum("n").alias("n")),
    f"WITH w AS (SELECT {DW.format('text')} AS w FROM documents), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS bigram FROM w) SELECT bigram, count(*) AS n FROM b GROUP BY 1",
)
add(
    "char_trigrams",
    lambda s, d: _docs(s, d).select(F.explode(X.trigrams(F.regexp_extract_all(F.lower("text"), F.lit(f"{X.WORD}+"), 0))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")),
    f"WITH w AS (SELECT unnest({DW.format('text')}) AS w FROM documents), f AS (SELECT w FROM w WHERE length(w) BETWEEN 4 AND 10 AND NOT starts_with(w, '_')), g AS (SELECT unnest(list_transform(range(1, length(w) - 1), lambda i: '#' || substr(w, i, 3) || '#')) AS gram FROM f) SELECT gram, count(*) AS n FROM g GROUP BY 1",
)
_EDGE = r"regexp_replace(regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])(but|however|although|though|yet|while|on[ \t\n]+the[ \t\n]+other[ \t\n]+hand)(?:$|[^\p{{L}}\p{{N}}_])', '\1|', 'g'), '[.,;!?\n|]', '|', 'g')"
add(
    "clause_split",
    lambda s, d: posts(s, d)
    .select("post_id", F.posexplode(F.filter(F.transform(X.clauses(F.col("text")), lambda c: F.trim(c)), lambda c: c != "")).alias("pos", "clause"))
    .select("post_id", F.col("pos").cast("bigint").alias("pos"), "clause"),
    f"WITH {CTE}, c AS (SELECT post_id, list_filter(list_transform(string_split({_EDGE.format(t='lower(text)')}, '|'), lambda x: trim(x)), lambda x: x <> '') AS cs FROM posts) SELECT post_id, CAST(i - 1 AS BIGINT) AS pos, cs[i] AS clause FROM (SELECT post_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)",
)
# lookups
add(
    "join_slang_broadcast",
    lambda s, d: (
        _docs(s, d)
        .select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"{X.WORD}+"), 0)).alias("term"))
        .join(F.broadcast(s.createDataFrame([(t, w) for t, (w, _) in _SINGLE.items()], "term string, weight double")), "term")
        .groupBy("doc_id", "term", "weight")
        .agg(F.count("*").alias("n"))
    ),
    f"WITH sl(term, w) AS (VALUES {_slang_single}), k AS (SELECT doc_id, unnest({DW.format('text')}) AS term FROM documents) SELECT doc_id, term, CAST(w AS DOUBLE) AS weight, count(*) AS n FROM k JOIN sl USING (term) GROUP BY ALL",
)
add(
    "join_phrase_contains",
    lambda s, d: (
        posts(s, d)
        .select("post_id", F.explode(F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(p)), F.lit(p)) for p in L.SLANG]), lambda x: x.isNotNull())).alias("phrase"))
    ),
    f"WITH {CTE}, sl(phrase, w) AS (VALUES {_slang_single}, {_slang_phrase}) SELECT post_id, phrase FROM posts JOIN sl ON contains(lower(text), phrase)",
)
_GUARD = ["not", "no", "cannot", "far from", "nothing"]
add(
    "semi_guard",
    lambda s, d: _docs(s, d).where(F.exists(F.array(*map(F.lit, _GUARD)), lambda k: F.contains(F.lower("text"), k))).select("doc_id"),
    "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), {q(g)})" for g in _GUARD),
)
add(
    "anti_stopwords",
    lambda s, d: (
        _docs(s, d)
        .select(F.explode(F.array_except(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0), F.array(*map(F.lit, L.STOPWORDS)))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("docs"))
    ),
    f"WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents) SELECT word, count(*) AS docs FROM k WHERE NOT list_contains({LIST(L.STOPWORDS)}, word) GROUP BY 1",
)
add(
    "lexicon_overlap",
    lambda s, d: posts(s, d).select(
        "post_id",
        F.size(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+"), 0), F.array(*map(F.lit, L.VERIFY_POSITIVE)))).cast("bigint").alias("pos"),
        F.size(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_']+"), 0), F.array(*map(F.lit, L.VERIFY_NEGATIVE)))).cast("bigint").alias("neg"),
    ),
    rf"WITH {CTE}, w AS (SELECT post_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+')) AS w FROM posts) SELECT post_id, CAST(len(list_intersect(w, {LIST(L.VERIFY_POSITIVE)})) AS BIGINT) AS pos, CAST(len(list_intersect(w, {LIST(L.VERIFY_NEGATIVE)})) AS BIGINT) AS neg FROM w",
)
add(
    "dict_profile",
    lambda s, d: s.createDataFrame(
        [("slang_phrases", len(_PHRASE)), ("slang_words", len(_SINGLE)), ("emoji", len(L.EMOJI)), ("negation", len(L.NEGATION_WORDS)), ("contractions", len(L.CONTRACTIONS))], "dictionary string, terms bigint"
    ),
    f"SELECT * FROM (VALUES ('slang_phrases', {len(_PHRASE)}::BIGINT), ('slang_words', {len(_SINGLE)}::BIGINT), ('emoji', {len(L.EMOJI)}::BIGINT), ('negation', {len(L.NEGATION_WORDS)}::BIGINT), ('contractions', {len(L.CONTRACTIONS)}::BIGINT)) t(dictionary, terms)",
)
add("indic_phrase_score", lambda s, d: posts(s, d).where(X.indic_detect(F.col("text"))).select("post_id", F.round(I.phrases(F.col("text"))["score"], 6).alias("score")))
add("indic_negation", lambda s, d: I.normalised(posts(s, d).where(X.indic_detect(F.col("text"))), "text").select("post_id", "text", F.round("indic_polarity", 6).alias("polarity")))
_HASH = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|[0-9]|[^A-Za-z0-9_]|$)|[0-9]+"
add("hashtag_words", lambda s, d: posts(s, d).select("post_id", F.explode(F.regexp_extract_all("text", F.lit("#([A-Za-z0-9_]+)"), 1)).alias("tag")).select("post_id", F.array_join(F.regexp_extract_all("tag", F.lit(_HASH), 0), " ").alias("words")))
