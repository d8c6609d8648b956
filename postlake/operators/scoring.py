"""Scoring of posts: base label, aspects, the decision ladder, calibration, flags and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import aspects as AS
from postlake.functions import lexicon as L
from postlake.functions import rules as RU
from postlake.functions import text as X
from postlake.operators import classifier as CL
from postlake.operators import lru as LRU
from postlake.operators.model import _KEY, cache_key
from postlake.operators.once import once
from postlake.plans.cut import cut
from postlake.plans.posts import CTE, VALUES, N, posts, q

QUERIES: dict = {}
ORACLE: dict = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


_LIST = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"


def base_scores(df: DataFrame) -> DataFrame:
    """Base label and confidence of a fixed word list: 0.80 where one polarity leads, 0.55 otherwise."""
    low = F.lower(F.coalesce("text", F.lit("")))
    listed = [*L.VERIFY_POSITIVE, *L.VERIFY_NEGATIVE]
    both = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_']+"), 0), lambda w: w.isin(listed)))
    lead = X.let(both, lambda ws: F.size(F.filter(ws, lambda w: w.isin(L.VERIFY_POSITIVE))) - F.size(F.filter(ws, lambda w: w.isin(L.VERIFY_NEGATIVE))))
    lead = F.when(F.size(X.held(low, listed)) > 0, lead).otherwise(0)
    return df.withColumn("_lead", lead).withColumn("base_label", F.when(F.col("_lead") > 0, "positive").when(F.col("_lead") < 0, "negative").otherwise("neutral")).withColumn("base_conf", F.when(F.col("_lead") == 0, 0.55).otherwise(0.80)).drop("_lead")


def score_posts(df: DataFrame, threshold: float = 0.6, aspects: bool = True, use_aspects_in_rules: bool = False, model: CL.SoftmaxModel | None = None) -> DataFrame:
    """Posts (text, context) with label, confidence, reason, aspects, probabilities and flags.

    With a model the base label is the softmax classifier's for the normalised text, which is
    returned too; without one it comes from a fixed word list on the raw text. The ladder and
    the aspects read the raw text. One narrow pass: no shuffle, no state, so the same function
    serves batch and streaming frames. Null text counts as empty."""
    if model is None:
        x = base_scores(df)
    else:
        x = X.normalised(df.withColumn("_plain", X.nfkd_unescape(F.coalesce("text", F.lit("")))), "_plain").drop("_plain")
        x = CL.with_base(x, "normalised", model, L.LABELS)
    if aspects:
        x = AS.with_aspects(x)
    good, bad = ("n_good", "n_bad") if aspects and use_aspects_in_rules else (None, None)
    x = RU.decide(x, n_good=good, n_bad=bad)
    sarcasm = X.sarcasm_flag(F.coalesce(F.col("text"), F.lit("")))
    x = x.withColumn("fallback_required", F.col("low_confidence") | (F.col("final_conf") < threshold) | sarcasm)
    x = x.withColumn("reason", F.when(sarcasm & (F.col("reason") == "model_inference"), "sarcasm_detected").otherwise(F.col("reason")))
    return flags(calibrate(x)) if aspects else calibrate(x)


def post_model(df: DataFrame) -> CL.SoftmaxModel:
    """The classifier of posts (post_id, text, original): fitted on the normalised texts of those with a label."""
    known = df.where(F.col("original").isin(*L.LABELS)).select(F.col("post_id").alias("doc_id"), "text", F.col("original").alias("label"))
    return CL.fit(once(known, ["text"], lambda x: X.normalised(x.withColumn("_raw", X.nfkd_unescape(F.col("text"))), "_raw", "_plain").drop("_raw")).select("doc_id", F.col("_plain").alias("text"), "label"))


#: What a score depends on.
SUBJECT = ["text", "context"]


def score_once(df: DataFrame, **options) -> DataFrame:
    """``score_posts`` of a batch frame, each different post scored once and its score given to its repeats."""
    return once(df, SUBJECT, lambda x: score_posts(x, **options))


def base_probabilities(x: DataFrame) -> dict[str, Column]:
    """The classifier's (base_p columns), or without one what base_conf leaves, in equal parts."""
    return {k: F.col(f"base_p_{k}") if f"base_p_{k}" in x.columns else F.when(F.col("base_label") == k, F.col("base_conf")).otherwise((1 - F.col("base_conf")) / 2) for k in L.LABELS}


def calibrate(x: DataFrame) -> DataFrame:
    """Probabilities follow the final label only where it differs from the base label; elsewhere they are the base ones."""
    c = F.col("final_conf")
    base = base_probabilities(x)
    changed = F.col("final_label") != F.col("base_label")
    lab = F.col("final_label")

    def prob(k: str) -> Column:
        other = {"positive": {"negative": 0.75, "neutral": 0.25}, "negative": {"positive": 0.75, "neutral": 0.25}, "neutral": {"positive": 0.5, "negative": 0.5}}
        e = F.when(lab == "mixed", F.lit(0.10 if k == "neutral" else 0.45))
        for label, shares in other.items():
            e = e.when(lab == label, F.bround(c if label == k else (1.0 - c) * shares[k], 4))
        return F.when(changed, e).otherwise(base[k])

    for k in L.LABELS:
        x = x.withColumn(f"p_{k}", prob(k))
    return x


# Reasons that make a negative post a risk.
RISK = ["cultural_disaster_metaphor", "emoji_dissonance_sarcasm", "corporate_doublespeak_detected", "rhetorical_mockery_detected", "conditional_trap_sarcasm", "faux_gratitude_sarcasm"]


def flags(x: DataFrame) -> DataFrame:
    perf, support = (F.coalesce(F.col(f"aspect_{a}") == "negative", F.lit(False)) for a in ("performance", "customer_support"))
    return (
        x.withColumn("is_performance_issue", perf)
        .withColumn("is_risk_complaint", (F.col("final_label") == "negative") & (perf | support | F.col("reason").isin(RISK)))
        .withColumn("is_mixed", (F.col("final_label") == "mixed") | ((F.col("n_good") > 0) & (F.col("n_bad") > 0)))
    )


_WS = r"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_'']+'))"
_BASE = f"""tpl(tpl_id, text, context) AS (VALUES {VALUES}),
lead AS (SELECT *, len(list_intersect({_WS}, {_LIST(L.VERIFY_POSITIVE)})) - len(list_intersect({_WS}, {_LIST(L.VERIFY_NEGATIVE)})) AS d FROM tpl),
b AS (SELECT *, {RU.subject_sql()}, CASE WHEN d > 0 THEN 'positive' WHEN d < 0 THEN 'negative' ELSE 'neutral' END AS base_label, CASE WHEN d = 0 THEN 0.55::DOUBLE ELSE 0.8::DOUBLE END AS base_conf FROM lead),
scored AS ({RU.ladder_sql('b').replace("n_good > 0 AND n_bad > 0", "false")}),
posts AS (SELECT CAST(event_id AS BIGINT) AS post_id, s.*, (['positive', 'negative', 'neutral', ''])[event_id % 7 % 4 + 1] AS original FROM events JOIN scored s ON event_id % {N} = s.tpl_id)"""


def plain(s: SparkSession, d: str) -> DataFrame:
    """Posts through base scores and the ladder, without aspects."""
    return once(posts(s, d), SUBJECT, lambda x: RU.decide(base_scores(x)))


add("rule_ladder", lambda s, d: plain(s, d).select("post_id", "base_label", "final_label", "final_conf", "low_confidence", "reason"), f"WITH {_BASE} SELECT post_id, base_label, final_label, final_conf, low_confidence, reason FROM posts")
_GROUPS = {
    "rule_context_sarcasm": ["context_mismatch_sarcasm", "context_reinforced_negative", "context_aligned_praise"],
    "rule_single_word": ["single_word_reaction_praise", "single_word_reaction_criticism"],
    "rule_meme": ["meme_mockery_cooked", "meme_praise_cooked", "meme_loss_of_aura", "meme_gain_of_aura", "meme_skill_issue", "meme_this_aint_it", "meme_demure_aesthetic"],
    "rule_bait_switch": ["reverse_bait_and_switch_detected"],
    "rule_litotes": ["litotes_positive_detected", "litotes_negative_detected"],
    "rule_emoji_dissonance": ["emoji_dissonance_sarcasm"],
    "rule_doublespeak": ["corporate_doublespeak_detected"],
    "rule_mockery": ["rhetorical_mockery_detected"],
    "rule_punchline": ["sarcastic_irony_detected"],
    "rule_adv_sarcasm": ["conditional_trap_sarcasm", "faux_gratitude_sarcasm", "passive_aggressive_praise", "rhetorical_imagine_derision"],
    "rule_indic": ["indic_sarcastic_praise", "indic_backhanded_compliment", "cynical_conditional_irony", "indic_faux_gratitude", "indic_rhetorical_mockery", "indic_slang_inversion_praise"],
    "rule_slang_inversion": ["slang_inversion_praise"],
    "rule_contronym": ["contronym_negative_detected"],
    "rule_contrastive": ["contrastive_clause_mixed"],
    "rule_trope": ["cultural_disaster_metaphor", "cultural_triumph_metaphor"],
    "rule_news_neutral": ["objective_news_or_listing"],
}
for _name, _reasons in _GROUPS.items():
    add(
        _name,
        lambda s, d, r=_reasons: plain(s, d).where(F.col("reason").isin(r)).select("post_id", "final_label", "final_conf", "reason"),
        f"WITH {_BASE} SELECT post_id, final_label, final_conf, reason FROM posts WHERE reason IN (" + ", ".join(q(x) for x in _reasons) + ")",
    )
def scored_posts(s: SparkSession, d: str) -> DataFrame:
    """All posts through the whole path: normalisation, classifier, ladder, aspects, probabilities and flags."""
    x = posts(s, d)
    out = score_once(x, model=post_model(x))
    return out.select("post_id", "normalised", "base_label", "final_label", "final_conf", "reason", *[f"p_{k}" for k in L.LABELS], *[f"aspect_{a}" for a in AS.NAMES], "fallback_required", "is_risk_complaint", "is_mixed")


add("score_posts", scored_posts)
add("rule_aspect_unanimous", lambda s, d: score_once(posts(s, d), use_aspects_in_rules=True).where(F.col("reason").startswith("unanimous")).select("post_id", "final_label", "final_conf", "reason"))
add("rule_ladder_aspects", lambda s, d: score_once(posts(s, d), use_aspects_in_rules=True).select("post_id", "final_label", "final_conf", "reason", *[f"aspect_{a}" for a in AS.NAMES]))
add("fallback_flag", lambda s, d: score_once(posts(s, d), aspects=False).select("post_id", "fallback_required"), f"WITH {_BASE} SELECT post_id, low_confidence OR final_conf < 0.6 OR ((" + " OR ".join(f"contains(low, {q(k)})" for k in L.SARCASM_KEYWORDS) + ") AND regexp_matches(raw, " + q("(?i)" + "|".join(L.SARCASM_PATTERNS)) + ")) AS fallback_required FROM posts")
_P = lambda k: (
    f"CASE WHEN final_label = base_label THEN CASE WHEN base_label = '{k}' THEN base_conf ELSE (1 - base_conf) / 2 END WHEN final_label = 'mixed' THEN {0.10 if k == 'neutral' else 0.45} "
    f"WHEN final_label = '{k}' THEN round_even(final_conf, 4) WHEN final_label = 'neutral' THEN round_even((1 - final_conf) * 0.5, 4) ELSE round_even((1 - final_conf) * {0.25 if k == 'neutral' else 0.75}, 4) END AS p_{k}"
)
add("calibrate_probs", lambda s, d: calibrate(plain(s, d)).select("post_id", *[f"p_{k}" for k in L.LABELS]), f"WITH {_BASE} SELECT post_id, {', '.join(_P(k) for k in L.LABELS)} FROM posts")
add("alert_flags", lambda s, d: score_once(posts(s, d), use_aspects_in_rules=True).select("post_id", "is_performance_issue", "is_risk_complaint", "is_mixed"))
# Words of the offline fallback; single letters are substrings too.
_FB_POS, _FB_NEG = ["fire", "goated", "love", "amazing", "w", "huge w", "banger"], ["cooked", "trash", "l", "huge l", "scam", "worst", "terrible", "mid"]
add(
    "fallback_heuristic",
    lambda s, d: posts(s, d).select("post_id", F.when(F.lower("text").rlike("|".join(_FB_POS)), "positive").when(F.lower("text").rlike("|".join(_FB_NEG)), "negative").otherwise("neutral").alias("label")).withColumn("confidence", F.when(F.col("label") == "neutral", 0.70).otherwise(0.85)),
    f"WITH {CTE}, l AS (SELECT post_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in _FB_POS) + " THEN 'positive' WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in _FB_NEG) + " THEN 'negative' ELSE 'neutral' END AS label FROM posts) SELECT post_id, label, CAST(CASE WHEN label = 'neutral' THEN 0.7 ELSE 0.85 END AS DOUBLE) AS confidence FROM l",
)
# aspects
def _mentions(a: str) -> str:
    ks = AS.A.ASPECTS[a]
    latin, other = "|".join(k for k in ks if k.isascii()), "|".join(k for k in ks if not k.isascii())
    edge = r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_\x{0900}-\x{097f}]"
    return " OR ".join(f"regexp_matches(clause, {q(f'(?i)(?:^|{e})(?:{k})(?:$|{e})')})" for e, k in zip(edge, (latin, other), strict=True))


_CL = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(text), '(^|[^\p{L}\p{N}_])(but|however|although|though|yet|while)(?:$|[^\p{L}\p{N}_])', '\1|', 'g'), '[.,;!?\n|]', '|', 'g'), '|'), lambda x: x), lambda x: true)"
add(
    "aspect_mentions",
    lambda s, d: (
        posts(s, d).select("post_id", F.explode(X.clauses(F.col("text"))).alias("clause"))
        .select("post_id", F.explode(F.filter(F.array(*[F.when(F.col("clause").rlike(AS.keyword_pattern(a)), F.lit(a)) for a in AS.NAMES]), lambda x: x.isNotNull())).alias("aspect"))
        .groupBy("aspect").agg(F.count("*").alias("clauses"), F.count_distinct("post_id").alias("posts"))
    ),
    f"WITH {CTE}, c AS (SELECT post_id, unnest({_CL}) AS clause FROM posts), m AS (" + " UNION ALL ".join(f"SELECT post_id, {q(a)} AS aspect FROM c WHERE " + _mentions(a) + " " for a in AS.NAMES) + ") SELECT aspect, count(*) AS clauses, count(DISTINCT post_id) AS posts FROM m GROUP BY 1",
)
_SIG = lambda xs: f"CAST(len(list_intersect(ws, {_LIST([x for x in xs if ' ' not in x])})) + 2 * len(list_filter({_LIST([x for x in xs if ' ' in x])}, lambda p: contains(clause, p))) AS BIGINT)"
add(
    "aspect_signal_scores",
    lambda s, d: (
        posts(s, d).select("post_id", F.explode(X.clauses(F.col("text"))).alias("clause")).where(F.trim("clause") != "")
        .select("post_id", F.trim("clause").alias("clause"), AS.clause_scores(F.col("clause"))[0].cast("bigint").alias("pos"), AS.clause_scores(F.col("clause"))[1].cast("bigint").alias("neg"))
    ),
    f"WITH {CTE}, c AS (SELECT post_id, unnest({_CL}) AS clause FROM posts), w AS (SELECT post_id, clause, list_distinct(regexp_extract_all(clause, '[\\x{{0900}}-\\x{{097f}}]+|[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)?')) AS ws FROM c WHERE trim(clause) <> '') SELECT post_id, trim(clause) AS clause, {_SIG(AS.A.POSITIVE)} AS pos, {_SIG(AS.A.NEGATIVE)} AS neg FROM w",
)
add("absa_reversal_flag", lambda s, d: posts(s, d).select("post_id", AS.reversal(F.col("text")).alias("flag")), f"WITH {CTE} SELECT post_id, regexp_matches(lower(text), {q(AS.REVERSAL.replace('(?<!not' + chr(92) + 's)(?<!not' + chr(92) + 'sa' + chr(92) + 's)', ''))}) AS flag FROM posts")
_LONG = lambda s, d: once(posts(s, d), ["text"], AS.with_aspects).select("post_id", F.explode(F.filter(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"aspect_{a}").alias("polarity")) for a in AS.NAMES]), lambda x: x["polarity"].isNotNull())).alias("x")).select("post_id", "x.*")
add("aspect_polarity", _LONG)
add("aspect_counts", lambda s, d: _LONG(s, d).groupBy("aspect").agg(F.count("*").alias("n")))
add("aspect_polarity_pivot", lambda s, d: _LONG(s, d).groupBy("aspect").pivot("polarity", ["negative", "neutral", "positive"]).agg(F.count(F.lit(1))).na.fill(0))
# reports
add("reason_topk", lambda s, d: plain(s, d).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10), f"WITH {_BASE} SELECT reason, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
add("final_distribution", lambda s, d: plain(s, d).groupBy("final_label").agg(F.count("*").alias("n")), f"WITH {_BASE} SELECT final_label, count(*) AS n FROM posts GROUP BY 1")
add(
    "sample_refined",
    lambda s, d: plain(s, d).where((F.char_length("text") > 25) & (F.col("final_label") != F.col("original")) & F.col("original").isin(*L.LABELS)).orderBy("post_id").limit(15).select("post_id", F.substring("text", 1, 150).alias("text"), F.upper("final_label").alias("label")),
    f"WITH {_BASE} SELECT post_id, substr(text, 1, 150) AS text, upper(final_label) AS label FROM posts WHERE length(text) > 25 AND final_label <> original AND original IN ('negative', 'neutral', 'positive') ORDER BY post_id LIMIT 15",
)
add("sample_mixed", lambda s, d: plain(s, d).where("final_label = 'mixed'").orderBy("post_id").limit(10).select("post_id", "text"), f"WITH {_BASE} SELECT post_id, text FROM posts WHERE final_label = 'mixed' ORDER BY post_id LIMIT 10")
add(
    "thread_rules",
    lambda s, d: RU.decide(base_scores(_threads(s, d))).groupBy("role", "final_label", "reason").agg(F.count("*").alias("n")),
    f"""WITH thr AS (SELECT c.role, coalesce(c.text, '') AS text, p.text AS context FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1),
{_BASE[_BASE.index("lead AS"):_BASE.index(",\nposts AS")].replace("FROM tpl", "FROM thr")}
SELECT role, final_label, reason, count(*) AS n FROM scored GROUP BY ALL""",
)


def _threads(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/conversations.parquet")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return c.join(p, ["conv_id", "turn"], "left")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: all posts through aspects, ladder, calibration and flags, counted by label and reason."""
    return score_once(posts(spark, sf_dir), use_aspects_in_rules=True).groupBy("final_label", "reason").agg(F.count("*").alias("n"), F.count_if("is_risk_complaint").alias("risks"))


def metrics(scored: DataFrame, request: str = "request", latency: str = "latency_ms", key: str | None = None, capacity: int = 10_000) -> DataFrame:
    """One row of service figures from scored rows (fallback_required, the number of their request and its latency):
    requests, posts, fallbacks, their percentage, mean latency of a request.

    With ``key``, the column of the posts' cache keys, also those of a cache of ``capacity`` entries that all requests use in
    the order of their numbers, which are not null: its entries at the end, capacity, hits, misses and hit rate; and the posts
    that wait for a label: every fallback that the cache did not answer is queued for one. A request looks up all its posts
    before it stores any answer, so its posts of one key all hit or all miss. Without ``key`` no post is answered by a cache, and
    all fallbacks wait. Rows are summed up by request (and key) before anything else moves; an empty frame gives zeros."""
    by = [request] if key is None else [request, key]
    each = scored.groupBy(*by).agg(F.count("*").alias("posts"), F.count_if("fallback_required").alias("fallbacks"), F.max(latency).alias("ms"))
    if key is not None:
        first = cut(scored.groupBy(F.col(key).alias("_key")).agg(F.min(request).alias("_first")))
        if first.count() <= capacity:  # nothing is ever put out: what was used before is there
            seen = each.join(F.broadcast(first), F.col(key).eqNullSafe(F.col("_key")))
            hit, fresh = F.col(request) > F.col("_first"), F.col(request) == F.col("_first")
        else:
            seen = LRU.reuse_distances(each, by, key)
            hit, fresh = F.coalesce(F.col("others") < capacity, F.lit(False)), F.col("others").isNull()
        each = seen.groupBy(request).agg(
            F.sum("posts").alias("posts"),
            F.sum("fallbacks").alias("fallbacks"),
            F.max("ms").alias("ms"),
            F.sum(F.when(hit, F.col("posts")).otherwise(0)).alias("hits"),
            F.sum(F.when(hit, 0).otherwise(F.col("fallbacks"))).alias("queued"),
            F.count_if(fresh).alias("fresh"),
        )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rate = lambda part, n: F.when(n > 0, F.round(part * 100.0 / n, 2)).otherwise(0.0)
    n, f = total("posts"), total("fallbacks")
    figures = [
        F.count("*").alias("total_requests"),
        n.alias("total_posts_analyzed"),
        f.alias("total_fallbacks_triggered"),
        rate(f, n).alias("fallback_rate_pct"),
        # the first rounding drops what the order of the sum leaves
        F.coalesce(F.round(F.round(F.avg("ms"), 9), 3), F.lit(0.0)).alias("avg_latency_ms"),
    ]
    if key is not None:
        hits = total("hits")
        figures += [
            F.least(total("fresh"), F.lit(capacity).cast("long")).alias("cache_entries"),
            F.lit(capacity).cast("long").alias("cache_max_size"),
            hits.alias("cache_hits"),
            (n - hits).alias("cache_misses"),
            rate(hits, n).alias("cache_hit_rate_pct"),
            total("queued").alias("active_learning_queued"),
        ]
    return each.agg(*figures)


def _metrics(s: SparkSession, d: str) -> DataFrame:
    """Requests of 25 posts in the order of their numbers; a request lasts as long as its slowest event."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("long").alias("post_id"), F.col("value").alias("latency_ms"), F.expr("event_id div 25").alias("request"))
    scored = score_once(posts(s, d), aspects=False).select("post_id", "fallback_required", cache_key(F.col("text"), F.col("context")).alias("key"))
    return metrics(scored.join(e, "post_id"), key="key")


add(
    "scoring_metrics",
    _metrics,
    ORACLE["fallback_flag"].replace("SELECT post_id, low_confidence", f", f AS (SELECT post_id, {_KEY} AS key, low_confidence", 1)
    + """), u AS (SELECT event_id // 25 AS request, key, count(*) AS posts, count(*) FILTER (fallback_required) AS fallbacks, max(value) AS ms FROM f JOIN events ON event_id = post_id GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (ORDER BY request, key) AS i FROM u),
y AS (SELECT *, lag(i) OVER (PARTITION BY key ORDER BY i) AS last, coalesce(lead(i) OVER (PARTITION BY key ORDER BY i), 1e15::BIGINT) AS next FROM x),
o AS (SELECT a.i, count(b.i) AS others FROM y a LEFT JOIN y b ON b.i > a.last AND b.i < a.i AND b.next > a.i WHERE a.last IS NOT NULL GROUP BY a.i),
r AS (SELECT request, sum(posts) AS posts, sum(fallbacks) AS fallbacks, max(ms) AS ms, sum(CASE WHEN others < 10000 THEN posts ELSE 0 END) AS hits, sum(CASE WHEN others < 10000 THEN 0 ELSE fallbacks END) AS queued, count(*) FILTER (others IS NULL) AS fresh FROM y LEFT JOIN o USING (i) GROUP BY 1)
SELECT count(*) AS total_requests, CAST(sum(posts) AS BIGINT) AS total_posts_analyzed, CAST(sum(fallbacks) AS BIGINT) AS total_fallbacks_triggered, round(sum(fallbacks) * 100.0 / sum(posts), 2) AS fallback_rate_pct, round(avg(ms), 3) AS avg_latency_ms,
CAST(least(sum(fresh), 10000) AS BIGINT) AS cache_entries, 10000::BIGINT AS cache_max_size, CAST(sum(hits) AS BIGINT) AS cache_hits, CAST(sum(posts) - sum(hits) AS BIGINT) AS cache_misses, round(sum(hits) * 100.0 / sum(posts), 2) AS cache_hit_rate_pct, CAST(sum(queued) AS BIGINT) AS active_learning_queued FROM r""",
)
