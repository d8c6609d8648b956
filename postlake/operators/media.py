"""Topic categories, tags, media types, pixel signatures and file analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import aspects as AS
from postlake.functions import lexicon as L
from postlake.functions.text import contains_any, guarded, held, let, needed
from postlake.operators.classifier import SoftmaxModel
from postlake.operators.once import once
from postlake.plans.posts import CTE, posts, q
from postlake.sources import files, images

QUERIES: dict = {}
ORACLE: dict = {}


def add(name, f, sql=None):
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


# Categories with keywords and weights, in order of preference at ties.
CATEGORIES = {
    "Meme / Social Humor": (1.2, ["meme", "memes", "cooked", "bro cooked", "who let him cook", "aura", "infinite aura", "ratio", "skill issue", "demure", "brainrot", "gigachad", "wojak", "no cap", "ong", "fr fr", "💀", "😭", "😂", "🤣", "lmao", "lol", "peak", "tood kam", "nadach khula", "wa re wa", "banger"]),
    "Finance & Payment Issue": (1.4, ["payment", "payment failed", "transaction failed", "money debited", "refund", "transaction", "deducted", "paise cut", "paise fukat", "paise doob", "billing", "invoice", "receipt", "overcharged", "subscription", "bank", "wallet", "upi", "card", "paisa vasool", "पैसे कट", "लूट लिया", "बुडवले", "scam", "confirm payment", "upi pin", "bank server"]),
    "Tech & Software Bugs": (1.2, ["technical issue", "technical", "issue", "issues", "problem", "problems", "defect", "crash", "crashed", "crashing", "bug", "bugs", "glitch", "freeze", "hang", "restart", "restarting", "lag", "latency", "memory leak", "timeout", "timed out", "error", "exception", "nullpointer", "stack trace", "watt laga", "band padto", "chalat nahi", "काम नहीं करता", "अटक", "हँग", "क्रैश", "connection pool", "500 internal", "database", "not working", "failed"]),
    "Customer Support & Service": (1.2, ["customer support", "customer care", "helpdesk", "support team", "ticket", "complaint", "service", "agent", "executive", "no response", "ignored", "hold time", "call center", "ghatiya service", "worst service", "काही मदत नाही", "सर्व्हिस"]),
    "Product & E-Commerce Review": (1.1, ["review", "rating", "build quality", "battery", "camera", "display", "unboxing", "delivery", "product", "packaging", "worth buying", "recommend", "order", "flipkart", "amazon", "ek number", "lai bhari", "khup chhan", "chhan", "mast", "badhiya", "घटिया", "खूप छान", "snappy", "super snappy", "flawless", "smooth", "loved the", "love the", "best app", "chef's kiss"]),
    "Entertainment & Media": (1.1, ["movie", "song", "trailer", "teaser", "music", "album", "gaming", "gameplay", "actor", "actress", "cinema", "theatre", "netflix", "youtube", "cricket", "match", "गाणं", "चित्रपट"]),
    "News & Corporate Announcement": (1.3, ["press release", "quarterly", "financial statements", "scheduled maintenance", "policy", "official notice", "announcement", "board of directors", "investor relations", "मौसम", "शासनाने", "नियमावली", "प्रसिद्ध करण्यात", "post-mortem"]),
}
PRAISE = r"\b(snappy|super snappy|flawless|smooth|loved the|love the|best app|chef's kiss|full paisa vasool|paisa vasool|ek number|10/10|ultra smooth)\b"
# Words that choose the subcategory: (words, then, otherwise).
SUBCATEGORIES = {
    "Meme / Social Humor": (["meme", "cooked", "aura", "ratio"], "Viral Internet Meme", "Humorous Reaction"),
    "Finance & Payment Issue": (["debit", "failed", "deduct", "cut", "technical issue"], "UPI & Payment Gateway Failure", "Pricing & Invoice"),
    "Tech & Software Bugs": (["crash", "leak", "restart", "500"], "Crash & Stability", "Functional Defect"),
    "Customer Support & Service": (["worst", "ghatiya", "rude", "no response"], "Escalated Grievance", "General Inquiry"),
    "Product & E-Commerce Review": (["best", "paisa vasool", "recommend", "chhan", "mast", "snappy", "loved"], "Positive Endorsement", "Critique"),
    "Entertainment & Media": (["song", "गाणं"], "Music & Audio", "Pop Culture & Gaming"),
    "News & Corporate Announcement": (["press release", "शासनाने", "post-mortem"], "Official Statement", "General Notice"),
}
# Tag rules, in order.
TAG_RULES = [
    (r"\b(payment\s*failed|payment\s*issue|transaction\s*failed|money\s*debited|paise\s*cut|पैसे\s*कट)\b", "#payment_failed"),
    (r"\b(refund|debited|deducted|payment|transaction|upi|bank\s*server)\b", "#payment_issue"),
    (r"\b(technical\s*issue|technical\s*error|technical\s*problem)\b", "#technical_issue"),
    (r"\b(paisa\s*vasool|worth\s*every\s*penny|value\s*for\s*money)\b", "#value_for_money"),
    (r"\b(paise\s*fukat|paise\s*barbad|waste\s*of\s*money|scam|fraud)\b", "#money_wasted"),
    (r"\b(crash|crashed|crashing|freeze|restart|stuck|hang|हँग|क्रैश)\b", "#app_crash"),
    (r"\b(bug|bugs|glitch|error|exception|stack\s*trace)\b", "#bug_report"),
    (r"\b(memory\s*leak|outage|downtime|timeout|500\s*error|connection\s*pool)\b", "#system_failure"),
    (r"\b(ui|ux|interface|design|dark\s*mode|animation|look\s*wise|दिसायला|दिसण्यात)\b", "#ui_ux"),
    (r"\b(slow|lag|latency|battery|draining|heating|गरम|स्लो)\b", "#performance_issue"),
    (r"\b(snappy|smooth|fast|fluid|zero\s*lag)\b", "#high_performance"),
    (r"\b(customer\s*support|support\s*team|helpdesk|call\s*center|agent|executive)\b", "#customer_support"),
    (r"\b(worst\s*service|ghatiya|rude|no\s*response|ignored|ticket)\b", "#support_grievance"),
    (r"\b(cooked|who\s*let\s*him\s*cook|bro\s*cooked|never\s*cook)\b", "#meme_cooked"),
    (r"\b(aura|infinite\s*aura|aura\s*-1000)\b", "#aura_score"),
    (r"\b(ratio|skill\s*issue|demure|brainrot|gigachad)\b", "#viral_meme"),
    (r"\b(lai\s*bhari|ek\s*number|khup\s*chhan|bhaari|nadach\s*khula|tood\s*kam)\b", "#marathi_praise"),
    (r"\b(mast|badhiya|gazab|kamaal|ekdum\s*mast|कतई\s*जहर)\b", "#hindi_praise"),
    (r"\b(masterpiece|chef'?s\s*kiss|recommend|flawless|top\s*tier)\b", "#recommendation"),
]


#: Word edges between letters, digits and underscores of any script.
EDGE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")

#: Words that categories and tag rules look for.
WORDS = [*(k for _, kws in CATEGORIES.values() for k in kws), *needed(PRAISE), *(w for p, _ in TAG_RULES for w in needed(p[2:-2]))]


def category_scores(text: Column) -> Column:
    """Map-free: array of (category, score) in order, score = weight x contained keywords, +3.5 praise for reviews."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = held(low, WORDS)
    out = []
    for cat, (w, kws) in CATEGORIES.items():
        hits = F.size(F.filter(found, lambda k: k.isin(kws))) * F.lit(w)
        if cat == "Product & E-Commerce Review":
            hits = hits + F.when(guarded(low, found, PRAISE, "-i"), 3.5).otherwise(0.0)
        out.append(F.struct(F.lit(cat).alias("category"), hits.alias("score")))
    return F.array(*out)


# Words of a failed payment on the screen of a payment application.
PAYMENT_UI = ["technical issue", "failed", "support", "try again", "payment", "bank", "request"]


def categorised(df: DataFrame, text: str = "text", gateway: Column | None = None, media: Column | None = None) -> DataFrame:
    """category, subcategory, category_confidence; the first of equal scores wins.

    ``gateway`` is the payment application whose screen an image shows (null: none); with a word of a failed
    payment, or no text at all, it decides. Without text or gateway a video has a category of its own."""
    x = df.withColumn("_s", category_scores(F.col(text))).withColumn("_top", F.array_max(F.transform("_s", lambda c: c["score"]))).withColumn("_best", F.get(F.filter("_s", lambda c: c["score"] == F.col("_top")), F.lit(0)))
    x, low = x.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))), F.col("_low")
    gate = gateway if gateway is not None else F.lit(None).cast("string")
    shown = contains_any(low, PAYMENT_UI)
    kind = F.when(gate.isNotNull() & shown, "failure").when((low == "") & gate.isNotNull(), "screen").when((low == "") & (media == "video" if media is not None else F.lit(False)), "video").when(low == "", "visual").otherwise("text")
    x = x.withColumn("_gate", gate).withColumn("_kind", kind)
    k = F.col("_kind")
    sub = F.lit("Conversational Post")
    for cat, (words, yes, no) in SUBCATEGORIES.items():
        sub = F.when(F.col("category") == cat, F.when(contains_any(low, words), yes).otherwise(no)).otherwise(sub)
    x = x.withColumn("category", F.when(k.isin("failure", "screen"), "Finance & Payment Issue").when(k == "video", "Entertainment & Media").when(F.col("_top") > 0, F.col("_best.category")).otherwise("General Social"))
    x = x.withColumn("subcategory", F.when(k == "failure", F.concat(F.lit("Payment Failure ("), "_gate", F.lit(")"))).when(k == "screen", "Payment Application Screen").when(k == "video", "Video Clip").when(k == "visual", "Visual Media").otherwise(sub))
    conf = F.when(k == "failure", 0.98).when(k == "screen", 0.90).when(k.isin("video", "visual"), 0.50).when(F.col("_top") > 0, F.least(F.lit(0.99), F.round(0.70 + F.col("_top") * 0.06, 2))).otherwise(0.65)
    return x.withColumn("category_confidence", conf).drop("_s", "_top", "_best", "_low", "_gate", "_kind")


def tags(text: Column, category: Column, label: Column, gateway: Column | None = None) -> Column:
    """Hashtags, rule tags, payment, category and label tags, filled with words of the text up to eight, ordered and
    cut at ten. Null text counts as empty; an empty text has its payment, category and label tags in plain order."""
    none = F.array().cast("array<string>")
    gate = gateway if gateway is not None else F.lit(None).cast("string")
    text = F.coalesce(text, F.lit(""))
    # bound: lower would run again for every rule
    return let(F.struct(text.alias("text"), F.lower(text).alias("low"), held(F.lower(text), WORDS).alias("found")), lambda t: _tags(t["text"], t["low"], t["found"], category, label, gate, none))


def _tags(text: Column, low: Column, found: Column, category: Column, label: Column, gate: Column, none: Column) -> Column:
    own = F.filter(F.transform(F.regexp_extract_all(text, F.lit("#([a-zA-Z0-9_]+)"), 1), lambda h: F.concat(F.lit("#"), F.lower(h))), lambda h: F.char_length(h) > 2)
    ruled = F.filter(F.array(*[F.when(guarded(low, found, p[2:-2], "iu", EDGE), F.lit(t)) for p, t in TAG_RULES]), lambda t: t.isNotNull())
    brand = F.when(F.contains(gate, F.lit("PhonePe")), F.array(F.lit("#phonepe"))).when(F.contains(gate, F.lit("Paytm")), F.array(F.lit("#paytm"))).otherwise(none)
    pay = F.when(gate.isNotNull() | F.contains(category, F.lit("Payment")), F.concat(F.array(F.lit("#payment_issue"), F.lit("#upi_failure")), brand)).otherwise(none)
    slug = F.when(category != "", F.array(F.concat(F.lit("#"), F.get(F.split(F.btrim(F.regexp_replace(F.lower(category), "[^a-zA-Z0-9]", "_"), F.lit("_")), "_"), F.lit(0))))).otherwise(none)
    tone = F.when(label != "", F.array(F.concat(F.lit("#"), label))).otherwise(none)

    def ranked(fixed: Column) -> Column:
        words = F.transform(F.array_except(F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b[a-zA-Z]{4,}\b"), 0)), F.array(*map(F.lit, L.STOPWORDS))), lambda w: F.concat(F.lit("#"), w))
        room = F.greatest(F.lit(0), 8 - F.size(fixed))
        every = F.concat(fixed, F.slice(F.array_except(words, fixed), F.lit(1), room))
        order = F.array_sort(F.transform(every, lambda t: F.struct((~t.startswith("#payment_")).alias("a"), (~t.startswith("#upi_")).alias("b"), (~t.startswith("#app_")).alias("c"), F.char_length(t).alias("n"), t.alias("t"))))
        return F.slice(F.transform(order, lambda x: x["t"]), 1, 10)

    # the rules run once: the list is bound before it is used three times
    full = let(F.array_distinct(F.concat(pay, own, ruled, slug, tone)), ranked)
    return F.when(low == "", F.array_sort(F.array_distinct(F.concat(pay, slug, tone)))).otherwise(full)


# File extensions of images and videos.
IMAGES, VIDEOS = ["jpg", "jpeg", "png", "webp", "bmp", "tiff", "gif"], ["mp4", "mov", "avi", "mkv", "webm", "flv"]


def media_type(path: Column, mime: Column | None = None) -> Column:
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    m = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    return F.when(e.isin(IMAGES) | m.startswith("image/"), "image").when(e.isin(VIDEOS) | m.startswith("video/"), "video").otherwise("document")


def pixel_signature(pixels: DataFrame, by: str, times: str | None = None) -> DataFrame:
    """tone, dark mode, brightness and payment screen of images given as (image, r, g, b) rows, or as colours with
    their pixel counts in column ``times``; sums only are shuffled."""
    purple = (F.col("b") > 90) & (F.col("r") > 60) & (F.col("g") < 60) & (F.col("b") - F.col("g") > 40)
    blue = ~purple & (F.col("b") > 140) & (F.col("r") < 70) & (F.col("g") > 50)
    if times is None:
        s = pixels.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"], F.count_if(purple).alias("purple"), F.count_if(blue).alias("blue"))
    else:
        k = F.col(times)
        s = pixels.groupBy(by).agg(F.sum(k).alias("n"), *[(F.sum(F.col(c) * k) / F.sum(k)).alias(c) for c in "rgb"], F.sum(F.when(purple, k).otherwise(0)).alias("purple"), F.sum(F.when(blue, k).otherwise(0)).alias("blue"))
    light = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), 1)
    x = s.withColumn("brightness", light)
    gate = F.when(F.col("purple") / F.col("n") >= 0.04, "PhonePe / UPI Theme").when(F.col("blue") / F.col("n") >= 0.08, "Paytm / Banking Gateway")
    return x.select(by, "brightness", (F.col("brightness") < 80).alias("is_dark_mode"), F.when(F.col("brightness") > 180, "bright / vibrant").when(F.col("brightness") < 60, "dark / moody").otherwise("balanced").alias("tone"), gate.alias("gateway"))


def png_visual(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, gateway) of the PNG files below ``path``, as ``analyze_files`` takes it by ``visual``; text is empty."""
    seen = images.read_png(spark, path).where("error IS NULL")
    return pixel_signature(seen, "path", "n").select("path", F.lit("").alias("text"), "gateway")


def analyze_files(spark: SparkSession, path: str, visual: DataFrame | None = None, model: SoftmaxModel | None = None) -> DataFrame:
    """Files below ``path``: text, sentiment with aspects and probabilities, category, tags and metadata.

    Images and videos have no text of their own here. ``visual``, rows (path, text, gateway), brings what an OCR,
    speech or pixel step found for them; its paths are unique and as this function returns them. ``model`` gives
    the base labels as in ``score_posts``. A file without
    text is neutral at 0.50 with fixed probabilities. Where the base label stands with low confidence, that label
    gets the confidence and the others 0.05 each; else probabilities are the base ones."""
    from postlake.operators.scoring import base_probabilities, score_posts

    docs = files.read_files(spark, path).withColumn("context", F.lit(None).cast("string")).withColumn("media_type", media_type(F.col("path")))
    docs = docs.withColumn("text", F.when(F.col("media_type") == "document", F.col("text")).otherwise("")).withColumn("gateway", F.lit(None).cast("string"))
    if visual is not None:
        docs = docs.drop("gateway").join(visual.select("path", F.col("text").alias("_seen"), "gateway"), "path", "left")
        docs = docs.withColumn("text", F.when(F.col("media_type") == "document", F.col("text")).otherwise(F.trim(F.coalesce("_seen", F.lit("")))))
        docs = docs.withColumn("gateway", F.when(F.col("media_type") != "document", F.col("gateway"))).drop("_seen")
    x = score_posts(docs, use_aspects_in_rules=True, model=model)
    x = categorised(x, gateway=F.col("gateway"), media=F.col("media_type")).withColumn("has_text", F.col("text") != "")
    empty, low = ~F.col("has_text"), F.col("low_confidence")
    x = x.withColumn("label", F.when(empty, "neutral").otherwise(F.col("final_label"))).withColumn("confidence", F.when(empty, 0.50).otherwise(F.round("final_conf", 4))).withColumn("reason", F.when(empty, "visual_default_no_text").otherwise(F.col("reason")))
    base = base_probabilities(x)
    shares = [F.when(empty, 0.60 if k == "neutral" else 0.20).when(low, F.when(F.col("label") == k, F.col("confidence")).otherwise(0.05)).otherwise(F.round(base[k], 4)).alias(f"p_{k}") for k in L.LABELS]
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    more = F.map_concat(F.col("metadata"), F.create_map(F.lit("page_count"), F.col("page_count").cast("string")))
    return x.select(
        "path", "media_type", F.when(extension == "", F.col("media_type")).otherwise(extension).alias("file_format"), "format", "success", "error",
        "label", "confidence", "reason", *shares, *[F.when(~empty, F.col(f"aspect_{a}")).alias(f"aspect_{a}") for a in AS.NAMES],
        "category", "subcategory", "category_confidence", tags(F.col("text"), F.col("category"), F.col("label"), F.col("gateway")).alias("tags"),
        "text", "has_text", F.when(F.col("media_type") == "document", more).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


_LIST = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
_SC = ", ".join(
    f"len(list_filter({_LIST(k)}, lambda w: contains(lower(text), w))) * {w}::DOUBLE" + (f" + CASE WHEN regexp_matches(lower(text), {q(PRAISE)}) THEN 3.5 ELSE 0 END" if c.startswith("Product") else "") + f" AS c{i}" for i, (c, (w, k)) in enumerate(CATEGORIES.items())
)
_N = len(CATEGORIES)
_CAT = f"{CTE}, sc AS (SELECT post_id, text, {_SC} FROM posts), best AS (SELECT *, greatest({', '.join(f'c{i}' for i in range(_N))}) AS top FROM sc)"
add(
    "category_scores",
    lambda s, d: once(posts(s, d), ["text"], lambda x: x.withColumn("_c", category_scores(F.col("text")))).select("post_id", F.explode("_c").alias("c")).where("c.score > 0").select("post_id", "c.category", F.round("c.score", 6).alias("score")),
    f"WITH {_CAT} " + " UNION ALL ".join(f"SELECT post_id, {q(c)} AS category, round(c{i}, 6) AS score FROM best WHERE c{i} > 0" for i, c in enumerate(CATEGORIES)),
)
add(
    "category_best",
    lambda s, d: categorised(posts(s, d)).select("post_id", "category", "category_confidence"),
    f"WITH {_CAT} SELECT post_id, CASE WHEN top > 0 THEN " + "CASE " + " ".join(f"WHEN c{i} = top THEN {q(c)}" for i, c in enumerate(CATEGORIES)) + " END ELSE 'General Social' END AS category, CASE WHEN text = '' THEN 0.5 WHEN top > 0 THEN least(0.99, round(0.7 + top * 0.06, 2)) ELSE 0.65 END AS category_confidence FROM best",
)
_EDGED = lambda p: r"(?:^|[^\p{L}\p{N}_])" + p[2:-2] + r"(?:$|[^\p{L}\p{N}_])"
_RULES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {q(_EDGED(p))}) THEN {q(t)} END" for p, t in TAG_RULES) + "], lambda x: x IS NOT NULL)"
add(
    "tags_sorted",
    lambda s, d: posts(s, d).select("post_id", F.array_join(tags(F.col("text"), F.lit(""), F.col("original")), ",").alias("tags")),
    f"""WITH {CTE}, a AS (SELECT post_id, list_concat(list_filter(list_transform(regexp_extract_all(text, '#([a-zA-Z0-9_]+)', 1), lambda h: '#' || lower(h)), lambda h: length(h) > 2), {_RULES}, CASE WHEN original <> '' THEN ['#' || original] ELSE [] END) AS f0,
regexp_extract_all(lower(text), '\\b[a-zA-Z]{{4,}}\\b') AS ws FROM posts),
b AS (SELECT post_id, list_filter(f0, lambda x, i: list_position(f0, x) = i) AS f, list_transform(list_filter(ws, lambda x, i: list_position(ws, x) = i AND NOT list_contains({_LIST(L.STOPWORDS)}, x)), lambda w: '#' || w) AS w FROM a),
c AS (SELECT post_id, list_concat(f, list_slice(list_filter(w, lambda x: NOT list_contains(f, x)), 1, greatest(0, 8 - len(f)))) AS t FROM b),
u AS (SELECT post_id, unnest(t) AS tag FROM c),
r AS (SELECT post_id, tag, row_number() OVER (PARTITION BY post_id ORDER BY NOT starts_with(tag, '#payment_'), NOT starts_with(tag, '#upi_'), NOT starts_with(tag, '#app_'), length(tag), tag) AS k FROM u)
SELECT p.post_id, coalesce(string_agg(r.tag, ',' ORDER BY r.k) FILTER (r.k <= 10), '') AS tags FROM posts p LEFT JOIN r ON r.post_id = p.post_id GROUP BY 1""",
)
add(
    "media_type",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", media_type(F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ["png", "mp4", "pdf", "txt", "zip"])), (F.col("page_id") % 5 + 1).cast("int")))).alias("kind")),
    "SELECT page_id, CASE WHEN e IN ('png') THEN 'image' WHEN e IN ('mp4') THEN 'video' ELSE 'document' END AS kind FROM (SELECT page_id, (['png', 'mp4', 'pdf', 'txt', 'zip'])[page_id % 5 + 1] AS e FROM pages)",
)
add(
    "pixel_signature",
    lambda s, d: pixel_signature(s.read.parquet(f"{d}/events.parquet").select("user_id", (F.col("event_id") * 37 % 256).alias("r"), (F.col("event_id") * 91 % 256).alias("g"), (F.col("event_id") * 53 % 256).alias("b")), "user_id"),
    """WITH p AS (SELECT user_id, event_id * 37 % 256 AS r, event_id * 91 % 256 AS g, event_id * 53 % 256 AS b FROM events),
s AS (SELECT user_id, count(*) AS n, round(0.299 * avg(r) + 0.587 * avg(g) + 0.114 * avg(b), 1) AS brightness,
 count(*) FILTER (b > 90 AND r > 60 AND g < 60 AND b - g > 40) AS purple, count(*) FILTER (b > 140 AND r < 70 AND g > 50 AND NOT (b > 90 AND r > 60 AND g < 60 AND b - g > 40)) AS blue FROM p GROUP BY 1)
SELECT user_id, brightness, brightness < 80 AS is_dark_mode, CASE WHEN brightness > 180 THEN 'bright / vibrant' WHEN brightness < 60 THEN 'dark / moody' ELSE 'balanced' END AS tone,
 CASE WHEN purple / n >= 0.04 THEN 'PhonePe / UPI Theme' WHEN blue / n >= 0.08 THEN 'Paytm / Banking Gateway' END AS gateway FROM s""",
)
add(
    "doc_csv_flatten",
    lambda s, d: files.extract_documents(s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".csv")).alias("path"), F.encode(F.replace("text", F.lit('"'), F.lit(" ")), "UTF-8").alias("content"))).select("path", "success", F.element_at("metadata", "row_count").alias("rows")),
)
add(
    "doc_extract",
    lambda s, d: files.extract_documents(
        s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d/"), F.col("doc_id"), F.element_at(F.array(*map(F.lit, [".txt", ".json", ".docx", ".pdf"])), (F.col("doc_id") % 4 + 1).cast("int"))).alias("path"), F.encode("text", "UTF-8").alias("content"))
    ).groupBy("format", "success").agg(F.count("*").alias("n")),
)
add("doc_binaryfile", lambda s, d: s.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{d}").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length"))


def multimodal_analyze(s: SparkSession, d: str) -> DataFrame:
    """Documents as text files through extraction, sentiment, category and tags."""
    from postlake.operators.scoring import score_posts

    raw = s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    x = categorised(score_posts(files.extract_documents(raw).withColumn("context", F.lit(None).cast("string"))))
    return x.select("path", "final_label", "reason", "category", F.size(tags(F.col("text"), F.col("category"), F.col("final_label"))).alias("n_tags"))


add("multimodal_analyze", multimodal_analyze)
