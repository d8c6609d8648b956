"""Order-dependent text functions, aspects, rules, readers and streams against plain Python or hand-made results."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from postlake.functions import aspect_data as A
from postlake.functions import aspects, rules
from postlake.functions import text as X
from postlake.operators.media import analyze_files
from postlake.operators.model import lru_hits
from postlake.operators.scoring import base_scores, score_posts
from postlake.plans.posts import TEMPLATES, templates
from postlake.streaming import windows


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("not good at all, really", "not not_good not_at not_all, really"),
        ("we never ever had fun. so good", "we never not_ever not_had not_fun. so good"),
        ("no way but fine", "no not_way but fine"),
        ("all fine here", "all fine here"),
        ("", ""),
    ],
)
def test_negation_scope(spark, text, want):
    assert one(spark, X.negation_scope, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("#BestDay_ever now", "best day ever now"), ("<b>Hi</b> @bob see http://x.y/z", "Hi see"), ("sooooo coooool!!!!", "soo cool!!"), ("yeah right /s", "yeah right _sarcasm_tag_"), ("HTTP://X.Y stays", "HTTP://X.Y stays")],
)
def test_clean(spark, text, want):
    assert one(spark, X.clean, text) == want


def test_normalise(spark):
    df = spark.createDataFrame([("It's sooo lit 🔥, NOT bad",), (None,), (" ",)], "t string")
    assert [r.x for r in X.normalised(df, "t", "x").collect()] == ["it is soo exciting fire awesome amazing, not not_bad", "", ""]


def plain_aspects(text):
    """Aspect polarity of one Latin text, written from the description."""
    low = text.lower()
    if not any(k in low for ks in A.ASPECTS.values() for k in ks):
        return {}
    turn = re.search(aspects.REVERSAL, low) is not None
    parts = re.split(r"[.,;!?\n।|]|\b(?:but|however|although|though|yet|while|on\s+the\s+other\s+hand)\b", low)
    out = {}
    for name, ks in A.ASPECTS.items():
        edge = "[\\w\u0900-\u097F]"
        own = [c for c in parts if any(re.search(rf"\b{re.escape(k)}\b" if k.isascii() else f"(?<!{edge}){k}(?!{edge})", c) for k in ks)]
        if not own:
            continue
        p = g = 0
        for c in own:
            w = set(re.findall("[\u0900-\u097F]+|\\b\\w+(?:-\\w+)?\\b", c))
            p += sum(2 if " " in s and s in c else (s in w) for s in A.POSITIVE)
            g += sum(2 if " " in s and s in c else (s in w) for s in A.NEGATIVE)
            if re.search(aspects.NOT_GOOD, c):
                g += 2
            if re.search(aspects.NOT_BAD, c):
                p += 1
            if re.search(aspects.REPAIRED, c):
                p, g = p + 3, max(0, g - 3)
        d = (p - g) * (-1 if turn else 1)
        out[name] = "positive" if d > 0 else "negative" if d < 0 else ("negative" if turn else "neutral")
    return out


def test_aspects_against_plain_fold(spark):
    got = {r.tpl_id: {a: r[f"aspect_{a}"] for a in aspects.NAMES if r[f"aspect_{a}"]} for r in aspects.with_aspects(templates(spark)).collect()}
    assert got == {i: plain_aspects(t) for i, (t, _) in enumerate(TEMPLATES)}


@pytest.mark.parametrize(
    ("text", "context", "label", "reason"),
    [
        ("brilliant", "the outage lasted hours", "negative", "context_mismatch_sarcasm"),
        ("so proud", "zero downtime again", "positive", "context_aligned_praise"),
        ("#peak!!", None, "positive", "single_word_reaction_praise"),
        ("ratio", " ", "negative", "single_word_reaction_criticism"),
        ("let them cook", None, "positive", "meme_praise_cooked"),
        ("who let him cook", None, "negative", "meme_mockery_cooked"),
        ("is magic", None, "neutral", "model_inference"),
        ("not a dumpster fire", None, "positive", "litotes_positive_detected"),
        ("wasn't dumpster fire stuff", None, "neutral", "model_inference"),
        ("The camera is great but the delay is bad", None, "mixed", "contrastive_clause_mixed"),
        (None, None, "neutral", "model_inference"),
        ("terrible release, the worst of all", "Deploy failed and the incident is open", "negative", "context_reinforced_negative"),
        ("let him cook, the new search is nice", None, "positive", "meme_praise_cooked"),
        ("never let him cook again", None, "negative", "meme_mockery_cooked"),
        ("shoutout to the infra crew for deleting staging", None, "negative", "passive_aggressive_praise"),
        ("look wise it is clean, only issue is that login is useless", None, "negative", "indic_backhanded_compliment"),
        ("best app ever if you love losing files", None, "negative", "cynical_conditional_irony"),
        ("धन्यवाद, माझा फोन हँग झाला", None, "negative", "indic_faux_gratitude"),
        ("developers sleeping on the job again", None, "negative", "indic_rhetorical_mockery"),
        ("Loved the wait, said no one ever", None, "negative", "sarcastic_irony_detected"),
        ("that is not a lie", None, "neutral", "model_inference"),
        ("fully expected a disaster but it turned out clean and I love it", None, "positive", "reverse_bait_and_switch_detected"),
        ("a dumpster fire", None, "negative", "cultural_disaster_metaphor"),
        ("not a mona lisa", None, "neutral", "model_inference"),
    ],
)
def test_ladder(spark, text, context, label, reason):
    df = base_scores(spark.createDataFrame([(text, context)], "text string, context string"))
    r = rules.decide(df).first()
    assert (r.final_label, r.reason) == (label, reason)


def test_every_rule_has_reason_and_sql():
    ids = [r[0] for r in rules.LADDER]
    assert len(ids) == len(set(ids)) == 37
    assert all(c.sql() and why for _, c, _, _, why in rules.LADDER)


def test_every_reason_occurs_in_the_templates(spark):
    df = base_scores(templates(spark))
    seen = {r.reason for r in rules.decide(df).collect()} | {r.reason for r in score_posts(templates(spark), use_aspects_in_rules=True).collect()}
    assert {why for *_, why in rules.LADDER} - seen - {"unanimous_positive_aspects", "unanimous_negative_aspects"} == set()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("खूप छान ॲप", "extremely good fantastic wonderful ॲप"),
        ("#छान", "# great wonderful clean"),
        ("it slaps hard", "it is great hard"),
        ("no cap it works", "truthfully it works"),
        ("yeah right and/so on /s", "yeah right and/so on _sarcasm_tag_"),
        ("plain text", "plain text"),
    ],
)
def test_normalise_whole_chain(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert X.normalised(df, "t", "x").first().x == want


def test_emoji_names(spark):
    assert one(spark, lambda c: X.emoji_meaning(c, "token"), "so 🔥") == "so  _emoji_fire_ "


def test_score_posts_flags_and_empty(spark):
    x = score_posts(spark.createDataFrame([("Checkout is slow and support ghosted me", None)], "text string, context string")).first()
    assert x.is_performance_issue and x.is_risk_complaint and x.final_label == "negative"
    empty = spark.createDataFrame([], "text string, context string")
    assert score_posts(empty).count() == 0


def test_lru_equals_a_replay(spark):
    from collections import OrderedDict

    acc = [(u, i, "abcdefg"[(i * i + u) % 7]) for u in range(3) for i in range(40)]
    want = {}
    for u in range(3):
        cache = OrderedDict()
        for _, i, k in (a for a in acc if a[0] == u):
            want[u, i] = k in cache
            cache[k] = 1
            cache.move_to_end(k)
            if len(cache) > 3:
                cache.popitem(last=False)
    got = {(r.u, r.i): r.hit for r in lru_hits(spark.createDataFrame(acc, "u int, i int, k string").withColumnRenamed("i", "o"), "u", "o", "k", 3).withColumnRenamed("o", "i").collect()}
    assert got == want


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("x, ,y\n\n é,zz\n".encode("cp1252"))
    (tmp_path / "b.json").write_text(json.dumps({"k": ["long text", "no", {"z": "deep one"}]}))
    (tmp_path / "c.txt").write_text("  the app is slow and support is terrible  ")
    (tmp_path / "d.pdf").write_bytes(b"not a pdf")
    (tmp_path / "e.txt").write_text("")
    buf = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "f.docx").write_bytes(buf.getvalue())
    from postlake.sources.files import read_files

    got = {r.path.rsplit("/", 1)[-1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"].text == "x | y\né | zz" and got["a.csv"].metadata == {"row_count": "2"}
    assert got["b.json"].text == "long text\ndeep one"
    assert got["f.docx"].text == "Hello\na | b" and not got["d.pdf"].success and got["d.pdf"].error
    an = {r.path.rsplit("/", 1)[-1]: r for r in analyze_files(spark, str(tmp_path)).collect()}
    assert an["c.txt"].label == "negative" and an["e.txt"].reason == "visual_default_no_text" and an["c.txt"].media_type == "document"


def test_stream_equals_batch(spark, tmp_path):
    from postlake.plans.posts import posts

    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    events.repartition(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    p = posts(spark, "/root/testdata/sf0.001").select("post_id", "text", "context")
    p.repartition(1).write.mode("overwrite").parquet(str(tmp_path / "posts"))
    s = spark.readStream.schema(p.schema).parquet(str(tmp_path / "posts"))
    q = windows.score_stream(s).select("post_id", "final_label", "reason").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, score_posts(p).select("post_id", "final_label", "reason").collect()))


def test_indic(spark):
    from postlake.functions import indic as I

    df = spark.createDataFrame([(t,) for t in ("ॲप चांगला नाही", "बग्स मिटले é_", "पैसा वसूल ॲप", "plain", None, "नाही", "छान कचरा")], "t string")
    got = [(r.text, round(r.indic_polarity, 3)) for r in I.normalised(df, "t").collect()]
    assert got == [
        ("ॲप not_good fine nice reliable terrible bad", -2.0), ("fixed resolved clean no bugs", 1.8),
        ("worth every penny full value for money great ॲप", 2.5), ("plain", 0.0), ("", 0.0), ("not", 0.0),
        ("great wonderful clean garbage trash bloatware rubbish", -0.4),
    ]


def test_analysis_of_images_and_videos(spark, tmp_path):
    for name in ("a.png", "b.mp4", "c.jpg", "d.gif", "e.txt"):
        (tmp_path / name).write_bytes(b"\x89 failed payment" if name != "e.txt" else b"plain words")
    seen = [("a.png", "Payment failed, try again", "PhonePe / UPI Theme"), ("c.jpg", None, "Paytm / Banking Gateway"), ("e.txt", "not read", "x")]
    root = analyze_files(spark, str(tmp_path)).first().path.rsplit("/", 1)[0]
    plain = {r.path.rsplit("/", 1)[-1]: r for r in analyze_files(spark, str(tmp_path)).collect()}
    got = {r.path.rsplit("/", 1)[-1]: r for r in analyze_files(spark, str(tmp_path), spark.createDataFrame([(f"{root}/{n}", t, g) for n, t, g in seen], "path string, text string, gateway string")).collect()}
    assert [plain[n].has_text for n in ("a.png", "b.mp4", "e.txt")] == [False, False, True] and plain["e.txt"].metadata == {"char_count": "11", "page_count": "1"}
    r = plain["b.mp4"]
    assert (r.label, r.confidence, r.p_negative, r.p_neutral, r.p_positive, r.category, r.subcategory, r.tags) == ("neutral", 0.5, 0.2, 0.6, 0.2, "Entertainment & Media", "Video Clip", ["#entertainment", "#neutral"])
    assert plain["d.gif"].subcategory == "Visual Media" and plain["d.gif"].tags == ["#general", "#neutral"] and plain["d.gif"].file_format == "gif"
    r = got["a.png"]
    assert (r.has_text, r.category, r.subcategory, r.category_confidence) == (True, "Finance & Payment Issue", "Payment Failure (PhonePe / UPI Theme)", 0.98)
    assert {"#payment_issue", "#upi_failure", "#phonepe", "#payment_failed"} <= set(r.tags)
    r = got["c.jpg"]
    assert (r.has_text, r.subcategory, r.category_confidence, r.tags) == (False, "Payment Application Screen", 0.9, ["#finance", "#neutral", "#payment_issue", "#paytm", "#upi_failure"])
    r = got["e.txt"]
    assert r.text == "plain words" and "#payment_issue" not in r.tags and r.reason == "model_inference" and (r.confidence, r.p_neutral, r.p_negative) == (0.55, 0.55, 0.05)
