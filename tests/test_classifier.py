"""Classifier, its saved form, the whole scoring path, sinks and requests against plain Python or by hand."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.operators import classifier as C
from postlake.operators import model as M
from postlake.sources import sinks

GOOD, BAD = ["love this great app", "great support, love it", "what a great day"], ["terrible crash again", "worst app, terrible", "crash and worst support"]
ROWS = [(i, t, "positive") for i, t in enumerate(GOOD)] + [(i + 10, t, "negative") for i, t in enumerate(BAD)]


@pytest.fixture(scope="module")
def model(spark):
    return C.fit(spark.createDataFrame([*ROWS, (20, None, "negative"), (21, "no label", None), (None, "no id", "positive")], "doc_id int, text string, label string"))


def plain_probabilities(text, model):
    """From the description: collapsed lower-case words, bigrams, trigrams, sublinear tf x idf, unit length, softmax."""
    words = re.findall(r"[ऀ-ॿ]+|\w+", re.sub(r"(.)\1{2,}", r"\1\1", (text or "").lower()))
    tf = Counter(words + [f"{a}_{b}" for a, b in zip(words, words[1:])] + [f"#{w[i:i + 3]}#" for w in words if 4 <= len(w) <= 10 and w[0] != "_" for i in range(len(w) - 2)])
    idf = dict(zip(model.tokens, model.idf))
    v = {t: (1 + math.log(n)) * idf[t] for t, n in tf.items() if t in idf}
    length = math.sqrt(sum(x * x for x in v.values()))
    at = {t: i for i, t in enumerate(model.tokens)}
    z = [b + sum(x / length * model.weights[at[t], k] for t, x in v.items()) for k, b in enumerate(model.bias)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_features_equal_the_columns(spark):
    texts = ["Soooo good_day _under word", "छान ॲप abcdefghijk abcd", "", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(M.X.model_tokens(F.col("t")).alias("w"), M.features(F.col("t")).alias("f"))
    assert all(sorted(C.features_of(r.w)) == sorted(r.f) for r in df.collect())


def test_probabilities(spark, model):
    texts = ["love the great app", "worst crash", "unknown zzz", "", None, "greaaaat app app app"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.probabilities(F.col("t"), model).alias("p")).collect()]
    assert model.classes == ("negative", "positive")
    assert np.allclose(got, [plain_probabilities(t, model) for t in texts], atol=1e-9)
    assert got[0][1] > 0.5 and got[1][0] > 0.5


def test_scores_with_a_model(spark, model):
    from postlake.functions import rules, text
    from postlake.operators import scoring

    texts = ["I love this GREAT app #SoGood", "worst crash, never again", "खूप छान ॲप", "&lt;b&gt; terrible &amp; slow", "the app is slow but support is great", "let him cook", "", None, "greaaaat 🎉 app, the server is down"]
    df = spark.createDataFrame([(i, t, "major outage" if i == 0 else None) for i, t in enumerate(texts)], "i int, text string, context string")
    got = {r.i: r for r in scoring.score_posts(df, model=model).collect()}
    plain = text.normalised(df.select("i", text.nfkd_unescape(F.coalesce("text", F.lit(""))).alias("t")), "t")
    norm = {r.i: r.normalised for r in plain.collect()}
    assert {i: r.normalised for i, r in got.items()} == norm
    base = {}
    for i, t in norm.items():
        p = plain_probabilities(t, model)
        base[i] = (model.classes[int(np.argmax(p))], float(max(p)), p)
    frame = spark.createDataFrame([(i, t, "major outage" if i == 0 else None, base[i][0], base[i][1]) for i, t in enumerate(texts)], "i int, text string, context string, base_label string, base_conf double")
    for want in rules.decide(frame).collect():
        r = got[want.i]
        assert (r.base_label, r.final_label) == (want.base_label, want.final_label)
        assert r.reason == want.reason or (want.reason == "model_inference" and r.reason == "sarcasm_detected")
        assert abs(r.final_conf - want.final_conf) < 1e-9
        if r.final_label == r.base_label:
            assert np.allclose([r.p_negative, r.p_positive, r.p_neutral], [*base[want.i][2], 0.0], atol=1e-9)
    assert got[4].final_label == "mixed" and got[4].aspect_performance == "negative" and got[4].aspect_customer_support == "positive" and got[4].is_mixed
    assert got[7].final_label == got[6].final_label


def test_saved_model(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    back = C.load(spark, str(tmp_path / "m"))
    assert (back.classes, back.tokens) == (model.classes, model.tokens)
    assert np.allclose(back.weights, model.weights, atol=1.01e-4) and np.allclose(back.idf, model.idf, atol=1e-4) and np.allclose(back.bias, model.bias)


def test_small_fits(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string, label string")
    assert C.fit(frame([])).classes == () and C.fit(frame([(1, "a b", "x")])).weights.shape == (3, 1)
    lean = C.fit(frame([*ROWS, (30, "", "other")]), balanced=True)
    p = frame([(1, "", "")]).select(C.probabilities(F.col("text"), lean).alias("p")).first().p
    assert lean.classes == ("negative", "other", "positive") and p[1] < 1e-6


def test_held_out(spark):
    rows = [(i, f"{(GOOD if i % 2 else BAD)[i % 3]} {i}", "p" if i % 2 else "n") for i in range(60)]
    got = {r["class"]: r for r in C.held_out_metrics(spark.createDataFrame(rows, "doc_id int, text string, label string"), "label").collect()}
    assert got[None].n == sum(r.n for k, r in got.items() if k) and got[None].accuracy == 1.0


def test_fold_mixed(spark):
    df = spark.createDataFrame([("mixed", "negative"), ("positive", "negative")], "f string, b string")
    assert [r[0] for r in df.select(C.fold_mixed(F.col("f"), F.col("b"))).collect()] == ["negative", "positive"]


def test_feedback_queue(spark, tmp_path):
    x = spark.createDataFrame([("a", "neutral", 0.5, "model_inference", True), ("b", "positive", 0.9, "r", False)], "text string, final_label string, final_conf double, reason string, fallback_required boolean")
    path = str(tmp_path / "q")
    sinks.append_feedback(x, path)
    sinks.append_feedback(x, path, resolved=x.where("text = 'a'"))
    (tmp_path / "q" / "bad.json").write_text("{broken\n[1]\n")
    got = sinks.read_feedback(spark, path).collect()
    assert sorted((r.text, r.kind) for r in got) == [("a", "fallback_resolved"), ("a", "low_confidence"), ("a", "low_confidence")]
    assert len(sinks.read_feedback(spark, path, last=1).collect()) == 1 and got[0]["at"] >= got[-1]["at"]


def test_splits_json_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val"), (3, "train")], "id int, split string")
    sinks.write_splits(df, str(tmp_path / "s"))
    assert {(r.id, r.split) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(1, "train"), (2, "val"), (3, "train")}
    sinks.write_json(df, str(tmp_path / "j"), target=2)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_report({"all": df.agg(F.count("*").alias("n")), "none": df.where("id > 9").select("id")}, str(tmp_path / "r"))
    assert {r.part: json.loads(r.rows) for r in spark.read.json(str(tmp_path / "r")).collect()} == {"all": [{"n": 3}], "none": []}


def test_requests(spark):
    schema = "request int, posts array<struct<text:string,context:string>>, texts array<string>"
    df = spark.createDataFrame([(1, [("a", "c")], ["x"]), (2, None, ["x", None]), (3, None, None), (4, [], ["x"])], schema)
    got = sorted(map(tuple, sinks.requests(df).collect()), key=str)
    assert got == [(1, 200, 0, "a", "c"), (2, 200, 0, "x", None), (2, 200, 1, None, None), (3, 400, None, None, None), (4, 200, None, None, None)]


def test_files_with_a_model(spark, tmp_path):
    """The model's label and probabilities reach the files; a file without text keeps its fixed ones."""
    from postlake.operators.media import analyze_files

    for name, text in (("a.txt", "the ledger window opens at noon"), ("b.txt", "the parcel window opens at noon"), ("c.txt", "")):
        (tmp_path / name).write_text(text)
    small = C.SoftmaxModel(("negative", "neutral", "positive"), ("ledger", "parcel"), np.ones(2), np.array([[3.0, 0.0, 0.0], [0.0, 0.0, 3.0]]), np.zeros(3))
    got = {r.path.rsplit("/", 1)[-1]: r for r in analyze_files(spark, str(tmp_path), model=small).collect()}
    high = math.exp(3) / (math.exp(3) + 2)
    for name, label in (("a.txt", "negative"), ("b.txt", "positive")):
        assert got[name].label == label and got[name].reason == "model_inference"
        assert got[name][f"p_{label}"] == round(high, 4)
    assert (got["c.txt"].label, got["c.txt"].confidence, got["c.txt"].has_text) == ("neutral", 0.5, False)
