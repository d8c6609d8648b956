"""Queries run over their whole table, held against plain Python on small tables."""

import re
from collections import Counter
from math import log

from postlake.plans import registry


def run(spark, folder, name, **tables):
    """Rows of a query over tables given as (rows, schema)."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
    return sorted((tuple(r) for r in registry.queries()[name](spark, str(folder)).collect()), key=str)


def test_zip_lines_of_all_documents(spark, tmp_path):
    texts = [(i, f"A{i}\n\nB{i}" if i % 2 else f"One{i}") for i in range(12)] + [(12, None), (13, "")]
    want = [(i, k, x, x.lower()) for i, t in texts if t is not None for k, x in enumerate(t.split("\n"))]
    assert run(spark, tmp_path, "zip_lines_join", documents=(texts, "doc_id bigint, text string")) == sorted(want, key=str)


EVENTS = "event_id bigint, user_id bigint, ts timestamp"


def test_request_takes_all_posts(spark, tmp_path):
    got = run(spark, tmp_path, "request_explode", events=([(i, i % 4, None) for i in range(40)], EVENTS))
    assert sorted(r[:3] for r in got) == sorted((i % 4, i // 4, i) for i in range(40))


def plain_words(text):
    return re.findall(r"[\u0900-\u097F]+|\w+", re.sub(r"(.)\1{2,}", r"\1\1", text.lower()))


def test_tokens_of_elongated_posts(spark, tmp_path):
    from postlake.functions import text as X
    from postlake.plans.posts import N, TEMPLATES

    got = run(spark, tmp_path, "tokenize_terms", events=([(i, 0, None) for i in range(N + 10)], EVENTS))
    want = Counter(w for i in range(N + 10) for w in plain_words(TEMPLATES[i % N][0]))
    assert dict(got) == want and want["soo"] == 1 and want["slaps"] == 1
    mixed = spark.createDataFrame([("Ooo SoOoO AAAa",)], "text string")
    assert mixed.select(X.model_tokens(mixed["text"])).first()[0] == plain_words("Ooo SoOoO AAAa") == ["oo", "soo", "aa"]


def test_clean_text_of_all_documents(spark, tmp_path):
    def clean(t):
        t = re.sub("<[^>]+>", " ", t)
        if "http" in t or "www." in t:
            t = re.sub(r"(?i)https?://\S+|www\.\S+", " ", t)
        return re.sub(r"\s+", " ", re.sub(r"@\w+", " ", t)).strip(" ")

    texts = ["plain <b>x</b>", "Größe <i>é</i>  @müller www.straße.de/ü  東京", "\u00a0Zoë\u2003https://x.org/é 🔥 ", "ॲप @दोस्त", "www.a.b\u00a0stays", "", None]
    rows = list(enumerate(texts))
    want = [(i, None if t is None else clean(t)) for i, t in rows]
    assert run(spark, tmp_path, "clean_text", documents=(rows, "doc_id bigint, text string")) == sorted(want, key=str)


def test_vocabulary_has_all_features_up_to_40000(spark, tmp_path):
    texts = ["Goooood _app_ tea" if i % 2 else " ".join(f"w{k}" for k in range(i * 450, i * 450 + 900)) for i in range(110)] + ["खूप छान"] * 2
    df, words = Counter(), {}
    for i, t in enumerate(texts):
        w = words[i] = plain_words(t)
        w += [f"{a}_{b}" for a, b in zip(w, w[1:])] + [f"#{x[k:k + 3]}#" for x in w if 4 <= len(x) <= 10 and not x.startswith("_") for k in range(len(x) - 2)]
        df.update(set(w))
    want = {t: n for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:40000] if n >= 2}
    schema = "doc_id bigint, text string"
    got = run(spark, tmp_path, "vocab_topk", documents=(list(enumerate(texts)), schema))
    assert dict(got) == want and {"good", "good__app_", "#goo#", "खूप_छान"} <= set(want)
    idf = {t: round(log((1 + len(texts)) / (1 + n)) + 1, 6) for t, n in want.items()}
    assert dict(run(spark, tmp_path, "idf_weights")) == idf
    tf = Counter(t for w in words.values() for t in w if t in want)
    assert {t: n for t, n, _ in run(spark, tmp_path, "join_vocab_weights")} == tf
    from postlake.operators.model import vocabulary

    many = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(30000)))], schema)
    assert vocabulary(many).count() == 40000


def test_meanings_and_contractions_of_all_posts(spark, tmp_path):
    from postlake.plans.posts import N

    rows = 2 * N + 20
    got = run(spark, tmp_path, "emoji_meaning", events=([(i, 0, None) for i in range(rows)], EVENTS))
    assert sorted(r[0] for r in got) == list(range(rows)) and dict(got)[21] == dict(got)[21 + N] and "🎉" not in dict(got)[21]
    more = dict(run(spark, tmp_path, "expand_contractions"))
    assert sorted(more) == list(range(rows)) and more[4] == more[4 + N] and "can't" not in more[4]
