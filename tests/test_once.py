"""Work done once for equal posts, and text vectors made inside tasks, against the row-wise forms."""

from pyspark.sql import functions as F

from postlake.operators import model as M
from postlake.operators import once as O
from postlake.operators import scoring as S


def test_each_different_row_is_worked_once_and_all_rows_stay(spark, monkeypatch):
    rows = [(1, "a", None), (2, "a", None), (3, "a", "c"), (4, None, "c"), (5, None, "c"), (6, None, None), (6, "", None)] * 3
    df = spark.createDataFrame(rows, "id int, text string, context string").repartition(4)
    for bound in (1 << 20, 0):  # broadcast and shuffled
        monkeypatch.setattr(O, "BROADCAST_BYTES", bound)
        # the number of a row of the reduced frame tells how often the work ran
        got = O.once(df, ["text", "context"], lambda x: x.withColumn("w", F.monotonically_increasing_id())).collect()
        assert sorted((r.id, r.text or "-", r.context) for r in got if r.context is None) == sorted((i, t or "-", c) for i, t, c in rows if c is None)
        assert len(got) == len(rows) and len({r.w for r in got}) == 5


def test_scores_of_repeats_are_those_of_every_row(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("The app is slow", None), (None, None), ("", "Deploy failed"), ("The app is slow", "Deploy failed")] * 2)], "id int, text string, context string")
    want = S.score_posts(df, use_aspects_in_rules=True)
    got = S.score_once(df, use_aspects_in_rules=True).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_vectors_of_texts_need_no_shuffle_and_equal_counted_terms(spark):
    texts = ["a b a_b a b", "The cat sat, the CAT", "सगळे बग्स मिटले _under naïve", None, "", "x" * 12, "abcd abcd abcde", "a _b a_ b"]
    docs = spark.createDataFrame([*[(i, t) for i, t in enumerate(texts)], (1, "the dog"), (None, "cat sat"), (None, "cat")], "doc_id int, text string")
    df = {r.token: r.df for r in M.doc_frequency(docs).collect()}
    plain = docs.select(F.explode(F.array_distinct(M.features(F.col("text")))).alias("t")).groupBy("t").count().collect()
    assert df == {r.t: r["count"] for r in plain}
    voc = M.vocabulary(docs, 30)
    known = {r.token: r.idf for r in voc.collect()}
    tf = {(r.doc_id, r.token): r.tf for r in M.terms(docs).collect() if r.token in known}
    raw = {k: (1 + __import__("math").log(n)) * known[k[1]] for k, n in tf.items()}
    norm = {d: sum(v * v for (e, _), v in raw.items() if e == d) ** 0.5 for d, _ in raw}
    got = {(r.doc_id, r.token): r.weight for r in M.tfidf(docs, voc).collect()}
    assert got.keys() == raw.keys() and all(abs(got[k] - raw[k] / norm[k[0]]) < 1e-12 for k in raw)
    counts = {r.token: (r.tf, r.docs) for r in M.token_counts(docs, voc).collect()}
    assert counts == {t: (sum(n for (_, u), n in tf.items() if u == t), sum(u == t for _, u in tf)) for t in {u for _, u in tf}}
    table = M.weight_table(voc)
    told = {r.doc_id: (r.label, round(r.p_neutral, 9)) for r in M.softmax_rows(docs, table).collect()}
    assert told == {r.doc_id: (r.label, round(r.p_neutral, 9)) for r in M.softmax(M.tfidf(docs, table)).collect()}
    plan = M.tfidf(docs.where("doc_id > 1"), voc)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
