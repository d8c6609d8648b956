"""Words found in one pass, and patterns that run only where a word that they need is there."""

from pyspark.sql import functions as F

from postlake.functions import rules as RU
from postlake.functions import text as X
from postlake.operators import media as M
from postlake.plans.posts import TEMPLATES


def test_words_of_a_pattern_are_in_every_match():
    assert X.needed(r"\b(zero|no)\s+(regressions|bugs)\b") == ["regressions", "bugs"]
    assert set(X.needed("aura|[🎉✨]")) == {"aura", "🎉", "✨"} and X.needed(r"[^\x00-\x7F]") == [] == X.needed(r"a*|\d+")


def test_held_words_are_those_contained_and_folded_ones_are_marked(spark):
    rows = [(1, "loſt and lost no bugs"), (2, "loſt"), (3, None), (4, ""), (5, "i̇ kıl 🎉"), (6, "nothing")]
    got = {r.id: r.h for r in spark.createDataFrame(rows, "id int, text string").select("id", X.held(F.col("text"), ["lost", "no", "thing", "bug", "bugs", "kil", "🎉", "i "]).alias("h")).collect()}
    assert got == {1: ["bug", "bugs", "lost", "no"], 2: ["~lost"], 3: None, 4: [], 5: ["🎉", "~i ", "~kil"], 6: ["no", "thing"]}


def test_guards_lose_no_match_of_any_case(spark):
    texts = [v for t, c in TEMPLATES for x in (t, c) if x for v in (x, x.upper(), x.replace("s", "ſ").replace("i", "ı"), x.replace("i", "İ").replace("k", "K"), "prefix, " + x * 3)]
    df = spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("low", F.lower("raw")).withColumn("held", X.held(F.col("low"), RU.WORDS + M.WORDS)).cache()
    env, found = {k: F.col(k) for k in ("raw", "low", "held")}, []

    def walk(c):
        found.extend([c] if isinstance(c, RU.Match) and c.subject != "ctx" else [])
        for p in [*getattr(c, "parts", ()), *([c.part] if isinstance(c, RU.Not) else [])]:
            walk(p)

    for _, c, *_ in RU.LADDER:
        walk(c)
    pairs = [(m.col(env), F.col(m.subject).rlike(f"(?{m.flags})" + m.pattern)) for m in found]
    pairs += [(X.guarded(F.col("low"), F.col("held"), p[2:-2], "iu", M.EDGE), F.col("low").rlike("(?iu)" + M.EDGE[0] + p[2:-2] + M.EDGE[1])) for p, _ in M.TAG_RULES]
    counts = df.select(*[F.count_if(a != b).alias(f"d{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(b).alias(f"n{i}") for i, (_, b) in enumerate(pairs)]).first()
    assert not any(counts[: len(pairs)]) and sum(map(bool, counts[len(pairs) :])) > len(pairs) / 2


def test_categories_and_rules_look_for_their_words_in_one_pass(spark):
    x = spark.createDataFrame([("the payment failed", None, "neutral", 0.55)], "text string, context string, base_label string, base_conf double")
    for made in (M.categorised(x), RU.decide(x)):
        plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("held_run") + plan.count("run(lower(") + plan.count("arrowevalpython") >= 1
        # before, every keyword was a search of its own, over a text made lower-case for each
        assert "lambdafunction(contains(lower(" not in plan
