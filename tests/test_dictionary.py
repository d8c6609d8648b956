"""Dictionary places against patterns and a plain sweep."""

import random
import re
import time

import pytest

from postlake.functions import lexicon as L
from postlake.operators import dictionary as D
from postlake.plans.posts import TEMPLATES


def places(text, terms):
    low = text.lower()
    found = []
    for t in terms:
        for m in re.finditer(rf"(?<!\w)(?={re.escape(t)}(?!\w))", low):
            found.append((m.start(), -(m.start() + len(t)), t))
    out, done = [], 0
    for start, end, t in sorted(found):
        keep = start >= done
        out.append((t, start, -end, keep))
        done = -end if keep else done
    return out


def want(rows, terms):
    return sorted((k, *p) for k, text in rows if text for p in places(text, terms))


def got(df):
    return sorted(tuple(r) for r in df.collect())


TERMS = ["a", "a b", "b a b", "b", "/s", "ab", "a, b", "ça va", "_x"]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_both_ways_equal_patterns(spark, bound):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", " ", " ", ",", "/s", "A", "ça va", "_x", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "a b " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([(t,) for t in [*TERMS, "A", "", None]], "term string")
    assert got(D.hits(df, "doc_id", "text", words, bound=bound)) == want(rows, TERMS)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_slang_in_posts(spark, bound):
    rows = list(enumerate(t for t, _ in TEMPLATES))
    df = spark.createDataFrame(rows, "post int, text string")
    words = spark.createDataFrame([(t,) for t in L.SLANG], "term string")
    out = got(D.hits(df, "post", "text", words, bound=bound))
    assert out == want(rows, list(L.SLANG)) and out


@pytest.mark.parametrize("bound", [10, -1])
def test_empty_tables(spark, bound):
    df = spark.createDataFrame([], "doc_id long, text string")
    words = spark.createDataFrame([("a",)], "term string")
    assert D.hits(df, "doc_id", "text", words, bound=bound).collect() == []
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.hits(full, "doc_id", "text", words.limit(0), bound=bound).collect() == []


def test_time_does_not_follow_the_number_of_terms(spark):
    """50,000 phrases over the same texts: equal to the patterns on the few that occur, and no fold over the terms."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=200))) for i in range(400)]
    many = list({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(50_000)})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()

    def timed(terms):
        dictionary = spark.createDataFrame([(t,) for t in terms], "term string")
        began = time.time()
        found = got(D.hits(df, "doc_id", "text", dictionary))
        return time.time() - began, found

    timed(many[:50])
    few, _ = timed(many[:50])
    all_, found = timed(many)
    known = set(many)
    plain = sorted((k, f"{a} {b}") for k, t in rows for ws in [t.split()] for a, b in zip(ws, ws[1:], strict=False) if f"{a} {b}" in known)
    assert sorted((r[0], r[1]) for r in found) == plain
    assert all_ < 30 * few + 10
