"""Operator 11 against plain counting and against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from postlake.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, n bigint, score string"


def plain(rows, least=100, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in good.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in good.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    final, rank = [], Counter()
    for lang, score, a, p, left, right, total in out:
        rank[lang] += 1
        if rank[lang] <= top:
            final.append((lang, rank[lang], p, a, left, right, total, score))
    return final


def made(spark, rows, parts=3, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = collocations.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, n=1500):
    r = random.Random(seed)
    vocab = ["New", "york", "city", "the", "of", "état", "z z", "東京", "a\x0bb", "x" * 300] + [f"w{i}" for i in range(8)]
    fixed = ["new york city hall at night", "the state of the art. Of the", "once\tupon  a\ttime", "same same same same same same same"]
    rows = []
    for i in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else " ".join(r.choices(vocab, k=r.randint(0, 9))) for _ in range(r.randint(0, 6))]
        rows.append((r.choice([None, i, 7]), r.choice([". ", "\n", "; ", "!?", " , "]).join(parts), r.choice(["en", "en", "en", "de", None, "und"]), 1, "x"))
    return rows + [(1, None, "en", 1, "x"), (2, "", None, None, None), (3, " \t ", "fr", 1, ""), (4, "..!", "en", 1, "")] + rows[:60] * 2


@pytest.mark.parametrize("small", [False, True])
def test_counts_scores_and_ranks(spark, monkeypatch, small):
    if small:  # many packs and buckets
        monkeypatch.setattr(collocations, "PACK", 3000)
        monkeypatch.setattr(collocations, "BUCKET", 500)
    rows = corpus(3)
    want = plain(rows)
    assert len(want) > 20 and {w[0] for w in want} == {"en", "de", "und"}
    assert made(spark, rows) == sorted(want)


def test_top_ties_and_empty_tables(spark):
    rows = [(i, "b c, c b, a b; b a", "en", 1, "") for i in range(100)]
    want = plain(rows, top=2)
    assert made(spark, rows, top=2) == sorted(want) and len(want) == 2
    assert made(spark, []) == [] and made(spark, [(1, None, None, 1, "")]) == []
    assert made(spark, rows[:99]) == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(collocations.ORACLE)
    names = [d[0] for d in want.description]
    got = collocations.op11_collocations(spark, sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
