"""Operator 13 against the plain method."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import vectorcodes


def plain(rows):
    """rows: (vec_id, label, vector). The contract word by word, on Python integers."""
    good = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(order[0][2]) // 8
    good = [r for r in good if len(r[2]) == 8 * w]
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in order[:16]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(6):
        for p in range(8):
            at = [near(cut(r[2], p), books[p])[1] for r in good]
            for e in range(len(books[p])):
                own = [cut(r[2], p) for r, a in zip(good, at) if a == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], {}
    for i, lab, v in good:
        found = [near(cut(v, p), books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        by[lab] = by.get(lab, 0) + error
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), error))
    return sorted((i if i is not None else -1, c, min(e, vectorcodes.MOST), min(by[lab], vectorcodes.MOST), sha) for i, lab, c, e in out)


def made(spark, rows, parts=3):
    schema = "vec_id bigint, embedding array<float>, label int, code string, l int"
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, lab, v in rows], schema).repartition(parts)
    got = vectorcodes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect())


def clouds(n, seed, width=16, ties=False):
    r = random.Random(seed)
    centres = [[r.uniform(-2, 2) for _ in range(width)] for _ in range(9)]
    pick = lambda: [r.randint(-1, 1) / 4096 for _ in range(width)] if ties else [float(np.float32(c + r.gauss(0, 0.2))) for c in r.choice(centres)]
    return [(i, r.choice([None, 0, 0, 0, 1, 2]), pick()) for i in range(n)]


@pytest.mark.parametrize(("n", "ties"), [(700, False), (400, True)])
def test_codes_are_those_of_the_plain_method(spark, n, ties, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK", 64)
    rows = clouds(n, n, ties=ties)
    assert made(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    r = clouds(40, 5, width=8)
    bad = [(100, 1, None), (101, 1, []), (102, 1, [1.0, None] + [0.0] * 6), (103, 2, [float("nan")] + [0.0] * 7), (104, 2, [float("inf")] + [0.0] * 7), (105, 2, [0.5] * 16), (106, 2, [0.5] * 7)]
    want = r + [(None, None, [0.25] * 8), (7, 0, [-0.3] * 8), (7, 0, [-0.3] * 8), (3, 1, [2.0] * 8)]
    got = made(spark, want + bad)
    want = [(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in want]
    assert got == plain(want)
    few = r[:5]
    assert made(spark, few) == plain(few)
    assert made(spark, []) == [] and made(spark, bad[:2]) == []


def test_large_components_are_exact(spark):
    rows = clouds(30, 9, width=8) + [(200, 1, [1e30, -1e30] + [3e5] * 6), (201, 1, [1e30, 1e29] + [3e5] * 6)]
    rows = [(i, lab, [float(np.float32(x)) for x in v]) for i, lab, v in rows]
    assert made(spark, rows) == plain(rows)


def test_heaps_leave_most_parts_unread(spark):
    values = vectorcodes.quantised(np.array([v for _, _, v in clouds(3000, 3)])).reshape(3000, 8, 2)
    books = np.ascontiguousarray(values[:16].transpose(1, 0, 2))
    drift = np.zeros((8, 16))
    b = vectorcodes.Block(values, 16)
    b.assign(books, drift)
    scanned = []
    for _ in range(12):
        new = vectorcodes.moved(books, b.totals().tolist())
        drift = drift + vectorcodes.drifts(books, new)
        books = new
        b = vectorcodes.Block.unpacked(b.packed())
        b.assign(books, drift)
        scanned.append(b.scanned)
        for p in range(8):
            best, *_ = vectorcodes.scan(values[:, p], books[p])
            assert (best == b.at[p]).all()
            keys = [k for k, _ in b.heaps[p]]
            assert sum(map(len, keys)) == 3000
            assert all(k[(i - 1) // 2] <= k[i] for k in keys for i in range(1, len(k), 37))
    assert scanned[-1] < 0.4 * 24000


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, vectorcodes.op13_vectorcodes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    want = con.execute(vectorcodes.ORACLE)
    assert [d[0] for d in want.description] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got == sorted(want.fetchall())
    assert spark.read.parquet(f"{sf}/embeddings.parquet").where(F.col("embedding").isNotNull()).count() >= len(got)
