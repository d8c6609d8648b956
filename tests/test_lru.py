"""The whole-log cache against a replay with an ordered map."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.operators import lru


def replay(keys, capacity):
    cache, hits = OrderedDict(), []
    for k in keys:
        hits.append(k in cache)
        if k in cache:
            cache.move_to_end(k)
        else:
            if len(cache) >= capacity:
                cache.popitem(last=False)
            cache[k] = 1
    return hits


@given(st.lists(st.integers(0, 9), max_size=60))
@settings(max_examples=200, deadline=None)
def test_counts_of_earlier_elements(values):
    v = np.array(values, np.int64)
    assert lru.earlier(v, True).tolist() == [sum(x > y for x in values[:i]) for i, y in enumerate(values)]
    assert lru.earlier(v, False).tolist() == [sum(x < y for x in values[:i]) for i, y in enumerate(values)]


@pytest.mark.parametrize(("width", "fan", "seed"), [(16, 3, 1), (64, 2, 2), (1 << 18, 64, 3)])
def test_hits_of_a_whole_log(spark, width, fan, seed, monkeypatch):
    monkeypatch.setattr(lru, "CELLS", 8)
    r = random.Random(seed)
    # one key in a third of all accesses, a null key, and keys that come back after long gaps
    keys = [None if r.random() < 0.02 else "hot" if r.random() < 0.33 else f"k{int(r.paretovariate(0.6)) % 400}" for _ in range(900)]
    log = spark.createDataFrame([(i // 2, i % 2, k) for i, k in enumerate(keys)], "t bigint, pos int, key string").repartition(5)
    for capacity in (1, 7, 60):
        got = {(x.t, x.pos): x.hit for x in lru.lru_global(log, ["t", "pos"], "key", capacity, width=width, fan=fan).collect()}
        assert [got[i // 2, i % 2] for i in range(900)] == replay(keys, capacity)


def test_positions_over_cells(spark):
    rows = [(i * 37 % 500, i) for i in range(500)] + [(250, 1000 + i) for i in range(50)]
    got = lru.numbered(spark.createDataFrame(rows, "x int, y int").repartition(4), ["x", "y"], "n", per=60).collect()
    want = {r: i for i, r in enumerate(sorted(rows), 1)}
    assert {(r.x, r.y): r.n for r in got} == want


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_positions_over_cells_of_times(spark, kind):
    # in a zone with summer time, local times of the skipped and the repeated hour keep their order
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        x = spark.range(400).selectExpr(f"CAST(TIMESTAMP_NTZ'2024-03-10 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 37 % 400 AS INT)) AS {kind}) AS x", "id AS y")
        want = {r.y: i for i, r in enumerate(x.orderBy("x", "y").collect(), 1)}
        assert {r.y: r.n for r in lru.numbered(x.repartition(4), ["x", "y"], "n", per=40).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_eviction_order_and_empty_log(spark):
    # capacity 3: A B C, A again, D evicts B
    log = spark.createDataFrame(list(enumerate("ABCADBAC")), "t int, key string")
    assert [x.hit for x in lru.lru_global(log, ["t"], "key", 3).orderBy("t").collect()] == replay("ABCADBAC", 3) == [False] * 3 + [True, False, False, True, False]
    assert lru.lru_global(log.limit(0), ["t"], "key").count() == 0
