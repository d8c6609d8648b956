"""Commands and load replay."""

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from postlake import cli
from postlake.operators import scoring
from postlake.streaming import replay


def test_score_and_query(spark, tmp_path):
    rows = [(1, "Not good. The app crashes every single morning!"), (2, None), (3, "mid.")]
    spark.createDataFrame(rows, "post_id long, text string").write.parquet(str(tmp_path / "in"))
    cli.main(["score", str(tmp_path / "in"), str(tmp_path / "out"), "--threshold", "0.99"], spark)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.post_id for r in out) == [1, 2, 3] and all(r.fallback_required for r in out if r.final_conf < 0.99)
    cli.main(["query", "label_distribution", "/root/testdata/sf0.001", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["query", "no_such_query", "a", "b"], spark)


def test_train_then_score(spark, tmp_path):
    rows = [(i, "good great" if i % 2 else "bad awful", "positive" if i % 2 else "negative") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, label string").write.parquet(str(tmp_path / "in"))
    cli.main(["train", str(tmp_path / "in"), str(tmp_path / "model"), "--balanced"], spark)
    cli.main(["score", str(tmp_path / "in"), str(tmp_path / "out"), "--model", str(tmp_path / "model")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("base_label") != F.col("label")).count() == 0


def test_replay(spark, tmp_path, capsys):
    cli.main(["replay", str(tmp_path / "cp"), "--seconds", "12", "--batch", "10"], spark)
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["requests"] > 0 and out["posts"] == 10 * out["requests"]
    assert out["p50_ms"] <= out["p90_ms"] <= out["p95_ms"] <= out["p99_ms"] and out["posts_per_day"] == out["posts_per_sec"] * 86400


def test_latencies_add_up():
    rng = random.Random(2)
    values = [rng.lognormvariate(4, 1) for _ in range(3000)]
    whole, parts = replay.Latencies(), [replay.Latencies() for _ in range(4)]
    for i, v in enumerate(values):
        whole.add(v, 5)
        parts[i % 4].add(v, 5)
    both = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]))
    assert both.counts == whole.counts and both.rows == 15000 and both.batches == 3000
    for p in (0.5, 0.9, 0.95, 0.99):
        exact = sorted(values)[int(p * 3000) - 1]
        assert exact <= both.percentile(p) * (1 + 1e-9) <= exact * replay.STEP * (1 + 1e-6)
    assert replay.Latencies().percentile(0.5) is None and replay.report(replay.Latencies(), 5)["mean_ms"] is None


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "request long, latency_ms double, fallback_required boolean")
    assert tuple(scoring.metrics(none).first()) == (0, 0, 0, 0.0, 0.0)
    two = spark.createDataFrame([(1, 4.0, True), (1, 4.0, False), (2, 8.0, None)], "request long, latency_ms double, fallback_required boolean")
    assert tuple(scoring.metrics(two).first()) == (2, 3, 1, 33.33, 6.0)


@pytest.mark.parametrize("capacity", [1, 3, 5, 100])
def test_metrics_with_a_cache(spark, capacity):
    """Cache figures and posts that wait for a label, against a replay request by request; before, they were left out."""
    r = random.Random(3)
    rows = [(q, float(q), f"k{min(r.randint(0, 9), r.randint(0, 9))}", r.random() < 0.4) for q in range(60) for _ in range(r.randint(1, 4))]
    got = scoring.metrics(spark.createDataFrame(rows, "request long, latency_ms double, key string, fallback_required boolean"), key="key", capacity=capacity).first()
    cache, hits, queued = OrderedDict(), 0, 0
    for q in range(60):
        own = [x for x in rows if x[0] == q]
        for k in sorted({x[2] for x in own}):
            held = k in cache
            hits += held * sum(x[2] == k for x in own)
            queued += (not held) * sum(x[2] == k and x[3] for x in own)
            cache[k] = 1
            cache.move_to_end(k)
            if len(cache) > capacity:
                cache.popitem(last=False)
    n, f = len(rows), sum(x[3] for x in rows)
    assert got.asDict() == {
        "total_requests": 60, "total_posts_analyzed": n, "total_fallbacks_triggered": f, "fallback_rate_pct": round(f * 100 / n, 2), "avg_latency_ms": 29.5,
        "cache_entries": len(cache), "cache_max_size": capacity, "cache_hits": hits, "cache_misses": n - hits, "cache_hit_rate_pct": round(hits * 100 / n, 2), "active_learning_queued": queued,
    }
    none = spark.createDataFrame([], "request long, latency_ms double, key string, fallback_required boolean")
    assert tuple(scoring.metrics(none, key="key", capacity=capacity).first()) == (0, 0, 0, 0.0, 0.0, 0, capacity, 0, 0, 0.0, 0)


def test_posts_of_one_request_fare_alike(spark):
    """Both posts of request 1 miss, and both wait; in request 2 the cache answers."""
    rows = [(1, 4.0, "a", True), (1, 4.0, "a", True), (2, 8.0, "a", True), (2, 8.0, None, False)]
    got = scoring.metrics(spark.createDataFrame(rows, "request long, latency_ms double, key string, fallback_required boolean"), key="key").first()
    assert (got.total_fallbacks_triggered, got.cache_hits, got.cache_misses, got.active_learning_queued, got.cache_entries) == (3, 1, 3, 2, 2)
