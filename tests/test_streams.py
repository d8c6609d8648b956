"""Stateful streams against their batch forms and against plain replays; restart from a checkpoint."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from postlake.sources import sinks
from postlake.streaming import cache, threads

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
REQ = "key string, request bigint, post_id bigint, ts timestamp, text string, context string, want boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def land(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-{number:04d}.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def scorers():
    """Made inside a function, so that they travel to the workers by value."""
    return (lambda text, context: ("positive", 0.9) if "good" in text else ("neutral", 0.5)), (lambda text: f"aspects of {text}")


score, aspects = scorers()


def log(seed, n):
    r = random.Random(seed)
    out, at = [], START
    for request in range(n):
        at += timedelta(seconds=r.choice([1, 30, 200, 900]))
        for _ in range(r.randint(1, 4)):
            k = f"k{r.choice([0, 0, 0, 1, 2, 3])}"
            out.append({"key": k, "request": request, "post_id": len(out), "ts": at.isoformat(), "text": f"good {k}" if k == "k1" else k, "context": None, "want": r.random() < 0.4})
    return out


def replay(rows, keep):
    """A plain cache with the same rules."""
    held, out, i = {}, {}, 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j]["request"] == rows[i]["request"]:
            j += 1
        now = datetime.fromisoformat(rows[i]["ts"])
        before = {k: e for k, e in held.items() if (now - e["used"]).total_seconds() <= keep}
        for r in rows[i:j]:
            e = before.get(r["key"])
            if e is not None:
                filled = r["want"] and e["aspects"] is None
                if filled:
                    e["aspects"] = aspects(r["text"])
                out[r["post_id"]] = (*e["score"], e["aspects"], True, filled)
            else:
                held[r["key"]] = e = {"score": score(r["text"], None), "aspects": aspects(r["text"]) if r["want"] else None}
                out[r["post_id"]] = (*e["score"], e["aspects"], False, False)
        for r in rows[i:j]:
            held[r["key"]]["used"] = now
        i = j
    return out


def test_cache_of_a_stream_over_a_restart(rocks, tmp_path):
    rows, keep = log(1, 60), 600.0
    want = replay(rows, keep)
    assert {w[3:] for w in want.values()} == {(False, False), (True, False), (True, True)}
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cuts = [0, 15, 30, 45, 60]
    stream = lambda: cache.cached_scores(rocks.readStream.schema(REQ).option("maxFilesPerTrigger", 1).json(src), score, aspects, keep, "1 minute")
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        land(src, n, [r for r in rows if a <= r["request"] < b])
        if n % 2:  # a new query goes on from the checkpoint
            run(stream(), out, state)
    got = {r.post_id: (r.label, r.confidence, r.aspects, r.cached, r.filled) for r in rocks.read.parquet(out).collect()}
    assert got == want
    batch = cache.cached_flags(rocks.read.schema(REQ).json(src), keep).collect()
    assert {r.post_id: (r.cached, r.filled) for r in batch} == {k: w[3:] for k, w in want.items()}


def test_parents_of_a_stream(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, ts timestamp, text string"
    r = random.Random(3)
    posts = [{"conv_id": c, "turn": t, "ts": (START + timedelta(minutes=60 * c + 13 * t + r.randint(0, 25))).isoformat(), "text": f"{c}.{t}"} for c in range(12) for t in range(5) if r.random() < 0.85]
    posts.sort(key=lambda x: x["ts"])
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for n in range(0, len(posts), 9):
        land(src, n, posts[n : n + 9])
    end = (START + timedelta(days=9)).isoformat()  # lets the watermark pass everything
    land(src, 9998, [{"conv_id": -1, "turn": 0, "ts": end, "text": "end"}])
    land(src, 9999, [{"conv_id": -2, "turn": 0, "ts": end, "text": "end"}])
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    run(threads.join_parents(read(), read()), out, state)
    whole = spark.read.schema(schema).json(src)
    want = sorted((x.conv_id, x.turn, x.text, x.context or "") for x in threads.join_parents(whole, whole).where("conv_id >= 0").collect())
    got = sorted((x.conv_id, x.turn, x.text, x.context or "") for x in spark.read.parquet(out).where("conv_id >= 0").collect())
    assert got == want and len(want) == len(posts)
    by = {(p["conv_id"], p["turn"]): p for p in posts}
    for c, t, _, context in want:
        p = by.get((c, t - 1))
        gap = (datetime.fromisoformat(by[c, t]["ts"]) - datetime.fromisoformat(p["ts"])).total_seconds() if p else -1
        assert context == (p["text"] if 0 <= gap <= 1800 else "")
    assert 0 < sum(bool(w[3]) for w in want) < len(want)


def test_feedback_is_appended_once(spark, tmp_path):
    schema = "text string, final_label string, final_conf double, reason string, fallback_required boolean"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [{"text": f"t{i}", "final_label": "neutral", "final_conf": 0.4, "reason": "model_inference", "fallback_required": i % 3 > 0} for i in range(12)]
    write = sinks.feedback_batches(out)
    failed = []

    def flaky(df, batch):
        write(df, batch)
        if batch == 1 and not failed:  # written, but the batch is not committed
            failed.append(batch)
            raise RuntimeError("lost")

    for n in range(4):
        land(src, n, rows[3 * n : 3 * n + 3])
    for sink in (flaky, flaky):
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src).writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            assert failed
    got = sorted(r.text for r in sinks.read_feedback(spark, out, 100).collect())
    assert failed == [1] and got == sorted(r["text"] for r in rows if r["fallback_required"])
