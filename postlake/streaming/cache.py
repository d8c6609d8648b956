"""The scoring cache as keyed state of a stream, and the same answers in batch.

A request is a group of posts; its lookups come before its writes, so equal posts
of one request all miss. An entry lives until it was not used for ``keep``
seconds of event time. A hit whose entry has no aspects, by a request that wants
them, gets them filled in, and they are kept in the entry.

State is one value a key, with an event-time timer for its end; a post that
finds an entry past its end misses, whether or not the timer has fired yet, so
answers do not depend on how the stream is cut into batches as long as each
request comes whole and requests come in order of time. The stream needs the
RocksDB state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, request bigint, post_id bigint, ts timestamp, label string, confidence double, aspects string, cached boolean, filled boolean"
_STATE = "label string, confidence double, aspects string, used timestamp"


class ScoreCache(StatefulProcessor):
    """Rows (key, request, post_id, ts, text, context, want) of one key; ``score`` gives (label, confidence) and ``aspects`` a string for a text."""

    def __init__(self, score: Callable, aspects: Callable, keep: float):
        self.score, self.aspects, self.keep = score, aspects, pd.Timedelta(seconds=keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values(["ts", "request", "post_id"])
        held = self.entry.get() if self.entry.exists() else None
        entry = None if held is None else [held[0], held[1], held[2], pd.Timestamp(held[3])]
        out = []
        for _, group in all_rows.groupby(["ts", "request"], sort=True):
            now = group["ts"].iloc[0]
            if entry is not None and now - entry[3] > self.keep:
                entry = None
            found, fresh = entry is not None, None
            for r in group.itertuples(index=False):
                filled = False
                if found:
                    if r.want and entry[2] is None:
                        entry[2], filled = self.aspects(r.text), True
                    answer = entry
                else:
                    answer = [*self.score(r.text, r.context), self.aspects(r.text) if r.want else None, now]
                    fresh = answer
                out.append((key[0], r.request, r.post_id, r.ts, answer[0], answer[1], answer[2], found, filled))
            if not found:
                entry = fresh
            entry[3] = now
        self.entry.update(tuple(entry))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((entry[3] + self.keep).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached_scores(requests: DataFrame, score: Callable, aspects: Callable, keep: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """The stream ``requests`` (key, request, post_id, ts, text, context, want) with answers from the cache; rows of OUT."""
    rows = requests.select("key", "request", "post_id", F.col("ts").cast("timestamp").alias("ts"), "text", "context", "want").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(ScoreCache(score, aspects, keep), OUT, "Append", "EventTime")


def cached_flags(requests: DataFrame, keep: float = 3600.0) -> DataFrame:
    """Batch form: ``requests`` (key, request, ts, want, ...) with ``cached`` and ``filled``. Posts of a request share its time.

    Counted per (key, request) first, so that copies inside a request are one row of the windows. A life is a run
    of requests of a key without a pause of more than ``keep``; it has aspects once a request of it wanted them."""
    each = requests.groupBy("key", "request", "ts").agg(F.max("want").alias("_any"), F.max_by("want", F.col("post_id")).alias("_last"))
    order = Window.partitionBy("key").orderBy("ts", "request")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    lives = each.withColumn("_new", F.coalesce(pause > keep * 1e6, F.lit(True))).withColumn("_life", F.sum(F.col("_new").cast("int")).over(order))
    inside = Window.partitionBy("key", "_life").orderBy("ts", "request").rowsBetween(Window.unboundedPreceding, -1)
    # the first request of a life keeps what its last post was answered; later ones fill in at their first wish
    gave = F.when(F.col("_new"), F.col("_last")).otherwise(F.col("_any"))
    known = lives.withColumn("_gave", gave).withColumn("_had", F.coalesce(F.max("_gave").over(inside), F.lit(False)))
    x = requests.join(known.select("key", "request", "ts", "_new", "_had"), ["key", "request", "ts"])
    first = F.row_number().over(Window.partitionBy("key", "request", "ts", "want").orderBy("post_id")) == 1
    return x.withColumn("cached", ~F.col("_new")).withColumn("filled", ~F.col("_new") & ~F.col("_had") & F.col("want") & first).drop("_new", "_had")
