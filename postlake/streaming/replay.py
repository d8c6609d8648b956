"""Load replay: posts sent as a stream of batches for some seconds, with the latencies of the batches."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Latency classes grow by this factor; a percentile is right within it.
STEP = 1.05


@dataclass
class Latencies:
    """Counts of latencies by class; two add up to the one of both, so it stays small however long a run is."""

    counts: dict[int, int] = field(default_factory=dict)
    rows: int = 0
    batches: int = 0
    total_ms: float = 0.0

    @staticmethod
    def place(ms: float) -> int:
        import math

        return 0 if ms <= 1 else math.ceil(math.log(ms) / math.log(STEP))

    def add(self, ms: float, rows: int) -> None:
        k = self.place(ms)
        self.counts[k] = self.counts.get(k, 0) + 1
        self.rows, self.batches, self.total_ms = self.rows + rows, self.batches + 1, self.total_ms + ms

    def merge(self, other: Latencies) -> Latencies:
        both = {k: self.counts.get(k, 0) + other.counts.get(k, 0) for k in self.counts.keys() | other.counts.keys()}
        return Latencies(both, self.rows + other.rows, self.batches + other.batches, self.total_ms + other.total_ms)

    def percentile(self, share: float) -> float | None:
        """Upper end of the class that holds the latency at this share of all batches; null without any."""
        left = share * self.batches
        for k in sorted(self.counts):
            left -= self.counts[k]
            if left <= 0:
                return STEP**k
        return None


class _Listener(StreamingQueryListener):
    def __init__(self):
        self.id, self.seen, self.ended, self.error = None, Latencies(), threading.Event(), None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) == self.id and p.numInputRows > 0:
            self.seen.add(float(p.durationMs["triggerExecution"]), p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.id:
            self.error = event.exception
            self.ended.set()


def replay(posts: DataFrame, number: str, count: int, work: Callable[[DataFrame], DataFrame], checkpoint: str, seconds: float = 5.0, batch: int = 25) -> Latencies:
    """Sends ``batch`` posts a micro-batch for ``seconds`` through ``work`` and gives the latencies of the batches.

    Posts carry numbers 0 to ``count`` - 1 in column ``number``; the stream goes through them in order, over and
    over. The join with the posts is Spark's to plan. Every result row is computed and none is kept."""
    s = posts.sparkSession
    ticks = s.readStream.format("rate-micro-batch").option("rowsPerBatch", batch).load()
    sent = ticks.select((F.col("value") % count).alias("_tick")).join(posts, F.col("_tick") == F.col(number)).drop("_tick")
    listener = _Listener()
    s.streams.addListener(listener)
    try:
        query = work(sent).writeStream.format("noop").option("checkpointLocation", checkpoint).start()
        listener.id = str(query.runId)
        query.awaitTermination(seconds)
        query.stop()
        listener.ended.wait(30)  # the events of a query come in order, its end last
    finally:
        s.streams.removeListener(listener)
    if listener.error:
        raise RuntimeError(listener.error)
    return listener.seen


def report(seen: Latencies, seconds: float, daily: int = 1_000_000) -> dict[str, float | None]:
    """Throughput, percentiles, and the share of ``daily`` posts a day that the run could hold."""
    rate = seen.rows / seconds
    out = {f"p{p}_ms": seen.percentile(p / 100) for p in (50, 90, 95, 99)}
    mean = seen.total_ms / seen.batches if seen.batches else None
    return {"posts": seen.rows, "requests": seen.batches, "posts_per_sec": rate, "mean_ms": mean, **out, "posts_per_day": rate * 86400, "headroom": rate * 86400 / daily}
