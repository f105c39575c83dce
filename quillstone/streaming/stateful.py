"""Keyed state that expires: the rate limiter and the account posterior as stateful processors.

State lives in RocksDB, so it need not fit in memory, and is let go when it can no longer
matter: the limiter's times after the window, by an event-time timer; an account's sums when
the account was silent for a stated time.  Start queries inside `rocksdb(spark)`, since the
kind of state store is read when a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.streaming.rates import admit

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The session keeps the state of streams that start meanwhile in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class Limiter(StatefulProcessor):
    """Accepts a hit if fewer than `most` accepted ones lie within the last `span` seconds.

    The state of a key is the list of its accepted times that still matter.  A timer is set
    to the moment when the last of them leaves the window; the key is forgotten then.
    """

    def __init__(self, key: str, span: float, most: int) -> None:
        self.key, self.span, self.most = key, span, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        hits = pd.concat(list(rows)).sort_values(["seconds", "id"])
        recent, accepted = admit([t for (t,) in self.times.get()], hits["seconds"].tolist(), self.span, self.most)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recent:
            self.times.put([(t,) for t in recent])
            self.handle.registerTimer(int((max(recent) + self.span) * 1000) + 1)
        else:
            self.times.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(hits), "at": hits["seconds"].tolist(), "id": hits["id"].tolist(), "accepted": accepted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_with_expiry(hits: DataFrame, key: str, at: str, span: float = 60.0, most: int = 20, late: str = "0 seconds") -> DataFrame:
    """key, at (seconds), id and accepted of a stream of hits (key, at: timestamp, id).

    Hits of a batch are taken in time order, so files or offsets should come in that order;
    `late` is how long a key outlives its window for hits that come later than others.
    """
    kinds = dict(hits.dtypes)
    held = hits.select(key, F.col(at).alias("_time"), (F.unix_micros(at) / 1e6).alias("seconds"), "id").withWatermark("_time", late)
    schema = f"{key} {kinds[key]}, at double, id {kinds['id']}, accepted boolean"
    return held.groupBy(key).transformWithStateInPandas(Limiter(key, span, most), schema, "append", "EventTime")


class Posterior(StatefulProcessor):
    """Number and sum of an account's scores and the posterior that follows; one row for each account of a batch.

    Sums do not depend on the order, so late scores count as others do, as long as the
    account is known.  An account that was silent for `idle` seconds of event time is let go.
    """

    def __init__(self, key: str, idle: float, prior: float, weight: float) -> None:
        self.key, self.idle, self.prior, self.weight = key, idle, prior, weight

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, s double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from math import exp, log

        import pandas as pd

        n, s, last = self.sums.get() if self.sums.exists() else (0, 0.0, float("-inf"))
        for part in rows:
            scores = part["score"].dropna()
            n, s, last = n + len(scores), s + float(scores.sum()), max(last, float(part["seconds"].max()))
        self.sums.update((n, s, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.idle) * 1000))
        odds = log(self.prior / (1 - self.prior)) + s * self.weight
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "mean_score": [s / n if n else None], "posterior": [1 / (1 + exp(-odds))]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_posterior(scores: DataFrame, key: str, at: str, score: str, prior: float, weight: float, idle: float = 30 * 86400.0, late: str = "1 hour") -> DataFrame:
    """key, n, mean_score and posterior after each batch of a stream of scores (key, at: timestamp, score).

    weight: what a whole point of score adds to the log odds.
    """
    kinds = dict(scores.dtypes)
    held = scores.select(key, F.col(at).alias("_time"), (F.unix_micros(at) / 1e6).alias("seconds"), F.col(score).cast("double").alias("score")).withWatermark("_time", late)
    schema = f"{key} {kinds[key]}, n long, mean_score double, posterior double"
    return held.groupBy(key).transformWithStateInPandas(Posterior(key, idle, prior, weight), schema, "update", "EventTime")
