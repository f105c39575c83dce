"""Keyed state: a sliding-window rate limiter whose rejected hits leave no trace, and running account scores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit(recent: list[float], times: list[float], span: float, most: int) -> tuple[list[float], list[bool]]:
    """Accept a hit if fewer than `most` accepted ones lie within the last `span` seconds."""
    out, held = [], list(recent)
    for t in times:
        held = [x for x in held if t - x <= span]
        ok = len(held) < most
        if ok:
            held.append(t)
        out.append(ok)
    return held, out


def limited(hits: DataFrame, key: str, at: str, span: float = 60.0, most: int = 20) -> DataFrame:
    """hits (key, at: seconds, id) with accepted, in time order of each key.

    Acceptance depends on what was accepted before, so a key is one sequence; its state
    is at most `most` times, and its rows are read in sorted batches, not as one frame.
    """
    import pandas as pd

    kinds = dict(hits.dtypes)
    schema = f"{key} {kinds[key]}, {at} double, id {kinds['id']}, accepted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), []
        for b in batches:
            accepted = []
            for k, t in zip(b[key], b[at], strict=True):
                if k != now:
                    now, recent = k, []
                recent, ok = admit(recent, [t], span, most)
                accepted += ok
            yield b.assign(accepted=accepted)

    sorted_hits = hits.select(key, F.col(at).cast("double").alias(at), "id").repartition(key).sortWithinPartitions(key, at, "id")
    return sorted_hits.mapInPandas(run, schema)


def limited_stream(hits: DataFrame, key: str, at: str, span: float = 60.0, most: int = 20) -> DataFrame:
    """The same on a stream: the state of a key is the list of its accepted times."""
    import pandas as pd

    kinds = dict(hits.dtypes)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([at, "id"])
        recent, accepted = admit(recent, rows[at].tolist(), span, most)
        state.update((recent,))
        yield pd.DataFrame({key: [keys[0]] * len(rows), at: rows[at].tolist(), "id": rows["id"].tolist(), "accepted": accepted})

    schema = f"{key} {kinds[key]}, {at} double, id {kinds['id']}, accepted boolean"
    return hits.select(key, F.col(at).cast("double").alias(at), "id").groupBy(key).applyInPandasWithState(run, schema, "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def running_accounts(scores: DataFrame, user: str, at: str, score: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Event-time sums of scores by account and day, with a watermark; feeds the account posterior."""
    return scores.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), user).agg(F.count("*").alias("n"), F.sum(score).alias("s")).select(F.col("w.start").alias("start"), user, "n", "s")
