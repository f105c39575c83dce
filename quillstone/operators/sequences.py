"""Ordered series cut into range partitions: running recursions and neighbours without one task for a key.

Rows are range-partitioned and sorted by (key, order) and written once.  A key that is
longer than a partition reaches over several; of these a partition tells what a scan needs
to know of its part: one summary of its first key and one of its last.  The summaries of a
key are joined in order on the driver (two for each partition, whatever the rows are), and
each partition then goes through its rows with what comes before them and after them.

A scan is any associative rule: sums and counts, the values next door, and recursions
x' = a x + b, whose steps compose to one such step for a whole part.  So one series of any
length is worked on by many tasks, in two passes over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.shared import checkpointed

#: Rows of a partition, about.
PARTITION = 200_000


class Scan(Protocol):
    """What a running operator knows: how a run of rows is summed up, how two summaries join, and what each row gets.

    columns: what it reads of the rows; made: names and Spark types of what it gives.
    """

    columns: Sequence[str]
    made: Sequence[tuple[str, str]]

    def summary(self, values: list[np.ndarray], before: Any) -> Any: ...

    def join(self, a: Any, b: Any) -> Any: ...

    def run(self, values: list[np.ndarray], before: Any, after: Any) -> list[np.ndarray]: ...


class RunningSums:
    """n: rows up to each one, itself included; total: their sum."""

    made = (("n", "bigint"), ("total", "double"))

    def __init__(self, value: str | None = None) -> None:
        self.columns = [value] if value else []

    def summary(self, values, before):
        return len(values[-1]), float(np.nansum(values[0])) if self.columns else 0.0

    def join(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def run(self, values, before, after):
        n, total = before or (0, 0.0)
        return [n + 1 + np.arange(len(values[-1])), total + np.nancumsum(values[0]) if self.columns else np.zeros(len(values[-1]))]


class Neighbours:
    """before, after: the value of the row next to each one; null at the ends of a key."""

    made = (("before", "double"), ("after", "double"))

    def __init__(self, value: str) -> None:
        self.columns = [value]

    def summary(self, values, before):
        return float(values[0][0]), float(values[0][-1])

    def join(self, a, b):
        return a[0], b[1]

    def run(self, values, before, after):
        v, ends = values[0], ([before[1] if before else np.nan], [after[0] if after else np.nan])
        return [np.concatenate((ends[0], v[:-1])), np.concatenate((v[1:], ends[1]))]


class Affine:
    """x: the state of x' = a x + b after each row, from x0; the steps of a run compose to one (a, b)."""

    made = (("x", "double"),)

    def __init__(self, a: str, b: str, x0: float = 0.0) -> None:
        self.columns, self.x0 = [a, b], x0

    def _states(self, a: np.ndarray, b: np.ndarray, x: float) -> list[float]:
        out = []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            x = p * x + q
            out.append(x)
        return out

    def summary(self, values, before):
        return float(np.prod(values[0])), self._states(values[0], values[1], 0.0)[-1]

    def join(self, a, b):
        return a[0] * b[0], b[0] * a[1] + b[1]

    def run(self, values, before, after):
        start = before[0] * self.x0 + before[1] if before else self.x0
        return [np.array(self._states(values[0], values[1], start))]


def projective_power(m: np.ndarray, n: int) -> np.ndarray:
    """m ** n up to a factor, as its entries would not fit."""
    out = np.eye(len(m))
    while n:
        if n & 1:
            out = out @ m
            out /= np.abs(out).max()
        m = m @ m
        m /= np.abs(m).max()
        n >>= 1
    return out


class Kalman:
    """x, p, k: estimate, variance and gain of a scalar filter after each value.

    The variance depends on the number of steps alone and goes by p' = r (p + q) / (p + q + r),
    a fractional linear map, so that after n steps is a power of a 2 x 2 matrix.  The gains
    known, the estimate is affine.  `before` is the number of rows before a run, and later
    the composed step as well.
    """

    made = (("x", "double"), ("p", "double"), ("k", "double"))

    def __init__(self, value: str, q: float, r: float, p0: float, x0: float = 0.0) -> None:
        self.columns, self.q, self.r, self.p0, self.x0 = [value], q, r, p0, x0

    def _variances(self, start: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        m = projective_power(np.array([[self.r, self.r * self.q], [1.0, self.q + self.r]]), start)
        p = (m[0, 0] * self.p0 + m[0, 1]) / (m[1, 0] * self.p0 + m[1, 1])
        out, gains = np.empty(n), np.empty(n)
        for i in range(n):
            ahead = p + self.q
            gains[i] = ahead / (ahead + self.r)
            now = (1 - gains[i]) * ahead
            if now == p:  # settled: all that follow are the same
                out[i:], gains[i:] = now, gains[i]
                break
            out[i] = p = now
        return out, gains

    def summary(self, values, before):
        start = before[0] if before else 0
        _, k = self._variances(start, len(values[0]))
        x = 0.0
        for z, g in zip(values[0].tolist(), k.tolist(), strict=True):
            x += g * (z - x)
        return len(values[0]), float(np.prod(1 - k)), x

    def join(self, a, b):
        return a[0] + b[0], a[1] * b[1], b[1] * a[2] + b[2]

    def run(self, values, before, after):
        start, factor, rest = before or (0, 1.0, 0.0)
        p, k = self._variances(start, len(values[0]))
        x, out = factor * self.x0 + rest, []
        for z, g in zip(values[0].tolist(), k.tolist(), strict=True):
            x += g * (z - x)
            out.append(x)
        return [np.array(out), p, k]


def _runs(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> tuple[pa.Table | None, list[tuple[tuple, int, int]]]:
    """The partition's rows and (key, first row, row after the last) of its runs."""
    held = [b for b in batches if len(b)]
    if not held:
        return None, []
    rows = pa.Table.from_batches(held)
    names = list(zip(*[rows.column(k).to_pylist() for k in key], strict=True)) if key else [()] * len(rows)
    cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
    return rows, [(names[a], a, b) for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True)]


def _values(rows: pa.Table, columns: Sequence[str], a: int, b: int) -> list[np.ndarray]:
    """The columns of a run as doubles, null as not a number; last an array that has the run's length."""
    return [rows.column(c).slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns] + [np.empty(b - a)]


class Ordered:
    """Rows in the order of (key, order), in range partitions that are written once.

    key: columns that tell series apart; none: all rows are one.  Rows that are equal in
    both keep the order of their places in the scan.
    """

    def __init__(self, rows: DataFrame, key: Sequence[str], order: Sequence[str], partition: int = PARTITION) -> None:
        spark = rows.sparkSession
        self.key = list(key)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // partition))
        by = [*self.key, *order, "_scan_place"]
        placed = rows.withColumn("_scan_place", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
        self.rows = checkpointed(placed.drop("_scan_place"))

    def _edges(self, scan: Scan, known: dict) -> list[tuple[int, tuple, Any]]:
        """(partition, key, summary) of each partition's first and last key, in order."""
        import pickle

        key, columns = self.key, list(scan.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            rows, runs = _runs(batches, key)
            ends = [*runs[:1], *runs[1:][-1:]]
            made = [pickle.dumps((part, name, scan.summary(_values(rows, columns, a, b), known.get((part, name), (None, None))[0]))) for name, a, b in ends]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["edge"])

        read = self.rows.select(*dict.fromkeys([*key, *columns])) if key or columns else self.rows
        return sorted((pickle.loads(r["edge"]) for r in read.mapInArrow(run, "edge binary").collect()), key=lambda e: e[0])

    def _carried(self, scan: Scan, known: dict | None = None) -> dict[tuple[int, tuple], tuple[Any, Any]]:
        """(before, after) of the keys that reach over several partitions, by partition and key."""
        chains: dict[tuple, list[tuple[int, Any]]] = {}
        for part, name, told in self._edges(scan, known or {}):
            chains.setdefault(name, []).append((part, told))
        out: dict[tuple[int, tuple], list] = {}
        for name, chain in chains.items():
            for side, walk in ((0, chain), (1, chain[::-1])):
                so_far = None
                for part, told in walk:
                    out.setdefault((part, name), [None, None])[side] = so_far
                    so_far = told if so_far is None else scan.join(so_far, told) if side == 0 else scan.join(told, so_far)
        return {k: tuple(v) for k, v in out.items() if v != [None, None]}

    def scan(self, scan: Scan) -> DataFrame:
        """All rows with the columns that the scan makes; those of the same name are replaced."""
        # the filter's gains need the number of earlier rows before a part can be summed up
        counted = self._carried(RunningSums()) if isinstance(scan, Kalman) else None
        carried = self._carried(scan, counted)
        key, columns, names = self.key, list(scan.columns), [n for n, _ in scan.made]
        rows = self.rows
        kept = [c for c in rows.columns if c not in names]
        kinds = {"bigint": pa.int64(), "double": pa.float64()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            table, runs = _runs(batches, key)
            if table is None:
                return
            parts = [scan.run(_values(table, columns, a, b), *carried.get((part, name), (None, None))) for name, a, b in runs]
            made = [pa.array(np.concatenate(x), kinds[kind], from_pandas=True) for x, (_, kind) in zip(zip(*parts, strict=True), scan.made, strict=True)]
            out = pa.Table.from_arrays([*[table.column(c) for c in kept], *made], names=[*kept, *names])
            yield from out.to_batches()

        types = dict(rows.dtypes)
        return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{n}` {t}" for n, t in scan.made)]))

    def then(self, scan: Scan) -> Ordered:
        """The same rows with the columns of a scan, for another scan over them."""
        out = copy(self)
        out.rows = self.scan(scan)
        return out


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n", partition: int = PARTITION) -> DataFrame:
    """rows with their place in the order, from 1."""
    return Ordered(rows, [], order, partition).scan(RunningSums()).drop("total").withColumnRenamed("n", name)
