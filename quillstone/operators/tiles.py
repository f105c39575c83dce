"""Vectors against vectors, tile by tile: all pairs are met, and a task holds two blocks of bounded size.

A side is dealt into blocks by the hash of a key; each block of one side meets each of the other
in one group, in which NumPy works through the pairs in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of a tile, where that makes its left block smaller, and the least rows of that.
MOST_PAIRS, LEAST_ROWS = 100_000_000, 1_000
#: Rows and columns of the pairs that are in memory at once.
CHUNK = (256, 1024)


def usable(vector: str):
    """The rows whose vector has a value at each place."""
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(False))


def tiled(left: DataFrame, right: DataFrame, left_key: str, right_key: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, most: int) -> tuple[DataFrame, int]:
    """work(block of left, block of right) of all tiles, and the number of tiles that a row of left is in.  most: rows of a block."""
    n, m = left.count(), right.count()
    b = max(1, -(-m // most))
    a = max(1, -(-n // min(most, max(LEAST_ROWS, MOST_PAIRS // max(1, min(m, most))))))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    place = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    l = left.withColumn("_a", place(left_key, a)).withColumn("_b", every(b))
    r = right.withColumn("_b", place(right_key, b)).withColumn("_a", every(a))
    return l.groupBy("_a", "_b").cogroup(r.groupBy("_a", "_b")).applyInArrow(work, schema), b


def matrix(t: pa.Table, column: str):
    """A column of lists as rows of a matrix of doubles."""
    import numpy as np

    v = t.column(column).combine_chunks()
    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1) if len(v) else np.empty((0, 0))


def chunks(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, CHUNK[0]):
        for j in range(0, m, CHUNK[1]):
            yield slice(i, min(n, i + CHUNK[0])), slice(j, min(m, j + CHUNK[1]))
