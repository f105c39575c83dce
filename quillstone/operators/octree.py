"""Nearest neighbours of points that lie unevenly: cells split while they are full, pairs of cells pruned level by level.

A grid of one width suits no cloud with a dense spot and far outliers.  Here cells are
halved along each axis while more than FULL places lie in them.  All pairs of cells that
could hold neighbours of each other go down the tree together: a pair stays if the boxes are
nearer than the distance within which, by the counts of the boxes, k others must lie.
A cell that is a leaf while its partners are still being split goes on as single places,
so a sparse cell beside a dense one meets the near side of it only.  There are at most
2 * DEPTH rounds (about as many as the tree is high, twice), whatever the cloud.

Equal points are one place with a count.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.shared import materialize

#: Places of a leaf, and levels at most.
FULL, DEPTH = 64, 60
#: Room for rounding when bounds are compared.
SLACK = 1 + 1e-9


class Tree:
    """Cells (key, parent, leaf, n, box) and places (place, leaf, n, coordinates) of finite points.

    A box holds its points tightly (_lo and _hi per axis) and is halved along each axis, so
    no level is spent on empty space.
    """

    def __init__(self, points: DataFrame, axes: list[str]) -> None:
        self.axes, self.sides = axes, [f"_{side}{a}" for a in axes for side in ("lo", "hi")]
        places = points.groupBy(*axes).agg(F.count("*").alias("n")).withColumns({"place": F.monotonically_increasing_id(), "key": F.lit("r")})
        inside, cells, leaves = materialize(places, "tree-places"), [], []
        while inside is not None:
            last = len(cells) == DEPTH
            box = [f(a).alias(f"_{side}{a}") for a in axes for side, f in (("lo", F.min), ("hi", F.max))]
            cells.append(materialize(inside.groupBy("key").agg(F.sum("n").alias("n"), (F.lit(last) | (F.count("*") <= FULL)).alias("leaf"), *box), "tree-cells"))
            told = inside.join(cells[-1].drop("n"), "key")
            leaves.append(told.where("leaf").select("place", "n", *axes, F.col("key").alias("leaf")))
            inside = None
            if cells[-1].where("not leaf").limit(1).count():
                # bit by bit: whether the place lies in the upper half of an axis
                upper = [(F.col(a) > (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2) | ((F.col(a) == F.col(f"_hi{a}")) & (F.col(f"_hi{a}") > F.col(f"_lo{a}"))) for a in axes]
                half = F.concat("key", *[F.when(u, "1").otherwise("0") for u in upper])
                inside = materialize(told.where("not leaf").select("place", "n", *axes, half.alias("key")), "tree-inside")
        every = reduce(DataFrame.unionByName, cells).withColumn("parent", F.expr(f"left(key, length(key) - {len(axes)})"))
        self.cells, self.places = materialize(every, "tree-all-cells"), materialize(reduce(DataFrame.unionByName, leaves), "tree-all-places")
        self.height = len(cells)

    def _side(self, side: str, df: DataFrame) -> DataFrame:
        """Columns of a box, marked as those of one side of a pair."""
        return df.select(*[F.col(c).alias(f"{side}{c}") for c in ("key", "leaf", "n", *self.sides)])

    def _split(self, pairs: DataFrame, side: str) -> DataFrame:
        """Pairs with the cells of one side that are no leaves replaced by their halves."""
        own = [c for c in pairs.columns if c.startswith(side)]
        halves = self._side(side, self.cells).join(self.cells.select(F.col("key").alias(f"{side}key"), "parent"), f"{side}key")
        other = pairs.where(~F.col(f"{side}leaf")).withColumnRenamed(f"{side}key", "parent").drop(*[c for c in own if c != f"{side}key"])
        return pairs.where(f"{side}leaf").unionByName(other.join(halves, "parent").select(*pairs.columns))

    def _as_places(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose near side is a leaf with each of its places instead; a place is a box without width."""
        corners = [F.col(a).alias(f"a_{side}{a}") for a in self.axes for side in ("lo", "hi")]
        own = self.places.select(F.col("leaf").alias("a_of"), F.concat(F.lit("p"), "place").alias("akey"), F.lit(True).alias("aleaf"), F.col("n").alias("an"), *corners)
        kept = pairs.withColumnRenamed("akey", "a_of").drop("aleaf", "an", *[f"a{c}" for c in self.sides])
        return kept.join(own, "a_of").select(*pairs.columns)

    def _pruned(self, pairs: DataFrame, k: int) -> DataFrame:
        """Pairs that may hold one of the k nearest others of some point of the near side."""
        gap, far = [], []
        for a in self.axes:
            one, other = F.col(f"b_lo{a}") - F.col(f"a_hi{a}"), F.col(f"a_lo{a}") - F.col(f"b_hi{a}")
            gap.append(F.greatest(F.lit(0.0), one, other))
            far.append(F.greatest(F.col(f"b_hi{a}") - F.col(f"a_lo{a}"), F.col(f"a_hi{a}") - F.col(f"b_lo{a}")))
        norm = lambda xs: F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
        measured = pairs.withColumns({"_gap": norm(gap), "_far": norm(far)})
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("d"))
        reach = lambda acc, x: F.struct((acc["n"] + x["bn"]).alias("n"), F.when(acc["n"] > k, acc["d"]).otherwise(x["_far"]).alias("d"))
        # the point itself is among those counted
        bound = measured.groupBy("akey").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("_far", "bn"))), start, reach, lambda acc: F.when(acc["n"] > k, acc["d"])).alias("_bound"))
        near = measured.join(bound, "akey").where(F.col("_bound").isNull() | (F.col("_gap") <= F.col("_bound") * SLACK))
        return materialize(near.select(*pairs.columns), "tree-pairs")

    def pairs(self, k: int) -> tuple[DataFrame, DataFrame]:
        """(akey, bkey) of leaves, and of places and leaves, that together hold the k nearest others of every point."""
        roots = self.cells.where("key = 'r'")
        box = lambda side: [F.col(c).alias(f"{side}{c}") for c in ("key", "leaf", "n", *self.sides)]
        pairs, done, single = roots.select(*box("a"), *box("b")), [], None
        for _ in range(self.height + 1):
            pairs = self._pruned(self._split(self._split(pairs, "a"), "b"), k)
            # near sides that are leaves: done if all their partners are, else they go on as places
            open_ = pairs.groupBy("akey").agg(F.bool_and("bleaf").alias("_all"), F.first("aleaf").alias("_mine"))
            told = materialize(pairs.join(open_, "akey"), "tree-told")
            done.append(told.where("_all and _mine").select("akey", "bkey"))
            if told.where("_mine and not _all").limit(1).count():
                alone = self._as_places(told.where("_mine and not _all").select(*pairs.columns))
                single = alone if single is None else single.unionByName(alone)
            if single is not None:
                single = self._pruned(self._split(single, "b"), k)
            pairs = told.where("not _mine").select(*pairs.columns)
            if not pairs.limit(1).count():
                break
        while single is not None and single.where("not bleaf").limit(1).count():
            single = self._pruned(self._split(single, "b"), k)
        done = reduce(DataFrame.unionByName, done)
        return done, done.where("false") if single is None else single.select("akey", "bkey")


def _nearest(tree: Tree, of_leaves: DataFrame, of_places: DataFrame, k: int) -> DataFrame:
    """place and mean_distance: leaves with one parent, and their places that go alone, meet all that theirs are paired with in one group.

    Places met by one of them do not harm another, as the pairs hold all that can be nearest; a group holds
    its places and those of the leaves around, and no pair of places is a row.
    """
    axes = tree.axes
    up = lambda key: F.expr(f"left({key}, greatest(1, length({key}) - {len(axes)}))")
    alone = of_places.join(tree.places.select(F.concat(F.lit("p"), "place").alias("akey"), "leaf"), "akey").select(up("leaf").alias("tile"), "bkey")
    met = of_leaves.select(up("akey").alias("tile"), "bkey").unionByName(alone).distinct()
    near = met.join(tree.places.withColumnRenamed("leaf", "bkey"), "bkey").select("tile", "place", "n", *axes)
    mine = tree.places.select(up("leaf").alias("tile"), "place", *axes)

    def nearest(own: pa.Table, other: pa.Table) -> pa.Table:
        p, q = (np.column_stack([t.column(a).to_numpy() for a in axes]) for t in (own, other))
        at, there, n = own.column("place").to_numpy(), other.column("place").to_numpy(), other.column("n").to_numpy()
        out = np.zeros(len(p))
        for i in range(0, len(p), 256):
            d = np.zeros((len(p[i : i + 256]), len(q)))
            for axis in range(len(axes)):
                gap = np.subtract.outer(p[i : i + 256, axis], q[:, axis])
                gap *= gap
                d += gap
            d = np.sqrt(d)
            # of its own place a point has one neighbour less
            there_are = n[None, :] - (at[i : i + 256, None] == there[None, :])
            d[there_are < 1] = np.inf
            best = np.argpartition(d, k - 1, axis=1)[:, :k] if len(q) > k else np.tile(np.arange(len(q)), (len(d), 1))
            d, left = np.take_along_axis(d, best, 1), np.take_along_axis(there_are, best, 1)
            order = np.argsort(d, axis=1, kind="stable")
            d, left, open_ = np.take_along_axis(d, order, 1), np.take_along_axis(left, order, 1), np.full(len(d), k)
            for c in range(d.shape[1]):
                took = np.where(np.isfinite(d[:, c]), np.minimum(left[:, c], open_), 0)
                out[i : i + 256] += np.where(took > 0, d[:, c], 0.0) * took
                open_ = open_ - took
        return pa.table({"place": own.column("place"), "mean_distance": pa.array(out / k)})

    return mine.groupBy("tile").cogroup(near.groupBy("tile")).applyInArrow(nearest, "place long, mean_distance double")


def mean_distances(points: DataFrame, k: int, id_column: str, axes: list[str]) -> DataFrame:
    """id and the mean distance of the k nearest other points, exact.

    Points without an id or with a coordinate that is null or no finite number are set
    aside: they have no distance and are nobody's neighbour.  Points with equal ids are
    different points.  With k others or fewer than that, all distances are 0.
    """
    finite = reduce(lambda a, b: a & b, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < float("inf")) for a in axes])
    held = points.where(F.col(id_column).isNotNull() & finite).select(F.col(id_column).alias("id"), *[(F.col(a).cast("double") + 0.0).alias(a) for a in axes])
    held = materialize(held, "tree-points")
    if held.limit(k + 1).count() < k + 1:
        return held.select("id", F.lit(0.0).alias("mean_distance"))
    tree = Tree(held, axes)
    of_leaves, of_places = tree.pairs(k)
    told = _nearest(tree, of_leaves, of_places, k)
    named = tree.places.join(told, "place").select(*axes, "mean_distance")
    return held.join(named, axes).select("id", "mean_distance")
