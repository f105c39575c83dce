"""Set operations, quotas, deduplication, report roll-ups and pickings by a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.sequences import numbered


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key: an aggregation, so equal keys meet only as partial results."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[k.alias(f"_k{i}") if isinstance(k, Column) else F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def dedup_ignoring_case(df: DataFrame, text: str, order: str) -> DataFrame:
    return first_of(df, [F.lower(F.trim(F.col(text)))], [F.col(order)])


def class_quota(df: DataFrame, label: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each label; tasks keep only their own first rows before the shuffle."""
    w = Window.partitionBy(label).orderBy(order)
    return df.where(F.col(label).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def neither_end(df: DataFrame, used: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rows of which neither end is used."""
    return df.join(used.select(F.col(key).alias(a)).distinct(), a, "left_anti").join(used.select(F.col(key).alias(b)).distinct(), b, "left_anti")


def rollup_report(df: DataFrame, outer: str, inner: str, ok: Column) -> DataFrame:
    """Passed, total and percentage by pair, by outer and over all."""
    r = df.rollup(outer, inner).agg(F.count_if(ok).alias("passed"), F.count("*").alias("total"), F.grouping_id().alias("level"))
    return r.withColumn("percent", 100.0 * F.col("passed") / F.col("total"))


def without_label(df: DataFrame, label: str) -> DataFrame:
    """An auxiliary source before the union: one of its labels is not known there."""
    return df.withColumn(label, F.lit(None).cast(dict(df.dtypes)[label]))


def best_by(df: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """Each key's value under the largest order."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that the seed decides: by the MD5 hash of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)


def shuffled_places(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """df with each row's place in that order, from 1."""
    return numbered(df.withColumn("_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))), ["_order", key], name).drop("_order")


def positional_zip(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows side by side in order, as far as the shorter reaches; places come from the counts of range partitions."""
    return numbered(a, [order_a], "_n").join(numbered(b, [order_b], "_n"), "_n").drop("_n")


def group_order(df: DataFrame, value: str, first: Column, name: str = "place") -> DataFrame:
    """Each distinct value and its place in the order (first, value)."""
    return numbered(df.select(value, first.alias("_first")).distinct(), ["_first", value], name).select(value, name)


def paired_by_stem(left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """Files that share their path without its extension."""
    stem = F.regexp_extract(F.col(path), r"^(.*)\.[^./]*$", 1)
    return left.select(stem.alias("stem"), F.col(path).alias("left_path")).join(right.select(stem.alias("stem"), F.col(path).alias("right_path")), "stem")


def corners_match(got: Column, expected: Column, tolerance: int = 1) -> Column:
    """Whether four points equal four points in some order, each coordinate within a tolerance."""
    from itertools import permutations

    near = lambda i, j: (F.abs(F.get(got, F.lit(i))["x"] - F.get(expected, F.lit(j))["x"]) <= tolerance) & (F.abs(F.get(got, F.lit(i))["y"] - F.get(expected, F.lit(j))["y"]) <= tolerance)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [near(i, p[i]) for i in range(4)]) for p in permutations(range(4))])


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed: the first n by a seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def picked_file(files: DataFrame, by: str = "length") -> DataFrame:
    """The path of the largest (length) or newest (modificationTime) file of a binaryFile listing."""
    return files.agg(F.max_by("path", F.struct(by, "path")).alias("path"))
