"""Evaluation metrics, imputation and scaling as relational queries.

Ranks and cumulative counts run over the distinct scores, in ranges of them: a window
inside each range, and one over the ranges' few totals, so no task holds all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import sequences
from quillstone.sources.shared import materialize


def score_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row for each distinct score: positives and negatives.  Written out, as its readers go through it several times."""
    table = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return materialize(table, "scores")


#: Ranges of scores that are counted apart.
RANGES = 64


def _running(table: DataFrame) -> DataFrame:
    """score, pos, neg and their running sums tp and fp from the highest score down."""
    edges = table.agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 1000).alias("_edges"))
    held = table.join(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("score")))).drop("_edges")
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    totals = held.groupBy("_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = totals.select("_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in "pn"])
    down = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    inside = held.select("score", "pos", "neg", "_range", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"))
    return inside.join(F.broadcast(before), "_range").select("score", "pos", "neg", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Tie-aware: half of the tied pairs count."""
    t = _running(score_table(df, score, label))
    s = t.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select((F.col("u") / (F.col("p") * F.col("n"))).alias("auc"), F.col("p").alias("n_pos"), F.col("n").alias("n_neg"))


def auc_by(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """key and the AUC of each key's scores, tie-aware; null if a class is missing.  A key's scores may fill many tasks."""
    held = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = held.groupBy(key, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    up_to = sequences.Ordered(materialize(counts, "scores"), [key], ["score"]).scan(sequences.RunningSums("neg"))
    s = up_to.groupBy(key).agg(F.sum(F.col("pos") * (F.col("total") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(key, F.try_divide("u", F.col("p") * F.col("n")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step sum of precision over the recall gained at each distinct threshold."""
    t = _running(score_table(df, score, label))
    s = t.agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("pos").alias("p"))
    return s.select((F.col("s") / F.col("p")).alias("average_precision"))


def curve_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, true and false positive rate, precision."""
    t = _running(score_table(df, score, label))
    ends = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.join(F.broadcast(ends)).select(F.col("score").alias("threshold"), (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def calibration_error(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, closed below and open above; p = 1 falls in no bin but counts in the total."""
    held = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    b = held.groupBy(F.floor(F.col(p) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(label).alias("my"))
    return b.agg((F.sum(F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("mp") - F.col("my")))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and label by quantile bin; the edges are interpolated percentiles, equal scores share a bin."""
    edges = df.agg(F.percentile(p, F.lit([k / bins for k in range(1, bins)])).alias("edges"))
    held = df.join(F.broadcast(edges)).select(F.col(p).alias("p"), F.col(label).alias("y"), F.size(F.filter("edges", lambda e: e < F.col(p))).alias("bin"))
    return held.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def missing_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def imputed(df: DataFrame, columns: list[str], training: Column | None = None) -> DataFrame:
    """Nulls replaced by the exact median of the training rows."""
    held = df.where(training) if training is not None else df
    medians = held.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    return df.join(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores; a column without spread is only centred."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*[f"_{x}_{c}" for c in columns for x in "ms"])


def class_means(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])


def direction_check(df: DataFrame, columns: dict[str, int], label: str) -> DataFrame:
    """feature, mean of positives and negatives, and whether the sign of their difference is the expected one."""
    means = df.where(F.col(label).isin(0, 1)).agg(*[F.avg(F.when(F.col(label) == y, F.col(c))).alias(f"{c}_{y}") for c in columns for y in (0, 1)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_1").alias("mean_pos"), F.col(f"{c}_0").alias("mean_neg"), F.lit(d).alias("expected")) for c, d in columns.items()])
    return means.select(F.inline(rows)).withColumn("ok", F.signum(F.col("mean_pos") - F.col("mean_neg")) == F.col("expected"))


def feature_pivot(df: DataFrame, key: str, columns: list[str], names: list) -> DataFrame:
    """feature by key: one column for each listed key."""
    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))
    return long.groupBy("feature").pivot(key, names).agg(F.first("value"))
