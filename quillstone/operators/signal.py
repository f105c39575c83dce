"""Sampled signals: spectra, correlation, peaks, running control terms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.engineering import pid as pid_term
from quillstone.operators.sequences import Neighbours, Ordered, RunningSums


def spectrum(samples: DataFrame, n: int, frequencies: list[int], at: str = "t", value: str = "v") -> DataFrame:
    """Magnitude of the discrete Fourier transform at the stated frequencies (a bounded query set); samples are read once."""
    held = samples.select(F.col(at).alias("t"), F.col(value).cast("double").alias("v"), F.explode(F.lit(frequencies)).alias("k"))
    angle = -2 * math.pi * (F.col("k") * F.col("t") % n) / n
    s = held.groupBy("k").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return s.select("k", F.hypot("re", "im").alias("magnitude"))


def cross_correlation(x: DataFrame, h: DataFrame, lags: int, at: str = "t", value: str = "v") -> DataFrame:
    """R(lag) = sum of h(t) x(t + lag): each sample of h is sent to lag + 1 places and meets x there by equality."""
    sent = h.select(F.col(at).alias("_t"), F.col(value).cast("double").alias("_h")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn(at, F.col("_t") + F.col("lag"))
    return sent.join(x.select(at, F.col(value).cast("double").alias("_x")), at).groupBy("lag").agg(F.sum(F.col("_h") * F.col("_x")).alias("r"))


def peaks(series: DataFrame, key: list[str], at: str, value: str, most: int | None = None) -> DataFrame:
    """Values above both neighbours; the `most` largest of each key.  A key's samples may fill many tasks."""
    out = Ordered(series, key, [at]).scan(Neighbours(value))
    out = out.where((F.col(value) > F.col("before")) & (F.col(value) > F.col("after"))).drop("before", "after")
    if most is None:
        return out
    if not key:
        return out.orderBy(F.desc(value), at).limit(most)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(value), at))).where(F.col("_r") <= most).drop("_r")


def pid(errors: DataFrame, key: list[str], at: str, error: str, kp: float, ki: float, kd: float) -> DataFrame:
    """Control output from the running sum and the last difference."""
    out = Ordered(errors.select(*key, at, error), key, [at]).then(RunningSums(error)).scan(Neighbours(error))
    return out.select(*key, at, pid_term(F.col(error), F.col("total"), F.col(error) - F.coalesce("before", error), kp, ki, kd).alias("control"))


def winding(curve: DataFrame, key: list[str], at: str, re: str, im: str) -> DataFrame:
    """Turns of each curve round the origin; a whole number for a closed one.

    A half turn is one of pi, whichever way the last bit of its angles points: the step is
    taken as turns of nine digits, halves away from zero, before it is wrapped.
    """
    angles = curve.select(*key, at, F.atan2(im, re).alias("_angle"))
    turn = F.col("_angle") - F.col("before")
    wrapped = turn - 2 * math.pi * F.round(F.round(turn / (2 * math.pi), 9))
    return Ordered(angles, key, [at]).scan(Neighbours("_angle")).groupBy(*key).agg((F.coalesce(F.sum(wrapped), F.lit(0.0)) / (2 * math.pi)).alias("turns"))
