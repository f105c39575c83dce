"""Two-headed classifiers: imputation, scaling, cross-validated logistic regression and Platt calibration.

The regressions of all folds and penalties are fitted in the same passes over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import numeric
from quillstone.operators import metrics
from quillstone.sources.shared import materialize

#: Inverse penalties tried, 10^-4 to 10^4.
PENALTIES = tuple(10 ** (-4 + 8 * k / 9) for k in range(10))


def folds(df: DataFrame, label: str, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """df with a stratified fold number: places within a label's hash order, modulo n.

    The order is counted in buckets of the hash, so that no task holds a whole label.
    """
    h = F.xxhash64(F.lit(seed), key)
    held = df.withColumn("_bucket", F.shiftrightunsigned(h, 56).cast("int"))
    counts = held.groupBy(F.col(label).alias("_label"), "_bucket").count()  # at most 256 rows a label
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = counts.select("_label", F.col("_bucket").alias("_b"), before.alias("_before"))
    placed = held.withColumn("_place", F.row_number().over(Window.partitionBy(label, "_bucket").orderBy(h, key)))
    joined = placed.join(F.broadcast(where), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("fold", F.pmod(F.col("_place") + F.col("_before"), F.lit(n)).cast("int")).drop("_bucket", "_b", "_label", "_before", "_place")


@dataclass
class Head:
    """A fitted head: medians, means and deviations of its features, the regressions and their Platt lines by fold."""

    features: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    models: list[tuple[list[float], float]]
    platt: list[tuple[float, float]]

    def prepared(self, df: DataFrame) -> DataFrame:
        z = [((F.coalesce(F.col(c).cast("double"), F.lit(m)) - a) / s).alias(f"_z{i}") for i, (c, m, a, s) in enumerate(zip(self.features, self.medians, self.means, self.deviations, strict=True))]
        held = df.select("*", *z)
        return VectorAssembler(inputCols=[f"_z{i}" for i in range(len(z))], outputCol="_x").transform(held).drop(*[f"_z{i}" for i in range(len(z))])

    def probability(self) -> Column:
        """Mean of the calibrated probabilities of the folds' models, from the prepared vector."""
        x = vector_to_array(F.col("_x"))
        one = [numeric.sigmoid(a * (numeric.dot(x, F.lit(w)) + c) + b) for (w, c), (a, b) in zip(self.models, self.platt, strict=True)]
        return sum(one, F.lit(0.0)) / len(one)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return self.prepared(df).withColumn(out, self.probability()).drop("_x")


#: Newton steps at most, and the size of a step that ends them.
MOST_STEPS, SETTLED = 40, 1e-7


def _sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper half of the Hessian of the logistic loss of each row of beta; x ends in ones."""
    z = x @ beta.T
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss = np.logaddexp(0, z) - y[:, None] * z
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([loss.sum(0)[:, None], (p - y[:, None]).T @ x, (p * (1 - p)).T @ (x[:, i] * x[:, j])], axis=1)


def newton(rows: DataFrame, allowed: np.ndarray, penalties: Sequence[float], strict: bool = False) -> np.ndarray:
    """Weights (the intercept last) of many logistic regressions over one table, fitted side by side.

    rows: label, fold, inner and x (array of features).  allowed[m, fold, inner] says whether
    model m sees the rows of that cell; penalties[m] is its inverse penalty, which spares the
    intercept.  Each step is one aggregation: a partition adds up loss, gradient and Hessian
    of every model that has not settled, and the sums (models x features ** 2 numbers) go to
    the driver, which solves the small systems.  A step that makes the loss larger is halved.
    strict: a model that has not settled after the last step is an error.
    """
    first = rows.select(F.size("x")).first()
    if first is None:
        return np.zeros((len(allowed), 1))
    width = first[0] + 1
    beta, before = np.zeros((len(allowed), width)), np.zeros((len(allowed), width))
    least, open_ = np.full(len(allowed), np.inf), np.ones(len(allowed), dtype=bool)
    ridge = np.array([[1 / c] * (width - 1) + [0.0] for c in penalties])
    half = np.triu_indices(width)
    for _ in range(MOST_STEPS):
        models = np.flatnonzero(open_)
        if not len(models):
            break
        now, seen = beta[models], allowed[models]

        def add(batches: Iterator[pa.RecordBatch], models=models, now=now, seen=seen) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(models), 1 + width + len(half[0])))
            for b in batches:
                y, fold, inner = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold", "inner"))
                x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width - 1), np.ones((len(y), 1))], axis=1)
                for k, i in set(zip(fold.tolist(), inner.tolist(), strict=True)):
                    mine, which = (fold == k) & (inner == i), np.flatnonzero(seen[:, k, i])
                    if len(which):
                        total[which] += _sums(x[mine], y[mine], now[which])
            yield pa.RecordBatch.from_arrays([pa.array(models), pa.array(list(total))], names=["model", "sums"])

        added = rows.select("label", "fold", "inner", "x").mapInArrow(add, "model long, sums array<double>")
        got = {r.model: r.s.toArray() for r in added.groupBy("model").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).collect()}
        for m in models:
            s, w = got[m], beta[m]
            loss = s[0] + 0.5 * ridge[m] @ (w * w)
            if loss > least[m] * (1 + 1e-12):
                beta[m] = (w + before[m]) / 2
                open_[m] = np.abs(beta[m] - before[m]).max() > SETTLED
                continue
            hessian = np.zeros((width, width))
            hessian[half] = s[1 + width :]
            hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge[m] + 1e-9)
            step = np.linalg.solve(hessian, s[1 : 1 + width] + ridge[m] * w)
            before[m], least[m] = w, loss
            beta[m] = w - step * min(1.0, 20 / max(np.abs(step).max(), 1e-300))
            open_[m] = np.abs(step).max() > SETTLED
    if strict and open_.any():
        raise ArithmeticError(f"{int(open_.sum())} of {len(open_)} regressions did not settle in {MOST_STEPS} steps")
    return beta


def fit_head(df: DataFrame, features: list[str], label: str, key: str, n: int = 5, penalties=PENALTIES, seed: int = 0) -> Head:
    """One model and one Platt line for each fold; each fold's training rows choose their penalty by the mean AUC over folds of their own.

    All folds, inner folds and penalties are fitted together, and so are the final models
    and the Platt lines: three sets of Newton steps, whatever their number.  What cannot be fitted (no
    labelled rows, one class alone, a feature without any value, no fold to choose a penalty by) is an error.
    """
    df = df.where(F.col(label).isNotNull()).select(key, label, *features)
    # written out: medians, deviations and the rows themselves are taken from it
    held = materialize(folds(folds(df, label, key, n, seed + 100).withColumnRenamed("fold", "inner"), label, key, n, seed), "head-folds")
    *medians, low, high = held.agg(*[F.median(F.col(c).cast("double")) for c in features], F.min(F.col(label).cast("double")), F.max(F.col(label).cast("double"))).first()
    if low is None or low == high:
        raise ValueError(f"no head for {label}: " + ("no labelled rows" if low is None else f"all labels are {low:g}"))
    if missing := [c for c, m in zip(features, medians, strict=True) if m is None]:
        raise ValueError(f"no head for {label}: no labelled row has a value of {', '.join(missing)}")
    filled = held.select(key, label, "fold", "inner", *[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(features, medians, strict=True)])
    stats = filled.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features]).first()
    means, deviations = list(stats[: len(features)]), [s or 1.0 for s in stats[len(features) :]]  # a constant feature is 0 after scaling
    x = F.array(*[(F.col(c) - m) / s for c, m, s in zip(features, means, deviations, strict=True)])
    ready = materialize(filled.select(F.col(label).cast("double").alias("label"), "fold", "inner", x.alias("x")), "head")
    fold, inner = np.arange(n)[None, :, None], np.arange(n)[None, None, :]
    best = dict.fromkeys(range(n), penalties[0])
    if len(penalties) > 1:
        tried = [(k, i, c) for k in range(n) for i in range(n) for c in penalties]
        seen = np.concatenate([(fold != k) & (inner != i) for k, i, _ in tried])
        asked = np.concatenate([(fold != k) & (inner == i) for k, i, _ in tried])
        told = {r.model: r.auc for r in metrics.auc_by(margins(ready, asked, newton(ready, seen, [c for *_, c in tried])), "model", "margin", "label").collect()}
        for k in range(n):
            # an inner fold without both classes has no AUC, whatever the penalty
            sums = {c: [told[m] for m, (q, _, d) in enumerate(tried) if (q, d) == (k, c) and told.get(m) is not None] for c in penalties}
            if not all(sums.values()):
                raise ValueError(f"no head for {label}: no inner fold beside fold {k} holds both classes")
            sums = {c: sum(found) for c, found in sums.items()}
            best[k] = -max((s, -c) for c, s in sums.items())[1]  # of equals the strongest penalty
    weights = newton(ready, np.concatenate([(fold != k) & (inner >= 0) for k in range(n)]), [best[k] for k in range(n)], strict=True)
    own = np.concatenate([(fold == k) & (inner >= 0) for k in range(n)])
    lines = materialize(margins(ready, own, weights).select("label", F.col("model").cast("int").alias("fold"), F.lit(0).alias("inner"), F.array("margin").alias("x")), "platt")
    platt = newton(lines, own[:, :, :1], [1e9] * n)
    as_pair = lambda w: ([float(v) for v in w[:-1]], float(w[-1]))
    return Head(features, medians, means, deviations, [as_pair(w) for w in weights], [(float(a), float(b)) for a, b in platt])


def margins(rows: DataFrame, asked: np.ndarray, weights: np.ndarray) -> DataFrame:
    """model, margin and label of the rows of the cells that each model is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, fold, inner = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold", "inner"))
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for k, i in set(zip(fold.tolist(), inner.tolist(), strict=True)):
                mine, which = np.flatnonzero((fold == k) & (inner == i)), np.flatnonzero(asked[:, k, i])
                z = x[mine] @ weights[which, :-1].T + weights[which, -1]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(which, len(mine))), pa.array(z.ravel()), pa.array(np.repeat(y[mine], len(which)))], names=["model", "margin", "label"])

    return rows.select("label", "fold", "inner", "x").mapInArrow(run, "model long, margin double, label double")


def save_head(spark: SparkSession, head: Head, path: str) -> None:
    """The bundle of a head as one JSON row."""
    spark.createDataFrame([(json.dumps(asdict(head)),)], "value string").write.mode("overwrite").text(path)


def load_head(spark: SparkSession, path: str) -> Head:
    got = json.loads(spark.read.text(path).first()["value"])
    return Head(**got | {"models": [(w, c) for w, c in got["models"]], "platt": [tuple(x) for x in got["platt"]]})


def out_of_fold(df: DataFrame, features: list[str], label: str, key: str, n: int = 5, penalties=(1.0,), seed: int = 0) -> DataFrame:
    """key, label and the probability from a head that has not seen the row.  What df is made of is read once."""
    df = materialize(df.where(F.col(label).isNotNull()).select(key, label, *features), "labelled")
    held = materialize(folds(df, label, key, n, seed).withColumnRenamed("fold", "outer"), "outer-folds")
    parts = [fit_head(held.where(F.col("outer") != k), features, label, key, n, penalties, seed + 1).score(held.where(F.col("outer") == k), "p") for k in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, label, "p")


def ablation(df: DataFrame, families: dict[str, list[str]], label: str, key: str, penalties=(1.0,), n: int = 5) -> DataFrame:
    """AUC, average precision and calibration error with all features and without each family."""
    spark, every = df.sparkSession, [f for fs in families.values() for f in fs]
    rows = []
    for name, gone in [("all", []), *families.items()]:
        held = materialize(out_of_fold(df, [f for f in every if f not in gone], label, key, n, penalties), "fold")
        rows.append((name, metrics.roc_auc(held, "p", label).first()["auc"], metrics.average_precision(held, "p", label).first()[0], metrics.calibration_error(held, "p", label).first()[0]))
    return spark.createDataFrame(rows, "dropped string, auc double, ap double, ece double")


def joint(df: DataFrame, ai: Head, rb: Head) -> DataFrame:
    """p_ai, p_ragebait and their product."""
    return rb.score(ai.score(df, "p_ai"), "p_ragebait").withColumn("p_joint", F.col("p_ai") * F.col("p_ragebait"))
