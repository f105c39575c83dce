"""Running recursions over range partitions and nearest neighbours of uneven clouds, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillstone.operators import metrics as M, models, neighbours as K, sequences as Q, signal as S


def series(seed=1, n=400, keys=(0, 1, None)):
    """One long key, short ones and a null one, with ties in the order and null values."""
    rng = random.Random(seed)
    rows = [(7, k // 2, float(rng.randint(-5, 5)) if k % 11 else None) for k in range(n)]
    return rows + [(k, rng.randint(0, 50), rng.gauss(0, 1)) for k in keys for _ in range(9)] + [(100 + k, 0, 1.0) for k in range(20)]


@pytest.mark.parametrize("partition", [13, 100_000])
def test_scans_equal_plain_loops(spark, partition):
    rows = [(k, t * 1000 + i, v) for i, (k, t, v) in enumerate(series())]
    df = spark.createDataFrame(rows, "id int, t long, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        o = Q.Ordered(df, ["id"], ["t"], partition)
        assert partition > 1000 or o.rows.rdd.getNumPartitions() > 20
        sums = {(r.id, r.t): (r.n, r.total) for r in o.scan(Q.RunningSums("v")).collect()}
        near = {(r.id, r.t): (r.before, r.after) for r in o.scan(Q.Neighbours("v")).collect()}
        both = o.then(Q.RunningSums("v")).scan(Q.Neighbours("v")).columns
        filtered = {(r.id, r.t): (r.x, r.p) for r in Q.Ordered(df.where("v is not null"), ["id"], ["t"], partition).scan(Q.Kalman("v", 0.5, 2.0, 10.0, 1.0)).collect()}
        steps = df.where("v is not null").select("id", "t", F.lit(0.9).alias("a"), F.col("v").alias("b"))
        states = {(r.id, r.t): r.x for r in Q.Ordered(steps, ["id"], ["t"], partition).scan(Q.Affine("a", "b", 3.0)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert both == ["id", "t", "v", "n", "total", "before", "after"]
    for key in {k for k, *_ in rows}:
        mine = sorted((t, v) for k, t, v in rows if k == key)
        for i, (t, v) in enumerate(mine):
            assert sums[key, t][0] == i + 1 and abs(sums[key, t][1] - sum(x or 0 for _, x in mine[: i + 1])) < 1e-9
            assert near[key, t] == (mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None)
        x, p, y = 1.0, 10.0, 3.0
        for t, v in mine:
            if v is None:
                continue
            gain = (p + 0.5) / (p + 0.5 + 2.0)
            x, p, y = x + gain * (v - x), (1 - gain) * (p + 0.5), 0.9 * y + v
            assert abs(filtered[key, t][0] - x) < 1e-9 and abs(filtered[key, t][1] - p) < 1e-9 and abs(states[key, t] - y) < 1e-9


def test_scans_of_empty_tables_and_equal_rows(spark):
    df = spark.createDataFrame([(1, 1.0)] * 6, "k int, v double")
    assert sorted(r.n for r in Q.numbered(df, ["k"], "n", 2).collect()) == [1, 2, 3, 4, 5, 6]
    assert Q.numbered(df.limit(0), ["k"]).count() == 0
    assert S.peaks(df, ["k"], "v", "v", 2).count() == 0 and S.winding(df.limit(0), ["k"], "v", "v", "v").count() == 0


def test_variance_after_very_many_steps():
    k = Q.Kalman("v", 0.01, 5.0, 100.0)
    p, _ = k._variances(0, 5000)
    for start in (1, 7, 100, 4000):
        assert np.allclose(k._variances(start, 50)[0], p[start : start + 50], rtol=1e-9)
    assert math.isfinite(k._variances(10**9, 3)[0][0])


def cloud():
    """A dense spot, a spread, equal points and a far outlier."""
    rng = random.Random(2)
    rows = [(k, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3), 0.0) for k in range(150)] + [(200 + k, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-9, 9)) for k in range(60)]
    return rows + [(300 + k, 2.0, 2.0, 2.0) for k in range(12)] + [(400, 1e5, 0.0, 0.0)]


def test_nearest_distances_of_an_uneven_cloud(spark, monkeypatch):
    from quillstone.operators import octree

    monkeypatch.setattr(octree, "FULL", 8)
    rows = cloud()
    missing = [(500, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (501, float("nan"), 0.0, 0.0), (502, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows + missing, "id int, x double, y double, z double")
    got = {r.id: r.mean_distance for r in K.nearest_distances(df, 6).collect()}
    x = np.array([r[1:] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :6].mean(1)
    assert set(got) == {r[0] for r in rows}
    assert all(abs(got[r[0]] - w) <= 1e-9 * max(1, w) for r, w in zip(rows, want, strict=True))


def test_nearest_distances_end_on_missing_points(spark):
    df = spark.createDataFrame([(k, 1.0 * k, 0.0, 0.0) for k in range(8)] + [(8, None, 0.0, 0.0)] * 3, "id int, x double, y double, z double")
    assert {r.id for r in K.nearest_distances(df, 2).collect()} == set(range(8))
    assert K.nearest_distances(df.limit(0), 2).count() == 0
    # one id on all points is no reason to go on for ever
    same = df.where("x is not null").withColumn("id", F.lit(1))
    assert K.nearest_distances(same, 2).count() == 8


def test_auc_by_key_equals_pairs(spark):
    rng = random.Random(5)
    rows = [(k, round(rng.random(), 1), rng.randint(0, 1)) for k in range(4) for _ in range(60)] + [(9, 0.5, 1)] * 3
    got = {r.k: r.auc for r in M.auc_by(spark.createDataFrame(rows, "k int, s double, y int"), "k", "s", "y").collect()}
    for k in range(4):
        pos, neg = [s for q, s, y in rows if q == k and y], [s for q, s, y in rows if q == k and not y]
        assert abs(got[k] - sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))) < 1e-12
    assert got[9] is None


def test_models_fitted_together_equal_models_fitted_alone(spark):
    """Against plain Newton steps in float64, for cells and penalties of all kinds."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -1.0, 0.0] + 0.3)))).astype(float)
    fold, inner = np.arange(300) % 3, np.arange(300) // 7 % 2
    df = spark.createDataFrame([(float(b), int(f), int(i), [float(v) for v in a]) for a, b, f, i in zip(x, y, fold, inner, strict=True)], "label double, fold int, inner int, x array<double>").repartition(4)
    allowed = np.zeros((4, 3, 2), dtype=bool)
    allowed[0], allowed[1, 0], allowed[2, 1:, 1], allowed[3] = True, True, True, True
    penalties = [1.0, 0.01, 100.0, 1e-4]
    got = models.newton(df, allowed, penalties)
    for m, c in enumerate(penalties):
        mine = allowed[m][fold, inner]
        a, b, w = np.c_[x[mine], np.ones(mine.sum())], y[mine], np.zeros(4)
        ridge = np.array([1 / c] * 3 + [0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ w))
            w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-12), a.T @ (p - b) + ridge * w)
        assert np.abs(got[m] - w).max() < 1e-5


def test_separable_rows_end(spark):
    df = spark.createDataFrame([(float(k % 2), 0, 0, [float(k % 2)]) for k in range(20)], "label double, fold int, inner int, x array<double>")
    w = models.newton(df, np.ones((1, 1, 1), dtype=bool), [1e9])
    assert np.isfinite(w).all() and w[0][0] > 0


def test_sequences_of_one_length_are_counted_together():
    from quillstone.operators import conversations as C

    rng, model = random.Random(3), C.StageModel()
    rows = [[rng.randrange(162) for _ in range(rng.randint(0, 5))] for _ in range(200)]
    groups = list(C._of_one_length(rows))
    assert sorted(map(tuple, (s for g in groups for s in g))) == sorted(tuple(s) for s in rows if s) and len(groups) == 5
    for g in groups:
        one, alone = model.counts_of(g), [model.counts_of([s]) for s in g]
        for k in range(4):
            assert np.allclose(one[k], sum(x[k] for x in alone), rtol=1e-9, atol=1e-12)
        assert np.isclose(one[0], sum(model.forward(s)[0] for s in g))


def test_nearest_places_are_no_rows_of_pairs(spark):
    from quillstone.operators import octree

    rng = random.Random(9)
    points = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(300 + i, 0.5, 0.5) for i in range(4)] + [(400, 90.0, 90.0)]
    out = octree.mean_distances(spark.createDataFrame(points, "id long, x double, y double"), 5, "id", ["x", "y"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.mean_distance for r in out.collect()}
    for i, x, y in points:
        want = sorted(math.sqrt((x - a) ** 2 + (y - b) ** 2) for j, a, b in points if j != i)[:5]
        assert abs(got[i] - sum(want) / 5) < 1e-12
