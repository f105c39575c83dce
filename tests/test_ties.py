"""What was left to the last bit or to the order of rows."""

import math
import random

from quillstone.operators import comments, signal as S
from quillstone.plans import ORACLE, QUERIES, streams
from quillstone.sources import clouds

from tests.compare import DATA, rows_of, rows_of_sql


def test_affect_means_are_of_exact_sums(spark):
    lex = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.3, 0.2), ("c", -0.1, 0.4), ("d", 0.0, 0.1)], "word string, valence double, arousal double")
    words = "d a b a c d a a a d a a a a d a".split()
    for seed in range(4):
        random.Random(seed).shuffle(words)
        r = comments.affect(spark.createDataFrame([(1, k, w) for k, w in enumerate(words)], "doc_id int, pos int, token string"), lex).first()
        n = {w: words.count(w) for w in "abcd"}
        assert r.mean_valence == (n["a"] + 3 * n["b"] - n["c"]) / (10 * len(words)) and r.mean_arousal == (2 * n["a"] + 2 * n["b"] + 4 * n["c"] + n["d"]) / (10 * len(words))


def test_judge_numbers_beyond_doubles(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1 2\n9007199254740993 -27000000000000001\n1\n0 0\n")
    numbers = clouds.read_numbers(spark, str(tmp_path / "in.txt"))
    assert sorted(r.v for r in clouds.grid_of(numbers).collect()) == [-27000000000000001, 9007199254740993]


def test_half_turns_go_one_way(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        x, y, f = round(rng.uniform(-30, 30), 2), float(rng.randrange(1, 50)) * (-1) ** k, rng.uniform(0.2, 3)
        rows += [(k, 0, x, y), (k, 1, -f * x, -f * y)]
    got = {r.k: r.turns for r in S.winding(spark.createDataFrame(rows, "k int, t int, re double, im double"), ["k"], "t", "re", "im").collect()}
    assert all(math.isclose(got[k], -0.5 if k % 2 else 0.5, abs_tol=1e-9) for k in got) and len(got) == 400


def test_points_on_a_depth_bound(spark):
    data = DATA.replace("0.001", "0.01")
    assert rows_of(QUERIES["q_track_cloud"](spark, data)) == rows_of_sql(ORACLE["q_track_cloud"], data)


def test_stream_files_hold_each_row_once_in_time_order(spark):
    files = spark.read.parquet(streams.timed_files(spark, DATA, "once")).selectExpr("id", "ts", "_metadata.file_path AS f")
    assert sorted(r.id for r in files.collect()) == sorted(r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").collect())
    spans = sorted((r.a, r.b) for r in files.groupBy("f").agg({"ts": "min"}).withColumnRenamed("min(ts)", "a").join(files.groupBy("f").agg({"ts": "max"}).withColumnRenamed("max(ts)", "b"), "f").collect())
    assert len(spans) == 6 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_sweeps_run_over_sizes_not_parts(spark):
    for name in ("q_power_point", "q_buckling_sweep"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [p_size" in plan[plan.index("Generate") :]
