"""Back ends behind Arrow batches, fences round failing code, and stream state that expires."""

import random
from math import log

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from quillstone.operators import backends as B, comments, decisions, features, likelihood as L
from quillstone.plans import texts
from quillstone.streaming import rates, scoring, stateful


def test_halving_finds_the_failing_items():
    calls = []

    def f(items):
        calls.append(len(items))
        if any(x % 50 == 3 for x in items):
            raise ValueError("no")
        return [x * 2 for x in items]

    assert B.halved(f, list(range(128))) == [None if x % 50 == 3 else 2 * x for x in range(128)]
    assert len(calls) < 2 * 3 * 8 + 2
    assert B.halved(lambda items: items[1:], [1, 2]) == [None, None] and B.halved(f, []) == []


def test_fence_counts_failures(spark):
    seen = Observation()
    df = spark.createDataFrame([(k, "x" * (k % 5)) for k in range(40)] + [(None, None)], "id int, text string")
    fence = B.Fence(lambda: lambda rows: [(10 // len(t), str(len(t))) for (t,) in rows], [("a", "int"), ("b", "string")], batch=7, errors=seen)
    got = fence.apply(df, "id", ["text"]).collect()
    assert sorted((r.id if r.id is not None else -1, r.a, r.b) for r in got) == sorted((k, 10 // (k % 5) if k % 5 else None, str(k % 5) if k % 5 else None) if k >= 0 else (-1, None, None) for k in range(-1, 40))
    assert seen.get["n_failed"] == 9


class Brittle(B.WordFrequencies):
    def score(self, texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("poison")
        return super().score(texts)


def test_back_end_that_fails_on_a_text_spares_the_others(spark):
    df = spark.createDataFrame([(1, "one two two three one"), (2, "a poison here and there"), (3, ""), (4, "two two one")], "doc_id long, text string")
    pairs = comments.pair_table(df)
    model = Brittle([("two", 4), ("one", 3)], 13)
    got = B.ArrowLikelihood(lambda: model).score(pairs, "doc_id").collect()
    assert {r.doc_id for r in got} == {1, 4}
    want = {(i, p): w for i, t in ((1, "one two two three one"), (4, "two two one")) for p, w in enumerate(t.split())}
    assert {(r.doc_id, r.pos): r.token for r in got} == want
    assert all(abs(r.log_p - log(({"two": 4, "one": 3}.get(r.token, 0) + 0.1) / (13 + 500))) < 1e-12 and r["rank"] == {"two": 1, "one": 2}.get(r.token) for r in got)
    copies = B.ArrowLikelihood(lambda: model).copy_scores(pairs, "doc_id", 5).collect()
    assert sorted((r.doc_id, r.copy) for r in copies if r.doc_id in (1, 4)) == [(i, c) for i in (1, 4) for c in range(6)]


def test_model_is_loaded_once_in_a_process():
    made = []
    for _ in range(3):
        B.loaded("once", lambda: made.append(1) or "model")
    assert made == [1] and B.loaded("once", None) == "model"


def test_copies_of_the_bigram_model_equal_plain_ones(spark):
    """The four-pair way against each copy written out."""
    import hashlib

    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30)))) for k in range(12)]
    pairs = comments.pair_table(spark.createDataFrame(docs, "doc_id long, text string"))
    model = L.fit_bigrams(pairs)
    table = {(r.prev, r.token): (r.n, r.n_prev) for r in model.collect()}
    best = {}
    for (prev, token), (n, _) in table.items():
        best[prev] = max(best.get(prev, (0, "")), (n, token))
    got = {(r.doc_id, r.copy): r.log_p for r in L.copy_scores(pairs, model, 50, 4).collect()}
    for i, t in docs:
        words = t.split()
        for c in range(5 if words else 0):
            cut = [c and hashlib.sha256(f"{i}:{k}".encode()).hexdigest()[2 * c - 2 : 2 * c] < L.REPLACED_BELOW for k in range(len(words))]
            copy = [best.get(words[k - 1] if k else "", (0, w))[1] if gone else w for k, (w, gone) in enumerate(zip(words, cut, strict=True))]
            total = sum(log((table.get((p, w), (0, 0))[0] + 0.1) / ((table[p, w][1] if (p, w) in table else 0) + 5.0)) for p, w in zip(["", *copy], copy, strict=False))
            assert abs(got[i, c] - total) < 1e-6
    ranks = {(r.prev, r.token): r["rank"] for r in model.collect()}
    for (prev, token), (n, n_prev) in table.items():
        mine = [v for (p, _), v in table.items() if p == prev]
        assert ranks[prev, token] == 1 + sum(m > n for m, _ in mine) and n_prev == sum(m for m, _ in mine)


def lexicons(spark):
    return features.Lexicons(
        valued=texts.valued(spark), stems=texts.words(spark, ["trash"], "stem"), anchors=texts.words(spark, ["the"]), negative=texts.words(spark, ["vile"]), finance=("the",), ai_patterns=("delve",), hedges=("perhaps",), strong_words=["vile"],
        templates=spark.createDataFrame([("some text",)], "text string"),
    )


def test_poisoned_row_keeps_its_other_columns(spark):
    df = spark.createDataFrame([(k, f"The vile trash of number {k} is the worst. It was {'poison' if k == 4 else 'fine'} today!") for k in range(8)], "doc_id long, text string")
    seen = Observation()

    def load():
        def f(rows):
            if any("poison" in t for (t,) in rows):
                raise KeyError("poison")
            return [(float(len(t)),) for (t,) in rows]

        return f

    skip = {"curvature", "topic", "templates"}
    plain = {r.doc_id: r for r in features.comment_features(df, lexicons(spark), skip=skip).collect()}
    fence = B.Fence(load, [("chi_5", "double")], errors=seen)
    got = {r.doc_id: r for r in features.comment_features(df, lexicons(spark), skip=skip, instead={"rhetoric": features.python_feature(fence)}).collect()}
    assert seen.get["n_failed"] == 1 and got[4].chi_5 is None and got[3].chi_5 > 0
    for k, r in plain.items():
        assert all(got[k][c] == r[c] for c in r.asDict() if c != "chi_5")


def test_hashed_vectors_have_unit_length_and_equal_plain_counts(spark):
    import base64
    import hashlib

    t = "one two two three éé " * 3
    v = spark.createDataFrame([(t,), ("",)], "t string").select(comments.hashed_embedding(F.col("t")).alias("v")).collect()
    want = [0.0] * 64
    for w in t.split():
        h = hashlib.md5(w.encode())
        want[comments.PLACES.index(base64.b64encode(h.digest()).decode()[0])] += 1 if h.hexdigest()[-1] < "8" else -1
    norm = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(v[0].v, want, strict=True)) and v[1].v == [0.0] * 64


def stream_of(spark, tmp_path, parts, schema):
    """Each part a file, in order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return scoring.file_stream(spark, str(tmp_path / "in"), schema, form="parquet", files_each=1)


def run(spark, tmp_path, stream, mode):
    out, progress = [], []
    with stateful.rocksdb(spark):
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        progress = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return out, progress


def test_limiter_state_expires(spark, tmp_path):
    from datetime import datetime, timedelta

    rng, start = random.Random(6), datetime(2024, 1, 1)
    hits = sorted((start + timedelta(seconds=rng.uniform(0, 100)), rng.randrange(12), k) for k in range(80))
    # only one user is left afterwards, much later
    parts = [hits[:40], hits[40:], [(start + timedelta(seconds=1000 + k), 1, 100 + k) for k in range(5)], [(start + timedelta(seconds=2000), 1, 200)]]
    stream = stream_of(spark, tmp_path, [[(u, t, i) for t, u, i in part] for part in parts], "user int, ts timestamp, id long")
    out, sizes = run(spark, tmp_path, stateful.limited_with_expiry(stream, "user", "ts", 30.0, 2), "append")
    every = [(u, (t - datetime(1970, 1, 1)).total_seconds(), i) for part in parts for t, u, i in part]
    want = {r.id: r.accepted for r in rates.limited(spark.createDataFrame(every, "user int, at double, id long"), "user", "at", 30.0, 2).collect()}
    assert {r[3]: r[4] for r in out} == want
    assert max(sizes) == 12 and sizes[-1] == 1


def test_posterior_counts_late_scores_and_forgets_silent_accounts(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    parts = [[(1, at(1), 0.5), (2, at(1), 0.2)], [(1, at(2), None), (1, at(1.5), 0.4)], [(3, at(400), 0.1)], [(3, at(401), 0.3)]]
    stream = stream_of(spark, tmp_path, parts, "user int, ts timestamp, score double")
    out, sizes = run(spark, tmp_path, stateful.running_posterior(stream, "user", "ts", "score", 0.05, 2.0, idle=100 * 3600.0), "update")
    last = {r[1]: r for r in sorted(out)}
    batch = spark.createDataFrame([r for part in parts for r in part], "user int, ts timestamp, score double")
    for u, n, s in ((1, 2, 0.9), (2, 1, 0.2), (3, 2, 0.4)):
        odds = log(0.05 / 0.95) + 2 * s
        assert last[u][2] == n and abs(last[u][4] - 1 / (1 + 2.718281828459045**-odds)) < 1e-9
    assert batch.count() == 6 and sizes[-1] == 1 < max(sizes)
    assert decisions.account_posterior(batch, "user", "score").count() == 3


@pytest.mark.parametrize("form", ["parquet"])
def test_store_setting_is_put_back(spark, form):
    before = spark.conf.get(stateful.STORE, None)
    with stateful.rocksdb(spark):
        assert spark.conf.get(stateful.STORE) == stateful.ROCKSDB
    assert spark.conf.get(stateful.STORE, None) == before


def test_bits_of_replaced_tokens(spark):
    from hashlib import sha256

    places = [("a", 0), ("a", 1), ("a", 2), ("b", 7), ("b", 9), (None, 0), (None, 1), ("é", 3)]
    df = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(places)], "k int, n string, p int").coalesce(1)

    def bits(n, p):
        h = sha256(":".join(x for x in (n, str(p)) if x is not None).encode()).hexdigest() if p >= 0 else "f" * 64
        return sum(1 << c for c in range(1, 21) if h[2 * c - 2 : 2 * c] < L.REPLACED_BELOW)

    got = {r.k: (r.r.mine, r.r.before) for r in df.select("k", L.replaced(F.col("n"), F.col("p"), 20).alias("r")).collect()}
    assert got == {k: (bits(n, p), bits(n, p - 1)) for k, (n, p) in enumerate(places)}
    # the tokens are scored in one pass: no second aggregation beside the one of the pairs that are looked up
    t = comments.pair_table(spark.createDataFrame([(1, "a b c a b d e a b")], "doc_id int, text string"))
    plan = L.copy_scores(t, L.fit_bigrams(t), 5000, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "sha2(" not in plan


def test_word_frequencies_take_no_logarithm_for_each_token(monkeypatch):
    import math

    model = B.WordFrequencies([("a", 5), ("b", 5), ("c", 1)], 11)
    below = 11 + 0.1 * 5000
    want = [math.log(5.1 / below), math.log(5.1 / below), math.log(1.1 / below), math.log(0.1 / below)]
    monkeypatch.setattr(math, "log", None)
    assert model.score([["a", "b", "c", "d"], []]) == [(want, [1, 1, 3, None]), ([], [])]
