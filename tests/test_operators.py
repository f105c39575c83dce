"""Operators on small fixtures: edge cases, invariants, equivalence with plain versions."""

import math
import random

from pyspark.sql import functions as F
from quillstone.functions import numeric as N, text as T
from quillstone.operators import comments, conversations as C, decisions, geometry as G, likelihood as L, metrics as M, neighbours as K, parsers as P, signal as S
from quillstone.sources import clouds, records
from quillstone.streaming import rates, scoring


def test_sentences_and_counts(spark):
    df = spark.createDataFrame([("Hi there. How are you?  Fine!",), ("",), ("no end",), ("a... b…",)], "t string")
    r = df.select(T.sentences(F.col("t")).alias("s"), T.n_sentences(F.col("t")).alias("n"), T.n_sentence_pieces(F.col("t")).alias("p")).collect()
    assert r[0].s == ["Hi there.", "How are you?", "Fine!"] and (r[0].n, r[0].p) == (3, 4)
    assert (r[1].n, r[1].p) == (1, 1) and r[2].n == 1


def test_truncate(spark):
    long = "w " * 130
    df = spark.createDataFrame([("one two three.",), (long + ".",), ("a b c d. " * 40,)], "t string")
    r = [x.t for x in df.select(T.truncated(F.col("t")).alias("t")).collect()]
    assert r[0] is None and len(r[1].split()) == 120 and len(r[2].split()) == 120


def test_rhetoric_and_neutral(spark):
    df = spark.createDataFrame([("Why is this so? EVERYONE is a fool!! Really?",)], "t string")
    r = df.select(T.is_rhetorical(F.lit("Why is this so?")).alias("q"), T.rhetoric(F.col("t")).alias("r"), T.neutral(F.col("t"), ["fool"]).alias("n")).first()
    assert r.q and r.r > 1 and "fool" not in r.n and "EVERYONE" not in r.n


def test_affect_needs_two_hits(spark):
    tok = spark.createDataFrame([(1, 0, "bad"), (1, 1, "x"), (2, 0, "bad"), (2, 1, "bad")], "doc_id int, pos int, token string")
    lex = spark.createDataFrame([("bad", -0.8, 0.9)], "word string, valence double, arousal double")
    r = {x.doc_id: x for x in comments.affect(tok, lex).collect()}
    assert r[1].mean_valence is None and abs(r[2].mean_valence + 0.8) < 1e-12 and r[2].negative_share == 1


def test_prefix_share_equals_nested_loop(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    stems = ["aaba", "bbbb", "ab", "abab"]
    tok = spark.createDataFrame([(i % 9, i, w) for i, w in enumerate(words)], "doc_id int, pos int, token string")
    got = {r.doc_id: r.prefix_share for r in comments.prefix_share(tok, spark.createDataFrame([(s,) for s in stems], "stem string")).collect()}
    for d in range(9):
        mine = [w for i, w in enumerate(words) if i % 9 == d]
        assert abs(got[d] - sum(any(len(s) >= 4 and w.startswith(s) for s in stems) for w in mine) / len(mine)) < 1e-12


def test_cusum_fold_equals_closed_form(spark):
    rng = random.Random(2)
    values = [(k, i, rng.uniform(-2, 2)) for k in range(20) for i in range(3 + k)]
    got = {r.k: r.cusum_peak for r in C.cusum_peak(spark.createDataFrame(values, "k int, i int, v double"), "k", "i", "v").collect()}
    for k in range(20):
        s = [v for kk, _, v in values if kk == k]
        head = sorted(s[: max(2, len(s) // 2)])
        mu, g, top = (head[len(head) // 2] + head[(len(head) - 1) // 2]) / 2, 0.0, 0.0
        for v in s:
            g = max(0.0, g + mu - v - 0.25)
            top = max(top, g)
        assert got[k] is None if len(s) < 4 else abs(got[k] - top) < 1e-9


def test_mattr_equals_windows(spark):
    rng = random.Random(3)
    rows = [(d, i, rng.choice("abcdefgh")) for d, n in enumerate((5, 12, 40)) for i in range(n)]
    got = {r.doc_id: r.mattr for r in C.moving_ttr(spark.createDataFrame(rows, "doc_id int, pos int, token string"), width=10).collect()}
    for d in range(3):
        t = [w for dd, _, w in rows if dd == d]
        want = len(set(t)) / len(t) if len(t) < 10 else sum(len(set(t[i : i + 10])) / 10 for i in range(len(t) - 9)) / (len(t) - 9)
        assert abs(got[d] - want) < 1e-12


def test_metrics_on_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (1.0, 1)], "p double, y int")
    assert abs(M.roc_auc(df, "p", "y").first().auc - 5.5 / 6) < 1e-12
    flipped = df.select((1 - F.col("p")).alias("p"), "y")
    assert abs(M.roc_auc(flipped, "p", "y").first().auc - (1 - 5.5 / 6)) < 1e-12
    assert 0 < M.average_precision(df, "p", "y").first()[0] <= 1 and M.calibration_error(df, "p", "y").first()[0] >= 0


def test_grid_radius_and_nearest_equal_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 0.2)) for i in range(60)]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    far = lambda a, b: math.dist(a[1:], b[1:])
    got = {r.id: r.neighbours for r in K.radius_counts(df, 0.7).collect()}
    assert got == {a[0]: sum(far(a, b) <= 0.7 for b in pts) for a in pts}
    near = {r.id: r.mean_distance for r in K.nearest_distances(df, 3).collect()}
    for a in pts:
        assert abs(near[a[0]] - sum(sorted(far(a, b) for b in pts if b is not a)[:3]) / 3) < 1e-9


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (70, 70)], "a int, b int")
    r = {x.node: x.component for x in K.components(edges).collect()}
    assert all(r[i] == 0 for i in range(21)) and r[60] == 50 and r[70] == 70


def test_camera_directions():
    k = [[500, 0, 320], [0, 500, 240], [0, 0, 1]]
    r, t = G.world_to_camera([1, 0, 0], [0, 0, 1], [0, 1, 0], [1, 2, 3])
    p = G.projection_matrix(k, r, t)
    at = lambda x: [sum(a * b for a, b in zip(row, [*x, 1], strict=True)) for row in p]
    see = lambda x: (at(x)[0] / at(x)[2], at(x)[1] / at(x)[2])
    ahead, right, up = see((1, 7, 3)), see((2, 7, 3)), see((1, 7, 4))
    assert math.dist(ahead, (320, 240)) < 5 and right[0] > ahead[0] + 50 and up[1] < ahead[1] - 50
    assert all(abs(a - b) < 1e-9 for a, b in zip(G.camera_center(r, t), (1, 2, 3), strict=True))


def test_triangulation_and_fundamental(spark):
    k = [[500, 0, 320], [0, 500, 240], [0, 0, 1]]
    mats = {i: G.projection_matrix(k, *G.world_to_camera([1, 0, 0], [0, -1, 0], [0, 0, 1], [i, 0.1 * i, -5])) for i in range(3)}
    rng = random.Random(1)
    pts = [(t, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0, 3)) for t in range(20)]
    see = lambda m, x: [sum(a * b for a, b in zip(r, [*x, 1], strict=True)) for r in m]
    px = {(t, i): (lambda h: (h[0] / h[2], h[1] / h[2]))(see(m, x)) for t, *x in pts for i, m in mats.items()}
    views = spark.createDataFrame([(t, i, *map(float, uv)) for (t, i), uv in px.items()], "track int, image int, u double, v double")
    got = {r.track: (r.x, r.y, r.z) for r in G.triangulated(views, mats).collect()}
    assert all(math.dist(got[t], x) < 1e-6 for t, *x in pts)
    rows = [(1, *map(float, px[t, 0]), *map(float, px[t, 1])) for t, *_ in pts] + [(1, 10.0, 10.0, 600.0, 400.0)]
    assert G.fundamental_inliers(spark.createDataFrame(rows, "pair int, ua double, va double, ub double, vb double"), tries=100).count() == 20


def test_undistort_inverts(spark):
    x, y, k1, k2 = 0.3, -0.2, 0.1, 0.02
    s = 1 + k1 * (x * x + y * y) + k2 * (x * x + y * y) ** 2
    u, v = N.undistorted(F.lit(k1), F.lit(k2), F.lit(x * s), F.lit(y * s))
    r = spark.range(1).select(u.alias("u"), v.alias("v")).first()
    assert abs(r.u - x) < 1e-3 and abs(r.v - y) < 1e-3
    assert spark.range(1).select(N.undistorted(F.lit(k1), F.lit(k2), F.lit(0.0), F.lit(0.0))[0].alias("u")).first().u == 0


def test_blur_equals_direct_sum(spark):
    cells = [(i, j, (i * 7 + j * 3) * 10**8) for i in range(4) for j in range(5)]
    got = {(r.i, r.j): r.v for r in G.blurred(spark.createDataFrame(cells, "i int, j int, v long"), 2, 5).collect()}
    for i, j, _ in cells:
        want = sum(v * 5 ** (abs(a - i) + abs(b - j)) for a, b, v in cells if abs(a - i) <= 2 and abs(b - j) <= 2) % N.MODULUS
        assert got[i, j] == want


def test_square_and_hull():
    assert G.hull_of([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    score, corners = G.square_score([(x, y) for x in range(10) for y in range(10)], 200.0)
    assert score > 100 and set(corners) == {(0, 0), (9, 0), (9, 9), (0, 9)}


def test_spectrum_peak(spark):
    n = 64
    s = spark.createDataFrame([(t, math.sin(2 * math.pi * 5 * t / n)) for t in range(n)], "t int, v double")
    r = {x.k: x.magnitude for x in S.spectrum(s, n, [4, 5, 6]).collect()}
    assert abs(r[5] - n / 2) < 1e-9 and r[4] < 1e-9


def test_rate_limiter_forgets_rejected():
    held, ok = rates.admit([], [0, 1, 2, 3, 11, 12], 10, 2)
    assert ok == [True, True, False, False, True, True] and held == [11, 12]


def test_red_flags_skip_missing(spark):
    df = spark.createDataFrame([(None, 1.2), (-2.0, float("nan"))], "psi_1 double, chi_5 double")
    r = [x.f for x in df.select(decisions.red_flags(decisions.COMMENT_FLAGS, df.columns).alias("f")).collect()]
    assert [len(x) for x in r] == [1, 1] and r[1][0].startswith("Low")


def test_parsers(spark):
    chat = spark.createDataFrame([(1, "hello\nHim: hi\nme - yo\nand more\nok")], "id int, t string")
    r = [(x.turn, x.speaker, x.text) for x in P.pasted_chat(chat, "id", "t").orderBy("turn").collect()]
    assert r == [(0, "S", "hi"), (1, "V", "- yo and more")] or r[1][2].endswith("yo and more")
    d = spark.createDataFrame([(1, "x Person A: hi Person B: yo Suspect:  ")], "id int, t string")
    assert [(x.speaker, x.text) for x in P.dialogue(d, "id", "t").orderBy("turn").collect()] == [("S", "hi"), ("V", "yo")]


def test_records_round_trip(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('﻿{"text": "a", "label_ai": 1, "extra": "x", "timestamp": "2024-01-02T03:04:05Z"}\n\n{"text": "b", "username": "u"}\n', encoding="utf-8")
    df = records.read_comments(spark, str(p))
    rows = {r.text: r for r in df.collect()}
    assert rows["a"].meta == {"extra": "x"} and rows["a"].timestamp is not None and rows["b"].label_ai is None
    records.write_comments(df, str(tmp_path / "out"))
    again = records.read_comments(spark, str(tmp_path / "out"))
    assert {r.text: r.meta for r in again.collect()} == {r.text: r.meta for r in rows.values()}
    q = tmp_path / "conv.json"
    q.write_text('[{"speaker": "S", "text": "hi"}]')
    assert records.read_conversations(spark, str(q), whole_files=True).first().label is None


def test_lexicon_readers(spark, tmp_path):
    (tmp_path / "v.csv").write_text("word,valence,arousal,dominance\n# note\nBad,-0.5,0.7,\nworse,x,1,1\nbad,-0.6,0.7,0.4\n")
    r = records.read_valued_lexicon(spark, str(tmp_path / "v.csv")).collect()
    assert [(x.word, x.valence, x.dominance) for x in r] == [("bad", -0.6, 0.4)]
    (tmp_path / "d.dic").write_text("%\n1\tcare.virtue\n2\tcare.vice\n%\nhelp*\t1\nharm*\t2\n")
    assert [x.stem for x in records.read_category_dictionary(spark, str(tmp_path / "d.dic")).collect()] == ["harm"]


def test_ply_and_poses(spark, tmp_path):
    rows = [(1.0, 2.0, 3.0, 10, 20, 30), (4.0, 5.0, 6.0, 0, 0, 255)]
    for binary in (True, False):
        (tmp_path / f"{binary}.ply").write_bytes(clouds.ply_bytes(rows, binary))
        got = clouds.read_ply(spark, str(tmp_path / f"{binary}.ply")).orderBy("x").collect()
        assert [(r.x, r.y, r.z, r.r, r.g, r.b) for r in got] == rows
    (tmp_path / "p.txt").write_text("intro\n1)\nCamPosition: X=1 Y=2.5 Z=-3\nCamForward X=0\tY=1 Z=0\n\nCamRight: X=1 Y=0 Z=0\nCamUp: X=0 Y=0 Z=1\n2)\nCamPosition: X=0 Y=0 Z=0\n")
    p = {r["index"]: r for r in clouds.read_poses(spark, str(tmp_path / "p.txt")).collect()}
    assert p[1].position == [1, 2.5, -3] and p[1].missing == [] and len(p[2].missing) == 3


def test_stream_scores_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "hello there"}\n')
    s = scoring.file_stream(spark, str(tmp_path / "in"), "text string")
    scoring.serve(s, lambda b: b.select(T.n_words(F.col("text")).alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_language_model_shares(spark):
    tok = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b a b a c".split())], "doc_id int, pos int, token string")
    m = L.fit_bigrams(tok)
    ranks = {(r.prev, r.token): r["rank"] for r in m.collect()}
    assert ranks["a", "b"] == 1 and ranks["a", "c"] == 2
    assert L.perplexity(L.score(tok, m, 3)).first().perplexity > 1


def test_pose_check_and_picks(spark):
    from quillstone.operators import relational as R

    good = (1, [1.0, 2.0, 3.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0])
    flat = (2, [1.0, 2.0, 3.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    poses = spark.createDataFrame([good, flat], "index int, position array<double>, forward array<double>, right array<double>, up array<double>")
    assert {r["index"]: r.ok for r in G.pose_check(poses, [[500.0, 0, 320.0], [0, 500.0, 240.0], [0, 0, 1]]).collect()} == {1: True, 2: False}
    files = spark.createDataFrame([("a", 3), ("b", 9)], "path string, length long")
    assert R.picked_file(files).first().path == "b" and R.sample_rows(files, 1, "path").count() == 1


def test_answers_and_labels(spark):
    long = "one two three four five six seven eight nine. "
    df = spark.createDataFrame([(1, [long, "short."], [long * 2])], "id int, h array<string>, m array<string>")
    assert sorted(r.label for r in P.question_answers(df, "id", "h", "m", 5).collect()) == [0, 1]
    names = spark.createDataFrame([(None, "train_scam", "x"), (None, "non_scam", "x"), (1, "normal", "x"), (None, "a", "b"), (None, "a", "Scam-calls")], "l int, s string, d string")
    assert [r.y for r in names.select(P.inferred_label(F.col("l"), F.col("s"), F.col("d")).alias("y")).collect()] == [1, 0, 1, 0, 1]


def test_neutral_equals_python(spark):
    """The neutral form against the same rules in another regular-expression engine, with letters of all kinds beside the patterns."""
    import re

    rng = random.Random(9)
    bits = ["How is this possible?", "why on earth are we here?", "Make it make sense.", "SERIOUSLY??", "really?!", "éreally?", "wake up people", "these clowns", "OMG", "WTFé", "NEVER ever", "always", "ñalways", "vile", "Vile!", "éVILE", "THE END", "ÀBC DEF", "plain words here", "!!!", "  ", "a"]
    texts_ = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    strong = ["vile", "clowns"]

    def plain(t):
        for p in T.NEUTRALIZED:
            t = re.sub(f"(?i){p}", "", t)
        t = re.sub(T.CAPS_RUN, lambda m: m[0].lower(), t)
        t = re.sub(T.HYPERBOLE, "", t)
        t = re.sub(r"(?i)\b(" + "|".join(strong) + r")\b", "", t)
        return re.sub(r"\s+", " ", re.sub(r"([!?]){2,}", r"\1", t)).strip()

    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    for r in df.select("t", T.neutral(F.col("t"), strong).alias("n")).collect():
        assert r.n == plain(r.t), r.t


def test_few_points_are_all_kept(spark):
    pts = [(i, float(i), 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    assert K.statistical_inliers(K.nearest_distances(df, 5)).count() == 4
    # a far outlier settles too, however wide the cells must grow
    far = spark.createDataFrame([*pts, (9, 1e6, 0.0, 0.0)], df.schema)
    assert {r.id for r in K.nearest_distances(far, 3).collect()} == {0, 1, 2, 3, 9}


def test_planes_are_as_many_as_asked(spark):
    rng = random.Random(8)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(40)]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    assert G.sampled_planes(df, 500).count() == 500 and G.sampled_planes(df.limit(2), 500).count() == 0
    flat = spark.createDataFrame([(k, rng.random(), rng.random(), 0.0) for k in range(60)] + [(100 + k, rng.random(), rng.random(), 2 + rng.random()) for k in range(20)], "id int, x double, y double, z double")
    assert {r.id for r in G.without_plane(flat, 1e-6).collect()} == set(range(100, 120))


def test_blocks_give_the_same_as_one_array(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    a, b = (spark.createDataFrame([(k, vec()) for k in range(n)], "vec_id int, embedding array<double>") for n in (30, 25))
    run = lambda: (
        sorted(map(tuple, K.two_nearest(a, b, "vec_id", "embedding", 0.9).collect())), sorted((r.vec_id, round(r.max_cosine, 9), round(r.share_above, 9)) for r in comments.template_similarity(a, b).collect()),
        sorted(map(tuple, K.ordered_pairs(a, "vec_id").collect())),
    )
    one = run()
    monkeypatch.setattr(K, "MOST_IN_ONE", 4)
    monkeypatch.setattr(comments, "MOST_TEMPLATES", 4)
    assert run() == one and len(one[2]) == 30 * 29


def test_folds_keep_the_classes_even(spark):
    from collections import Counter

    from quillstone.operators import models

    df = spark.range(997).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = models.folds(df, "y", "k").collect()
    n = Counter((r.y, r.fold) for r in got)
    assert len(got) == 997 and all(max(n[y, f] for f in range(5)) - min(n[y, f] for f in range(5)) <= 1 for y in (0, 1))


def test_head_round_trip_and_choice_of_penalty(spark, tmp_path):
    from quillstone.operators import models

    rng = random.Random(7)
    rows = [(k, y, y + rng.gauss(0, 1), rng.gauss(0, 1) if k % 9 else None) for k in range(240) for y in (k % 2,)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    head = models.fit_head(df, ["a", "b"], "y", "k", n=2, penalties=(1e-4, 1.0))
    models.save_head(spark, head, str(tmp_path / "head"))
    again = models.load_head(spark, str(tmp_path / "head"))
    p = {r.k: r.p for r in head.score(df, "p").collect()}
    assert {r.k: r.p for r in again.score(df, "p").collect()} == p and M.roc_auc(head.score(df, "p"), "p", "y").first().auc > 0.7


def test_limiter_stream_equals_table(spark, tmp_path):
    rng = random.Random(5)
    hits = [(rng.randrange(3), float(rng.randrange(400)), k) for k in range(120)]
    df = spark.createDataFrame(hits, "user int, at double, id long")
    want = sorted((r.user, r.id, r.accepted) for r in rates.limited(df, "user", "at", 30.0, 2).collect())
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = rates.limited_stream(stream, "user", "at", 30.0, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user, r.id, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


LOUD = [
    "These idiots never learn! EVERYONE should be furious!!! Why is this even allowed?! Vile, disgusting trash!", "Seriously?? The WORST people always win! Pathetic scum! Make it make sense!!!", "NOBODY cares!!! Disgusting! How is this real?! Vile clowns everywhere!",
]
CALM = ["The council met on Tuesday and approved the budget for 2024.", "According to the report, rents rose by 3.5 percent in May.", "The library opens at nine and closes at six on weekdays."]


def test_features_point_the_right_way(spark):
    """Made texts of both sorts: every feature that speaks of them lies higher on its side."""
    from quillstone.operators import features
    from quillstone.plans import texts

    rows = [(k, t, int(k < 3)) for k, t in enumerate(LOUD + CALM)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    lex = features.Lexicons(
        valued=spark.createDataFrame([("vile", -0.9, 0.9), ("disgusting", -0.8, 0.8), ("pathetic", -0.7, 0.7), ("trash", -0.7, 0.7), ("furious", -0.8, 0.95), ("budget", 0.1, 0.2), ("library", 0.3, 0.1), ("opens", 0.1, 0.1), ("report", 0.0, 0.2), ("rents", -0.1, 0.2), ("approved", 0.4, 0.2)], "word string, valence double, arousal double"),
        stems=texts.words(spark, ["disgust", "pathet"], "stem"), anchors=texts.words(spark, ["people", "clowns", "idiots"]), negative=texts.words(spark, ["vile", "scum", "pathetic"]), finance=("budget",), ai_patterns=("according to",), hedges=("perhaps",),
        strong_words=["vile", "disgusting"], templates=spark.createDataFrame([(LOUD[0],)], "text string"),
    )
    got = features.comment_features(df.select("doc_id", "text"), lex, skip=("curvature", "burstiness", "perplexity")).join(df.select("doc_id", "y"), "doc_id")
    means = {r.y: r for r in got.groupBy("y").agg(*[F.avg(c).alias(c) for c in got.columns if c[:3] in ("chi", "psi")]).collect()}
    for c in ("chi_1", "chi_2", "chi_3", "chi_5", "chi_6", "chi_7", "chi_9"):
        assert means[1][c] > means[0][c], c
    assert means[0]["psi_6"] > means[1]["psi_6"]


def test_running_counts_over_very_many_scores(spark):
    rng = random.Random(1)
    rows = [(rng.random() if k % 3 else round(rng.random(), 1), int(rng.random() < 0.4)) for k in range(3000)]
    df = spark.createDataFrame(rows, "p double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df, "p", "y").first().auc - want) < 1e-12
    got = {r.threshold: r.tpr for r in M.curve_points(df, "p", "y").collect()}
    assert len(got) == len({p for p, _ in rows}) and all(abs(got[t] - sum(p >= t for p in pos) / len(pos)) < 1e-12 for t in list(got)[::97])
    assert M.roc_auc(df.limit(0), "p", "y").first().auc is None


def test_ablation_drops_what_tells(spark):
    from quillstone.operators import models

    rng = random.Random(3)
    rows = [(k, k % 2, k % 2 + rng.gauss(0, 0.5), rng.gauss(0, 1)) for k in range(160)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double")
    got = {r.dropped: r.auc for r in models.ablation(df, {"telling": ["a"], "noise": ["b"]}, "y", "k", n=2).collect()}
    assert got["all"] > 0.85 and got["noise"] > 0.85 and got["telling"] < 0.75


def test_out_of_fold_reads_its_table_once(spark):
    from quillstone.operators import models

    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda k: read.add(1) or float(k % 7), "double")
    df = spark.range(60).select(F.col("id").alias("k"), seen("id").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    out = models.out_of_fold(df, ["a"], "y", "k", n=2).collect()
    assert sorted(r.k for r in out) == list(range(60)) and all(0 < r.p < 1 for r in out)
    assert read.value == 60
