"""Boundaries of words in patterns: the short forms find what the long one finds."""

import math
import random

from pyspark.sql import functions as F
from quillstone.functions import text as T
from quillstone.operators import comments
from quillstone.plans.lexicons import AI_PATTERNS, HEDGES

PATTERNS = [
    *T.QUESTION_OPENERS, T.HYPERBOLE, T.CAPS_RUN, T.INNER_CAPITAL, T.CAPITAL_PAIR, T.NUMERAL, *T.NEUTRALIZED, *AI_PATTERNS, *HEDGES,
    r"(?i)\b(a|b?)\b", r"\bx?y\b", r"\bé\b", r"\x20\b[a-z]", r"[(|]\bthe", r"\b(the|(is|of))?\b", r"\ba{0,2}\b", r"(the|of )\b", r"a|b\b", r"\b\d*\b",
]


def test_short_boundaries_find_the_same(spark):
    rng = random.Random(5)
    parts = ["the", "THE", "of", "is", "a", "b", "xy", "ABC", "Ab", "é", "ß", "7", "1.5,", "_", " ", "  ", ". ", "? ", "'", "(", "|", "always", "Never", "every single time", "seriously??", "how is it?", "omg", "make it make sense."]
    df = spark.createDataFrame([("".join(rng.choice([*parts, " ", " "]) for _ in range(rng.randint(0, 14))),) for _ in range(600)], "t string")
    long_ = lambda p: F.regexp_count("t", F.lit(p.replace(r"\b", T.BOUNDARY)))
    got = df.agg(*[F.count_if(long_(p) != T.count(F.col("t"), p)).alias(str(k)) for k, p in enumerate(PATTERNS)], *[F.sum(long_(p)).alias(f"n{k}") for k, p in enumerate(PATTERNS)]).first()
    assert [p for k, p in enumerate(PATTERNS) if got[str(k)]] == [] and sum(got[f"n{k}"] > 0 for k in range(len(PATTERNS))) > 20
    # one look to one side where a letter is sure to be at the other
    assert all(T.BOUNDARY not in T.bounded(p) for p in (T.HYPERBOLE, T.CAPS_RUN, T.CAPITAL_PAIR, *T.NEUTRALIZED, *AI_PATTERNS, *HEDGES))


def test_hashed_counts_take_each_hash_once(spark):
    from base64 import b64encode
    from hashlib import md5

    texts = ["the cat, the CAT and über 7", "", "a a a b", "+ / ( )"]
    places = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").coalesce(1)
    for r in df.where("t IS NOT NULL").select("k", "t", comments.hashed_counts(F.col("t")).alias("v")).collect():
        held = [0.0] * 64
        for w in "".join(c if c.isalnum() else " " for c in r.t.lower()).split():
            h = md5(w.encode())
            held[places.index(b64encode(h.digest()).decode()[0])] += 1 if h.hexdigest()[-1] < "8" else -1
        assert r.v == held
    assert [r.v is None for r in df.orderBy("k").select(comments.hashed_counts(F.col("t")).alias("v")).collect()] == [False] * 4 + [True]
    # no pass over the text for each place
    shown = df.select(comments.hashed_counts(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in shown and "md5(" not in shown


def test_part_of_every_match():
    told = {r"\bof the\b": "of the", r"\bit'?s worth\b": "s worth", "a|bcd": "", "(ab)c": "", "ab?cd*ef": "ef", r"AB\bcdE": "cde", r"\d+ab": "", "x.y": "", "ab{0}": "", "": ""}
    assert {p: T.certain_part(p) for p in told} == told


def test_row_features_take_one_pass(spark):
    from quillstone.operators import features
    from quillstone.plans import wide

    df = spark.createDataFrame([(1, "OF THE end perhaps"), (2, " \n"), (3, None), (4, "Moreover, iT'S WORTH; of  the"), (5, "often")], "doc_id long, text string")
    skip = {name for name, *_ in features.COMMENT_FEATURES} - {"phrases", "hedges"}
    out = features.comment_features(df, wide.lexicons(spark, "/root/testdata/sf0.001"), skip=skip)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.psi_6, r.psi_8) for r in out.collect()}
    log = lambda hits, n: math.log1p(hits / (n / 20))
    assert got[2] == got[3] == (None, None) and got[5] == (0, 0)
    assert abs(got[1][0] - log(1, 4)) < 1e-12 and abs(got[1][1] - 25) < 1e-12 and abs(got[4][0] - log(2, 6)) < 1e-12
