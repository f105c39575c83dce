"""Patterns that are searched only in texts that hold a part of them give what the patterns alone give."""

import random
import re

from pyspark.sql import functions as F
from quillstone.functions import text as T

PHRASES = [
    "How is this real?", "WHY on earth would he?", "make it make sense.", "You can't make this up", "seriously??", "Really?", "wake up, sheeple", "these clowns", "omg", "WTF", "every single time", "Everybody", "NOBODY", "no one", "all of them",
    "THE WORST", "absolutely nothing", "insane", "Insanity", "madness", "literally", "vile", "VILE", "evil", "plain words", "ABC", "ABCdef", "été", "\u0001odd\u0001", "!!", "?!", ".", "nevermore", "everything", "KK", "İs",
]


def plain_neutral(text, strong):
    """The steps of neutral without gates, by expressions."""
    for p in T.NEUTRALIZED:
        text = F.regexp_replace(text, T.bounded(f"(?i){p}"), "")
    pieces = F.split(F.regexp_replace(text, T.bounded(f"({T.CAPS_RUN})"), "\u0001$1\u0001"), "\u0001")
    text = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.lower(x)).otherwise(x)), "")
    text = F.regexp_replace(text, T.bounded(T.HYPERBOLE), "")
    text = F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(sorted(strong)) + r")(?![\p{L}\p{N}_])", "")
    return T.stripped(F.regexp_replace(F.regexp_replace(text, r"([!?]){2,}", "$1"), r"\s+", " "))


def plain_rhetoric(text):
    found = T.sentences(text)
    n, t = F.greatest(F.lit(1), F.size(found)), F.greatest(F.lit(1), F.size(T.tokens(text)))
    return F.when(T.stripped(text) != "", F.size(F.filter(found, T.is_rhetorical)) / n + T.count(text, T.HYPERBOLE) / n + T.count(text, T.CAPS_RUN) / t + T.count(text, "!") / n)


def test_gated_patterns_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(None,), ("",), (" \n",), *((p,) for p in PHRASES)] + [(rng.choice((" ", "", "\n")).join(rng.choice(PHRASES) for _ in range(rng.randint(1, 6))),) for _ in range(400)]
    df, t, strong = spark.createDataFrame(rows, "t string").repartition(2), F.col("t"), ["vile", "evil"]
    got = df.select("t", T.neutral(t, strong).alias("n"), T.rhetoric(t).alias("r"), plain_neutral(t, strong).alias("pn"), plain_rhetoric(t).alias("pr")).collect()
    assert all(r.n == r.pn and r.r == r.pr for r in got) and sum(r.n != r.t for r in got) > 200


def test_every_match_holds_a_part():
    for pattern, parts in ((T.HYPERBOLE, T.HYPERBOLE_PARTS), *((f"(?i){p}", T.NEUTRALIZED_PARTS) for p in T.NEUTRALIZED)):
        for p in PHRASES:
            for m in re.finditer(pattern, p):
                assert any(x in m[0].lower() for x in parts), (pattern, m[0])


def test_texts_without_a_part_are_not_searched(spark):
    plan = spark.range(1).select(T.neutral(F.lit("x"), []).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN") >= 3
