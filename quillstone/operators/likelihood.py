"""Likelihood features over an injected or a bigram language model.

The bigram model is an offline substitute, not equivalent to a neural one.  It is two
aggregations of the token table; scoring is two joins on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.shared import materialize


def with_previous(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """tokens with `prev`, unless they have it (comments.pair_table)."""
    if "prev" in tokens.columns:
        return tokens
    return tokens.withColumn("prev", F.coalesce(F.lag("token").over(Window.partitionBy(id_column).orderBy("pos")), F.lit("")))


def fit_bigrams(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """prev, token, n, n_prev, rank (1 + tokens that follow prev strictly more often).

    Ranks and sums run over the different counts of a word's followers, of which there are
    few even for the most frequent word.  Written out, so that it meets the tokens by (prev,
    token) and a frequent word is spread over its followers, and Spark may split what is
    still too large.
    """
    pairs = materialize(with_previous(tokens, id_column).groupBy("prev", "token").agg(F.count("*").alias("n")), "bigram-counts")
    sizes = pairs.groupBy("prev", "n").agg(F.count("*").alias("m"))
    above = Window.partitionBy("prev").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("prev", "n", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("prev")).alias("n_prev"), (1 + F.coalesce(F.sum("m").over(above), F.lit(0))).alias("rank"))
    return materialize(pairs.join(sizes, ["prev", "n"]).select("prev", "token", "n", "n_prev", "rank"), "bigrams")


def score(tokens: DataFrame, model: DataFrame, vocabulary: int, alpha: float = 0.1, id_column: str = "doc_id") -> DataFrame:
    """Each token's log probability and rank; unseen pairs have the smoothed rest and no rank."""
    held = with_previous(tokens, id_column).join(model, ["prev", "token"], "left")
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("n_prev", F.lit(0)) + alpha * vocabulary)
    return held.select(id_column, "pos", "token", F.ln(p).alias("log_p"), "rank")


#: Pairs that are looked up in a broadcast table (some 80 bytes each), and the part of the texts in which they are looked for.
MOST_FREQUENT, SAMPLED = 400_000, 16


def frequent_pairs(tokens: DataFrame, id_column: str = "doc_id", most: int = MOST_FREQUENT) -> DataFrame:
    """prev and token of at most `most` pairs that are frequent in a part of the texts.  A guess, on which no result hangs."""
    part = tokens.where(F.pmod(F.xxhash64(id_column), F.lit(SAMPLED)) == 0).groupBy("prev", "token").agg(F.count("*").alias("n")).where("n > 1")
    part = materialize(part, "frequent-pairs")
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each different count
    least = part.groupBy("n").agg(F.count("*").alias("m")).withColumn("m", F.sum("m").over(above)).where(F.col("m") <= most).agg(F.min("n")).first()[0]
    return part.where(F.lit(False) if least is None else F.col("n") >= least).select("prev", "token")


def own_scores(tokens: DataFrame, vocabulary: int, alpha: float = 0.1, id_column: str = "doc_id", ranks: bool = True, most: int = MOST_FREQUENT) -> DataFrame:
    """id, pos (0 or, for all that follow, 1), log_p and, if asked for, rank of each token under the model of these tokens: what score gives with fit_bigrams.

    Frequent pairs are counted and looked up where the tokens are read, by a broadcast.  A row for each of them and
    the other tokens are shuffled once, by prev, and windows there tell counts and ranks, so no model meets the tokens
    in a join.  tokens are a pair_table that is written out; they are read four times.
    """
    frequent = F.broadcast(frequent_pairs(tokens, id_column, most))
    counted = tokens.join(frequent, ["prev", "token"]).groupBy("prev", "token").agg(F.count("*").alias("n"))
    rest = tokens.join(frequent, ["prev", "token"], "left_anti").select(id_column, "prev", "token", F.lit(1).cast("long").alias("own"), F.lit(False).alias("pair"))
    rows = rest.unionByName(counted.select(F.lit(None).cast(tokens.schema[id_column].dataType).alias(id_column), "prev", "token", F.col("n").alias("own"), F.lit(True).alias("pair"))).repartition("prev")
    # sorted by prev and token: both sums come of one sort
    same, all_of = Window.partitionBy("prev", "token").orderBy("token"), (Window.unboundedPreceding, Window.unboundedFollowing)
    one = {"one": (F.row_number().over(same) == 1).cast("int")} if ranks else {}
    rows = rows.withColumns({"n": F.sum("own").over(same.rowsBetween(*all_of)), **one}).withColumn("n_prev", F.sum("own").over(Window.partitionBy("prev")))
    if ranks:
        above = Window.partitionBy("prev").orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("rank", 1 + F.coalesce(F.sum("one").over(above), F.lit(0)))
    pos, out = F.when(F.col("prev") == "", 0).otherwise(1).alias("pos"), ["n", "n_prev", *(["rank"] if ranks else [])]
    told = materialize(rows.select(id_column, F.when(F.col("pair"), F.col("prev")).alias("prev"), F.when(F.col("pair"), F.col("token")).alias("token"), pos, *out, "pair"), "own-scores")
    model = F.broadcast(told.where("pair").select("prev", "token", *out))
    held = tokens.select(id_column, "prev", "token", pos).join(model, ["prev", "token"]).select(id_column, "pos", *out)
    held = held.unionByName(told.where("not pair").select(id_column, "pos", *out))
    return held.select(id_column, "pos", F.ln((F.col("n") + alpha) / (F.col("n_prev") + alpha * vocabulary)).alias("log_p"), *out[2:])


def perplexity(scored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return scored.groupBy(id_column).agg(F.count("*").alias("n_tokens"), F.exp(-F.avg("log_p")).alias("perplexity"))


def rank_counts(scored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """n tokens, but for the first of each text, and how many of them rank among the first 10 (a) and 100 (b)."""
    return scored.groupBy(id_column).agg(F.count_if(F.col("pos") > 0).alias("n"), F.count_if((F.col("pos") > 0) & (F.col("rank") <= 10)).alias("a"), F.count_if((F.col("pos") > 0) & (F.col("rank") <= 100)).alias("b"))


def shares_of(counts: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return counts.select(id_column, F.when(F.col("n") >= 1, F.col("a") / F.col("n")).alias("top10_share"), F.when(F.col("n") >= 1, F.col("b") / F.col("n")).alias("top100_share"))


def rank_shares(scored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Shares of tokens, but for the first of each text, that rank among the first 10 and 100; null where there are none."""
    return shares_of(rank_counts(scored, id_column), id_column)


def length_baseline(scores: DataFrame, length: str = "n_tokens", value: str = "perplexity", least: int = 5) -> DataFrame:
    """Mean and population deviation of ln perplexity by length bucket of ten, for buckets of `least` rows and more."""
    held = scores.where((F.col(length) >= 4) & (F.col(value) > 1)).select((F.floor(F.col(length) / 10) * 10 + 5).cast("int").alias("center"), F.ln(value).alias("x"))
    return held.groupBy("center").agg(F.avg("x").alias("mu"), (F.stddev_pop("x") + 1e-6).alias("sigma"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def nearest_bucket(rows: DataFrame, baseline: DataFrame, length: str = "n_tokens") -> DataFrame:
    """rows with mu and sigma of the nearest centre; of equals the first by `ord`.

    The baseline is one row with an array of its buckets (at most one for ten tokens of
    length), so no pairs are made.
    """
    table = baseline.agg(F.array_sort(F.collect_list(F.struct("ord", "center", "mu", "sigma"))).alias("_buckets"))
    best = F.array_min(F.transform("_buckets", lambda b: F.struct(F.abs(b["center"] - F.col(length)).alias("d"), b["ord"].alias("ord"), b["mu"].alias("mu"), b["sigma"].alias("sigma"))))
    return rows.join(F.broadcast(table)).withColumn("_b", best).withColumns({"mu": F.col("_b.mu"), "sigma": F.col("_b.sigma")}).drop("_b", "_buckets")


def normalized_perplexity(value: Column, mu: Column, sigma: Column) -> Column:
    x = F.when(value > 1, F.ln(value))
    return F.when(mu.isNull(), x).otherwise((x - mu) / sigma)


def burstiness(scores: DataFrame, id_column: str, value: str) -> DataFrame:
    """(sigma - mu) / (sigma + mu) of a value over the parts of a text; null under two."""
    s = scores.groupBy(id_column).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("s"), F.avg(value).alias("m"))
    return s.select(id_column, F.when(F.col("n") >= 2, F.when(F.col("s") + F.col("m") == 0, 0.0).otherwise((F.col("s") - F.col("m")) / (F.col("s") + F.col("m")))).alias("burstiness"))


def curvature(scores: DataFrame, id_column: str) -> DataFrame:
    """z-score of the original's log probability among its perturbations (copy 0 is the original)."""
    s = scores.groupBy(id_column).agg(F.max(F.when(F.col("copy") == 0, F.col("log_p"))).alias("own"), F.avg(F.when(F.col("copy") > 0, F.col("log_p"))).alias("m"), F.stddev_samp(F.when(F.col("copy") > 0, F.col("log_p"))).alias("s"), F.count_if((F.col("copy") > 0) & F.col("log_p").isNotNull()).alias("k"))
    return s.select(id_column, F.when(F.col("k") >= 2, (F.col("own") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1e-8)).alias("curvature"))


#: A token is replaced where two hexadecimal digits are below this: 38 of 256 times.
REPLACED_BELOW = "26"


def spelled(df: DataFrame, id_column: str) -> Column:
    """The id as a string; of a struct its fields, joined."""
    kind = df.schema[id_column].dataType
    return F.concat_ws(":", *[F.col(f"{id_column}.{f}") for f in kind.names]) if hasattr(kind, "names") else F.col(id_column).cast("string")


def replaced(name: Column, pos: Column, copies: int) -> Column:
    """mine and before: bit c says whether this token, and the one before, is replaced in copy c; copy 0 is the original.

    The bytes of a token's digest speak for one copy each.  Some forty comparisons a token are no expression that the
    engine compiles well, so they are made by NumPy for a batch of tokens.
    """
    below, powers = int(REPLACED_BELOW, 16), np.array([1 << c for c in range(1, copies + 1)], dtype=np.int64)

    def taken(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        nothing = b"\xff" * 32
        for names, places in batches:
            mine, before, last = [], [], (None, 0, nothing)
            for n, k in zip(names.to_pylist(), places.to_pylist(), strict=True):
                head = "" if n is None else f"{n}:"
                told = last[2] if last[:2] == (n, k - 1) else sha256(f"{head}{k - 1}".encode()).digest() if k > 0 else nothing
                last = (n, k, sha256(f"{head}{k}".encode()).digest())
                mine.append(last[2])
                before.append(told)
            bits = [(np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, 32)[:, :copies] < below) @ powers for x in (mine, before)]
            yield pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in bits], names=["mine", "before"])

    return F.arrow_udf(taken, "mine int, before int")(name, pos)


#: Words with their likeliest followers that may be broadcast (some 80 bytes each).
MOST_BROADCAST_WORDS = 1_000_000
#: Copies that one hash of 64 hexadecimal digits can speak for, in the bits of an integer.
MOST_COPIES = 30


def copy_scores(tokens: DataFrame, model: DataFrame, vocabulary: int, copies: int = 10, alpha: float = 0.1, id_column: str = "doc_id") -> DataFrame:
    """id, copy and log_p of each text and its copies, in which hash-chosen tokens are replaced by the likeliest follower of the token before.

    At a place only four pairs can stand (the token or its replacement, after the token
    before or its replacement), whatever the number of copies.  That of the token before and
    the replacement is told by the token before and travels with the original pair; the others
    are looked up once.  A text's row has a sum for each copy, to which a pair is added where its
    bit is set, so pairs are not repeated by copies.  Sums are rounded to nine digits, so that copies of equal tokens are
    equal.  tokens are a pair_table.
    """
    best = model.groupBy("prev").agg(F.max_by(F.struct(F.col("token").alias("fill"), "n", "n_prev"), F.struct("n", "token")).alias("b")).select("prev", "b.*")
    best = materialize(best, "fills")
    few = F.broadcast if best.count() <= MOST_BROADCAST_WORDS else lambda df: df
    p = lambda n, n_prev: F.ln((F.coalesce(n, F.lit(0)) + alpha) / (F.coalesce(n_prev, F.lit(0)) + alpha * vocabulary))
    told = best.select("prev", "fill", p("n", "n_prev").alias("_fill_p"))
    marked = tokens.withColumn("_r", replaced(spelled(tokens, id_column), F.col("pos"), copies))
    held = marked.join(few(told), "prev", "left").join(few(best.select(F.col("prev").alias("prev2"), F.col("fill").alias("_before"))), "prev2", "left")
    everywhere = (1 << (copies + 1)) - 1
    fill_before = F.when(F.col("pos") == 0, F.lit("")).otherwise(F.coalesce("_before", "prev"))
    marked = held.select(id_column, "prev", "token", "fill", "_fill_p", fill_before.alias("fill_before"), "_r.mine", "_r.before")
    no = lambda bits: F.lit(everywhere) - F.col(bits)
    known, fill, none = F.col("_fill_p").isNotNull(), F.coalesce("fill", "token"), F.lit(0)
    pairs = [
        ("prev", F.col("token"), F.when(known, no("before").bitwiseAND(no("mine"))).otherwise(no("before")), F.when(known, no("before").bitwiseAND(F.col("mine"))).otherwise(none), F.col("_fill_p")),
        ("fill_before", F.col("token"), F.col("before").bitwiseAND(no("mine")), none, F.lit(None).cast("double")), ("fill_before", fill, F.col("before").bitwiseAND(F.col("mine")), none, F.lit(None).cast("double")),
    ]
    three = F.array(*[F.struct(F.col(x).alias("prev"), y.alias("token"), w.alias("which"), v.alias("which_fill"), q.alias("fill_p")) for x, y, w, v, q in pairs])
    asked = marked.select(id_column, F.inline(three)).where("which > 0").join(model, ["prev", "token"], "left").select(id_column, "which", p("n", "n_prev").alias("log_p"), "which_fill", "fill_p")
    of = lambda bits, c, v: F.when(F.getbit(bits, F.lit(c)) == 1, F.col(v)).otherwise(0.0)
    sums = asked.groupBy(id_column).agg(*[F.sum(of("which", c, "log_p") + of("which_fill", c, "fill_p")).alias(f"_s{c}") for c in range(copies + 1)])
    return sums.select(id_column, F.posexplode(F.array(*[F.round(f"_s{c}", 9) for c in range(copies + 1)])).alias("copy", "log_p"))


@dataclass
class Bigrams:
    """The bigram model behind the interface that the features use (see backends.Likelihood)."""

    model: DataFrame
    vocabulary: int = 5000
    alpha: float = 0.1

    @classmethod
    def fit(cls, tokens: DataFrame, id_column: str, vocabulary: int = 5000, alpha: float = 0.1) -> Bigrams:
        return cls(fit_bigrams(tokens, id_column), vocabulary, alpha)

    def score(self, tokens: DataFrame, id_column: str) -> DataFrame:
        return score(tokens, self.model, self.vocabulary, self.alpha, id_column)

    def copy_scores(self, tokens: DataFrame, id_column: str, copies: int) -> DataFrame:
        return copy_scores(tokens, self.model, self.vocabulary, copies, self.alpha, id_column)
