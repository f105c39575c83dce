"""Flags, verdicts, request checks and account scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import numeric

#: Feature, comparison, threshold and message of each red flag.
COMMENT_FLAGS = (
    ("psi_1", "<", -1.0, "Low length-normalized perplexity z-score (psi_1 = %+.2f)"),
    ("psi_3", ">", 2.0, "DetectGPT curvature z-score = %.2f"),
    ("psi_4", ">", 0.55, "High concentration of top-10 tokens (psi_4 = %.2f)"),
    ("psi_6", ">", 0.4, "LLM lexical fingerprint hit (psi_6 = %.2f)"),
    ("psi_7", ">", 2.0, "Punctuation profile anomalous (psi_7 = %.2f)"),
    ("psi_8", ">", 1.5, "High hedging density (psi_8 = %.2f/100 tokens)"),
    ("chi_3", ">", 0.10, "High moral-vice density (chi_3 = %.3f)"),
    ("chi_4", ">", 0.20, "Strong outgroup-NEG association (chi_4 = %.2f)"),
    ("chi_5", ">", 1.0, "High rhetorical-pattern score (chi_5 = %.2f)"),
    ("chi_6", ">", 1.5, "High affect-to-info ratio (chi_6 = %.2f)"),
    ("chi_7", ">", 0.4, "Neutralization gap large (chi_7 = %.2f); affect carries the content"),
    ("chi_8", ">", 0.15, "Emotion exceeds topic baseline (chi_8 = %+.2f)"),
    ("chi_9", ">", 0.75, "Semantic match to ragebait template (chi_9 = %.2f)"),
)
CONVERSATION_FLAGS = (
    ("phi_17", ">", 0.85, "Semantic match to known scam template (max cos = %.2f)"),
    ("phi_16", ">", 0.5, "HMM Viterbi path enters Urgency stage"),
    ("phi_14", ">", 0.10, "Late-conversation financial lexicon mass = %.2f"),
    ("phi_13", ">", 1.0, "Topic-shift KL divergence = %.2f"),
    ("phi_3", ">", 2.0, "DetectGPT curvature z-score = %.2f"),
    ("phi_1", "<", 15.0, "Very low perplexity (%.1f)"),
    ("phi_11", ">", 2.0, "CUSUM sentiment-shift statistic = %.2f"),
    ("phi_9", ">", 1.0, "Scammer messages substantially longer than victim's"),
)


def red_flags(table, present: list[str]) -> Column:
    """The messages of the rules that hold; rules on absent or missing features are silent."""
    out = []
    for name, way, bound, message in table:
        if name in present:
            x = numeric.finite(F.col(name).cast("double"))
            said = F.format_string(message, x) if "%" in message else F.lit(message)
            out.append(F.when((x < bound) if way == "<" else (x > bound), said))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def verdict(p_ai: Column, p_rb: Column, cut: float = 0.5) -> Column:
    a, r = p_ai >= cut, p_rb >= cut
    return F.when(a & r, "ai_ragebait").when(a, "ai_only").when(r, "human_ragebait").otherwise("benign")


def light(p: Column) -> Column:
    return F.when(p < 0.25, "green").when(p < 0.5, "amber").otherwise("red")


def band_label(score: Column, high: float, low: float = 0.1) -> Column:
    """1 from `high` on, 0 below `low`, null between."""
    return F.when(score >= high, 1).when(score < low, 0)


def request_status(text: Column, ready: Column, most: int = 4000) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 400).when(F.length(text) > most, 413).when(~ready, 503).otherwise(200)


def first_address(forwarded: Column) -> Column:
    return F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))


def account_posterior(df: DataFrame, user: str, score: str, prior: float = 0.05, hit: float = 0.8, false: float = 0.1) -> DataFrame:
    """Posterior of each account from the sum of its joint scores; null users are skipped."""
    weight = math.log(hit * (1 - false) / (false * (1 - hit)))
    sums = df.where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.sum(score).alias("s"))
    return sums.select(user, "n", "mean_score", numeric.sigmoid(F.lit(math.log(prior / (1 - prior))) + F.col("s") * weight).alias("posterior")).orderBy(F.desc("posterior"), user)


def benign(df: DataFrame, a: str, b: str, least: int = 30) -> DataFrame:
    """Rows with both labels 0; with either label 0 if there are too few of these."""
    both, either = (F.col(a) == 0) & (F.col(b) == 0), (F.col(a) == 0) | (F.col(b) == 0)
    return df.where(both if df.agg(F.count_if(both)).first()[0] >= least else either)
