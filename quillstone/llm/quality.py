"""Quality rules: a threshold table compiled into one projection.

Metrics are Column expressions over the whole text; each rule of the table is a
bound on one metric.  `compile_rules` turns the table into one boolean and one
array of the names of the broken rules, all inside a single projection: no user
function, no shuffle, no second pass.

Defined results.  Null text: no words, so it fails the base rule.  Empty text:
likewise.  A ratio with a zero denominator is 0.  Repeated rows are judged one by
one, an empty table gives an empty table, and columns of the input that clash
with the metric names are not touched, since only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import let, text_or_empty, word_list

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "it", "for", "on", "as", "with", "was", "are", "by", "this", "from", "be", "or", "an", "a",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "est", "pour", "dans", "sur", "par", "avec",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "ein", "eine", "auf", "für",
    "el", "los", "las", "y", "o", "del", "por", "para", "con", "no", "se", "su", "al",
)


@dataclass(frozen=True)
class Rule:
    """metric must lie within [low, high]; the rule is not asked of texts with fewer than from_words words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Length, symbol, stop-word and line ratios.  Every bound is a production parameter.
DEFAULT_RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.25),
    Rule("stop_word_share", "stop_ratio", 0.01, None, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5, from_words=50),
    Rule("upper_case_words", "upper_word_ratio", None, 0.6, from_words=20),
)
#: The contract's base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def repeated_window_words(words: Column, size: int = 5) -> Column:
    """Words lying in windows of `size` words found twice or more in the text, the first included.

    O(n log n) in the text's words.  Windows are compared by a 64-bit hash of the
    word hashes, in order.  The positions are only sorted for texts that have some
    repeated window at all.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.array_sort(F.transform(same, lambda x: x["p"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(ordered, lambda s: let(marked(s), total))

    def counted(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(covered(found))

    return F.when(F.size(words) < size + 1, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), counted)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metrics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the metrics of each text."""
    t, w = F.col("_text"), F.col("_words")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col(id_column), text_or_empty(text).alias("_text")).withColumn("_words", word_list(t))
    counted = base.select(
        id_column,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup"))).alias("_lines"),
        repeated_window_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[A-Z]{2,}[^a-z\x20\x09-\x0D]*(?![^\x20\x09-\x0D])")).cast("long").alias("n_upper_words"),
    )
    n = F.col("n_words")
    return counted.select(
        "*", F.col("_lines.n_lines").alias("n_lines"), F.col("_lines.n_dup").alias("n_dup_lines"),
        _share(F.col("word_chars"), n).alias("mean_word_chars"), _share(F.col("n_symbols"), n).alias("symbol_ratio"),
        _share(F.col("n_stop_words"), n).alias("stop_ratio"), _share(F.col("n_upper_words"), n).alias("upper_word_ratio"),
        _share(F.col("_lines.n_dup"), F.col("_lines.n_lines")).alias("dup_line_ratio"),
    ).drop("_lines")


def compile_rules(rules=DEFAULT_RULES) -> Column:
    """Array of the names of the rules that a row of `metrics` breaks."""
    broken = []
    for r in rules:
        m, bad = F.col(r.metric), F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        broken.append(F.when(bad & (F.col("n_words") >= r.from_words), F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules=DEFAULT_RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Metrics, base_failed, the broken rules and kept for each document."""
    m = metrics(docs, id_column, text).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return m.withColumn("broken_rules", compile_rules(rules)).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(docs: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """docs without the rejected ones, columns as they are; one pass, the text is not shuffled."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.select(every.alias("_row"), F.col("text"))
    return judge(held, rules, id_column="_row").where("kept").select("_row.*")
