"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each (source, language, topic) cell are raked until the shares of
sources, languages and topics meet their targets; the factors give each cell its
inclusion probability for a token budget, and each document is drawn on its own by
a hash of its id (Poisson sampling).

How it runs.  Languages and topics are closed lists (parameters; what is not
listed counts as "other"), so the (language, topic) table is bounded by them.
Sources are not bounded: they stay distributed, one row each with its vector of
(language, topic) tokens.  One fitting cycle is two aggregations over that table
(languages, topics): every source's factor follows from the current language and topic
factors, and only the (language, topic) sums, a fixed count of numbers, reach the driver.

Probabilities.  p = min(1, product of the factors).  Cells that reach 1 are held there and
the others are raked again, so the expected drawn tokens meet the targets, not only
the weights.  A document is drawn once at most, so a category with few tokens bounds
the budget: it is lowered to the largest one that the targets leave feasible.

Defined results.  Null source, language or topic: "other".  Null or empty text: no
tokens, drawn with its cell's probability.  Repeated rows (equal id and text) share one draw.
Empty table: empty result.  A target for a category that has no tokens is dropped
and the rest rescaled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, text_or_empty, word_list

OTHER = "other"
LANGS = ("en", "de", "fr", "es", OTHER)
LANG_TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
#: Topics by form: the first predicate that holds names the topic.
TOPIC_RULES = (
    ("table", r"(?:\|[^|\n]*){3}"),
    ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9]"),
    ("code", r"(?i)(?:token|secret|password|api_?key)[\"']?\x20*[:=]"),
)
TOPICS = ("table", "contact", "code", "article", "note", OTHER)
TOPIC_TARGETS = {"table": 0.05, "contact": 0.05, "code": 0.05, "article": 0.7, "note": 0.15}
NOTE_WORDS = 100
#: Sources: targets are their token shares raised to this power and rescaled.
SOURCE_TEMPERATURE = 0.7
#: Share of all tokens to draw, where the targets can be met with so many.
BUDGET = 0.6
CYCLES, TOLERANCE = 60, 1e-6
#: Raking stops where so many cycles lessen the miss by under a tenth: the targets exclude each other.
STALL = 3
#: A budget is feasible if every marginal share is met to this; else it is searched by so many halvings.
MOST_MISSED, HALVINGS = 1e-4, 6
#: A cell row takes some 100 bytes: 10 MB of broadcast at most.
MOST_CELLS_TO_BROADCAST = 100_000


def topic_of(text: Column, words: Column) -> Column:
    out = F.when(words < NOTE_WORDS, F.lit("note")).otherwise(F.lit("article"))
    for name, pattern in reversed(TOPIC_RULES):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def listed(column: Column, names: tuple[str, ...]) -> Column:
    return F.when(column.isin(*names), column).otherwise(F.lit(OTHER))


def described(docs: DataFrame) -> DataFrame:
    """docs with their cell and their tokens: _source, _lang, _topic, _tokens and the text's hash _hash."""
    held = docs.withColumns({"_text": text_or_empty(), "_source": F.coalesce(F.col("source"), F.lit(OTHER)), "_lang": listed(F.col("lang"), LANGS)})
    held = held.withColumn("_tokens", F.size(word_list(F.col("_text"))).cast("long"))
    return held.withColumns({"_topic": listed(topic_of(F.col("_text"), F.col("_tokens")), TOPICS), "_hash": F.xxhash64("_text")}).drop("_text")


def _vector(cells: DataFrame) -> DataFrame:
    """One row for each source: its total and its tokens by (language, topic), row-major."""
    sums = [F.sum(F.when((F.col("_lang") == a) & (F.col("_topic") == b), F.col("_tokens")).otherwise(0)).cast("double") for a in LANGS for b in TOPICS]
    return cells.groupBy("_source").agg(F.sum("_tokens").cast("double").alias("total"), F.array(*sums).alias("cells"))


def _targets(wanted: dict[str, float], names: tuple[str, ...], have: list[float]) -> list[float]:
    """Target shares of what occurs, summing to 1; what occurs but has no target keeps its own share."""
    total = sum(have) or 1.0
    raw = [wanted.get(n, h / total) if h > 0 else 0.0 for n, h in zip(names, have, strict=True)]
    return [x / (sum(raw) or 1.0) for x in raw]


def literal(values: list[float]) -> str:
    return "array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")"


def _source_factor(factors: list[float]) -> Column:
    """The factor u of a source with sum of cells * min(1, u * factors) = wanted, exact.

    With the cells of the k largest factors held at 1, u = (wanted - their tokens) / (the others' weighted
    tokens); min() is concave, so the largest of these over k is the one where just those cells reach 1.
    """
    order = sorted((k for k, f in enumerate(factors) if f > 0), key=lambda k: factors[k])
    pairs = ", ".join(f"named_struct('c', cells[{k}], 'f', {factors[k]!r}D)" for k in order)
    step = "named_struct('cap', a.cap - x.c, 'free', a.free + x.c * x.f, 'u', IF(a.free + x.c * x.f > 0D, greatest(a.u, (wanted - a.cap + x.c) / (a.free + x.c * x.f)), a.u))"
    held = " + ".join(f"cells[{k}]" for k in order)
    return F.expr(f"aggregate(array({pairs}), named_struct('cap', {held}, 'free', 0D, 'u', 0D), (a, x) -> {step}, a -> a.u)") if order else F.lit(0.0)


def _drawn_tokens(vectors: DataFrame, factors: list[float]) -> tuple[list[float], list[float]]:
    """Over all sources, the tokens that each (language, topic) draws in cells capped at 1 and in the others."""
    rows = vectors.select(_source_factor(factors).alias("u"), F.posexplode(F.expr(f"zip_with(cells, {literal(factors)}, (c, f) -> named_struct('c', c, 'f', f))")).alias("k", "x"))
    p = F.col("u") * F.col("x.f")
    sums = rows.groupBy("k").agg(F.sum(F.when(p >= 1, F.col("x.c")).otherwise(0.0)).alias("cap"), F.sum(F.when(p >= 1, 0.0).otherwise(F.col("x.c") * p)).alias("free")).collect()
    found = {r["k"]: (r["cap"], r["free"]) for r in sums}
    both = [found.get(k) or (0.0, 0.0) for k in range(len(factors))]
    return [c for c, _ in both], [f for _, f in both]


def _step(wanted: float, cap: float, free: float) -> float:
    """The change of a factor: the uncapped part is scaled to what the capped part leaves; never beyond the solution."""
    if cap + free <= 0:
        return 1.0 if wanted > 0 else 0.0
    return (wanted - cap) / free if wanted > cap and free > 0 else wanted / (cap + free)


def rake(vectors: DataFrame, lang: list[float], topic: list[float], start: tuple[list[float], list[float]] | None = None, cycles: int = CYCLES) -> tuple[list[float], list[float], float]:
    """Factors of languages and topics for the tokens wanted of each, and the largest miss as a share of all wanted.

    Sources have their wanted tokens as a column and meet them exactly at any factors.
    """
    nl, nt, total = len(LANGS), len(TOPICS), sum(lang) or 1.0
    v, w = start or ([1.0] * nl, [1.0] * nt)
    best, misses = (v, w, float("inf")), []
    for _ in range(cycles):
        cap, free = _drawn_tokens(vectors, [x * y for x in v for y in w])
        sums = [c + f for c, f in zip(cap, free, strict=True)]
        miss = max(abs(x - t) for x, t in zip([*(sum(sums[i * nt : (i + 1) * nt]) for i in range(nl)), *(sum(sums[j::nt]) for j in range(nt))], [*lang, *topic], strict=True)) / total
        if miss < best[2]:
            best = (v, w, miss)
        misses.append(miss)
        if miss < TOLERANCE or (len(misses) > STALL and misses[-1 - STALL] < 1.1 * miss):
            break
        v = [x * _step(lang[i], sum(cap[i * nt : (i + 1) * nt]), sum(free[i * nt : (i + 1) * nt])) for i, x in enumerate(v)]
        cap, free = _drawn_tokens(vectors, [x * y for x in v for y in w])
        w = [x * _step(topic[j], sum(cap[j::nt]), sum(free[j::nt])) for j, x in enumerate(w)]
    return best


def feasible(vectors: DataFrame, budget: float, temperature: float, lang_targets=None, topic_targets=None) -> tuple[DataFrame, list[float], float]:
    """vectors with the tokens wanted of each source, the (language, topic) factors, and the budget they meet the targets at.

    No category can give more tokens than it has, so the budget is at most its share / its target.
    Where the targets do not fit together at that budget, the largest one they do is searched by halving.  Targets that exclude each other at every budget are met as nearly as raking can.
    """
    nl, nt = len(LANGS), len(TOPICS)
    tempered = F.when(F.col("total") > 0, F.pow("total", F.lit(temperature))).otherwise(0.0)
    sums = vectors.agg(F.sum(tempered).alias("z"), F.min(F.when(F.col("total") > 0, F.col("total") / tempered)).alias("least"), *[F.sum(F.get("cells", F.lit(k))).alias(f"c{k}") for k in range(nl * nt)]).first()
    have = [sums[f"c{k}"] or 0.0 for k in range(nl * nt)]
    total, z = sum(have), sums["z"] or 1.0
    if not total:
        return vectors.withColumn("wanted", F.lit(0.0)), [1.0] * (nl * nt), min(1.0, budget)
    langs, topics = [sum(have[i * nt : (i + 1) * nt]) for i in range(nl)], [sum(have[j::nt]) for j in range(nt)]
    lang, topic = _targets(lang_targets or LANG_TARGETS, LANGS, langs), _targets(topic_targets or TOPIC_TARGETS, TOPICS, topics)
    most = min([sums["least"] * z / total, *(h / total / t for h, t in zip([*langs, *topics], [*lang, *topic], strict=True) if t > 0)])

    def tried(b: float, start=None):
        rows = vectors.withColumn("wanted", tempered / F.lit(z) * F.lit(b * total))
        return rows, *rake(rows, [b * total * t for t in lang], [b * total * t for t in topic], start)

    hi = min(budget, most)
    rows, v, w, miss = tried(hi)
    if miss > MOST_MISSED:
        lo = hi * 1e-6
        low = tried(lo)
        if low[3] <= MOST_MISSED:
            for _ in range(HALVINGS):
                middle = (lo + hi) / 2
                found = tried(middle, (low[1], low[2]))
                lo, hi, low = (middle, hi, found) if found[3] <= MOST_MISSED else (lo, middle, low)
            (rows, v, w, _), hi = low, lo
    return rows, [x * y for x in v for y in w], hi


def fit(slim: DataFrame, budget: float = BUDGET, temperature: float = SOURCE_TEMPERATURE) -> DataFrame:
    """_source, _lang, _topic, weight (drawn share / present share) and probability of every cell."""
    cells = slim.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_tokens"))
    vectors = materialize(_vector(cells), "mix-sources")
    rows, factors, most = feasible(vectors, budget, temperature)
    names = [(a, b) for a in LANGS for b in TOPICS]
    pieces = F.array(*[F.struct(F.lit(a).alias("_lang"), F.lit(b).alias("_topic"), F.least(F.lit(1.0), F.col("u") * F.lit(f)).alias("p"), F.get("cells", F.lit(k)).alias("cell_tokens")) for k, ((a, b), f) in enumerate(zip(names, factors, strict=True))])
    fitted = materialize(rows.withColumn("u", _source_factor(factors)).select("_source", F.inline(pieces)), "mix-cells")
    return fitted.select("_source", "_lang", "_topic", (F.col("p") / F.lit(most or 1.0)).alias("weight"), F.when(F.col("cell_tokens") > 0, F.col("p")).otherwise(F.lit(most)).alias("probability"))


def drawn(rows: DataFrame, fitted: DataFrame, seed: int = 7) -> DataFrame:
    """rows of `described` with weight, probability and sampled.

    The cell table is broadcast only if its rows, counted here, are few; otherwise Spark joins it by shuffles.
    """
    keys = ["_source", "_lang", "_topic"]
    if fitted.count() <= MOST_CELLS_TO_BROADCAST:
        fitted = F.broadcast(fitted)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "_hash"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(fitted, keys).withColumn("sampled", draw < F.col("probability"))


def weights(docs: DataFrame, budget: float = BUDGET, seed: int = 7, temperature: float = SOURCE_TEMPERATURE) -> DataFrame:
    """Each document's cell, weight, inclusion probability and draw; texts are read once and not shuffled."""
    slim = materialize(described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")).drop("text", "lang", "source"), "mix-docs")
    out = drawn(slim, fit(slim, budget, temperature), seed)
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), "weight", "probability", "sampled")


def sample(docs: DataFrame, budget: float = BUDGET, seed: int = 7, temperature: float = SOURCE_TEMPERATURE) -> DataFrame:
    """The drawn documents, columns as they are."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = described(docs.select(every.alias("_row"), "doc_id", "text", "lang", "source")).drop("text", "lang", "source")
    return drawn(rows, fit(rows, budget, temperature), seed).where("sampled").select("_row.*")
