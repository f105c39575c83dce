"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

A seed is a fixed mask laid on the words: it hashes some positions and ignores those
between.  Each item is given the masks for the number of substitutions that the rule
below allows it; they were chosen so that whatever places those take, some mask lies on
equal words only (tests go through all patterns), so nothing is missed.  The seeds of all
benchmark items meet those of all training windows; around each hit the item is laid
along the document on the hit's diagonal, and the words are compared.  A hit counts if
some stretch of 20 words (the whole item, if it is shorter) agrees in 80 percent.

How it runs.  A document's words become 64-bit hashes, its windows are generated,
probed against the benchmark's seeds and verified in one stage; texts are never
shuffled.  Equal items are searched once.  The seeds are broadcast in blocks of a bounded
number (one block for up to MOST_SEEDS; each further block is another pass over the
documents).  Only the first of successive hits of a mask on a diagonal is verified, and
only verified hits leave the stage, where they are reduced to the best one for each
document and item.

Defined results.  Words are runs of letters and digits, in lower case; in scripts
written without spaces each letter is a word.  Null or empty texts: no hits.  Items
under 5 words must occur as they are.  Equal items: each is reported.  Equal overlaps:
the first place in the document.  Repeated rows: reported once for each (doc_id,
item_id).  Empty tables: empty result.  Extra columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, text_or_empty

STRETCH, LEAST_PERCENT = 20, 80
#: Seeds in one broadcast: 24 bytes each, some 100 MB in a hash table.
MOST_SEEDS = 1_000_000
#: Ids in one broadcast: 16 bytes each.
MOST_IDS = 500_000


#: Letters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
#: Positions that a mask reads, by the substitutions that the rule allows an item.
MASKS = {
    1: ((0, 1, 3), (0, 2, 3)),
    2: ((0, 1, 3, 4, 6), (0, 1, 5, 6, 7), (0, 1, 2, 4, 5)),
    3: ((0, 1, 5, 6, 8), (0, 2, 3, 4, 6)),
    4: ((0, 1, 5, 6, 8), (0, 2, 3, 4, 6)),
}


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n words: whole if no substitution is allowed."""
    n = min(n, STRETCH)
    wrong = n - -(-n * LEAST_PERCENT // 100)
    return MASKS[wrong] if wrong else (tuple(range(n)),)


#: All masks; a mask's number is its place here.
ALL_MASKS = tuple(dict.fromkeys(m for n in range(1, STRETCH + 1) for m in masks_for(n)))


def word_hashes(text: Column) -> Column:
    low = F.lower(text)
    parts = F.when(low.rlike(UNSPACED), F.split(low, rf"[^\p{{L}}\p{{N}}]+|(?<={UNSPACED})|(?={UNSPACED})")).otherwise(F.split(low, r"[^\p{L}\p{N}]+"))
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def _seed(h: Column, at: Column, number: int) -> Column:
    """The hash under a mask from a place on; past the end of the words there are nulls, which no benchmark seed has."""
    return F.xxhash64(F.lit(number), *[F.get(h, at + o) for o in ALL_MASKS[number]])


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """One seed for each mask of an item and each place where it fits: seed, mask, item, item_at."""
    size = F.least(F.size("item_words"), F.lit(STRETCH))
    lists = F.array(*[F.array(*[F.struct(F.lit(ALL_MASKS.index(m)).alias("mask"), F.lit(m[-1] + 1).alias("span")) for m in masks_for(n)]) for n in range(1, STRETCH + 1)])
    masked = items.where(F.size("item_words") > 0).select("*", F.inline(F.get(lists, size - 1)))
    placed = masked.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("span"))))
    seed = F.coalesce(*[F.when(F.col("mask") == k, _seed(F.col("item_words"), F.col("item_at"), k)) for k in range(len(ALL_MASKS))])
    return placed.select(seed.alias("seed"), "mask", "item", "item_at")


def _windows(rows: DataFrame, numbers: list[int]) -> DataFrame:
    """The seeds of every place of a document, for the masks that the benchmark has."""
    placed = rows.where(F.size("words") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 1)))
    seeds = F.array(*[F.struct(F.lit(k).alias("mask"), _seed(F.col("words"), F.col("at"), k).alias("seed")) for k in numbers])
    return placed.select("*", F.inline(seeds))


def _follows_a_hit(numbers: list[int]) -> Column:
    """Whether the same mask one word earlier on the diagonal hits too."""
    same = lambda o: F.get("words", F.col("at") + (o - 1)) == F.get("item_words", F.col("item_at") + (o - 1))
    before = F.lit(False)
    for k in numbers:
        hits = same(0)
        for o in ALL_MASKS[k][1:]:
            hits = hits & same(o)
        before = F.when(F.col("mask") == k, hits).otherwise(before)
    return (F.col("at") > 0) & (F.col("item_at") > 0) & F.coalesce(before, F.lit(False))


def _best_stretch() -> Column:
    """n_matched and n_compared of the best stretch of the item along the hit's diagonal, and all matches."""
    shift = F.col("at") - F.col("item_at")
    size = F.least(F.lit(STRETCH), F.size("item_words"))
    flags = F.transform("item_words", lambda x, j: F.coalesce((F.when(shift + j >= 0, F.get("words", shift + j)) == x).cast("int"), F.lit(0)))

    def best(f: Column) -> Column:
        counts = F.transform(F.sequence(F.lit(0), F.size(f) - size), lambda k: F.aggregate(F.slice(f, k + 1, size), F.lit(0), lambda a, x: a + x))
        return F.struct(F.array_max(counts).alias("n_matched"), size.alias("n_compared"), F.aggregate(f, F.lit(0), lambda a, x: a + x).alias("n_matched_item"))

    return F.transform(F.array(flags), best)[0]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text hash, item_id and the best overlap of every contaminated pair."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), word_hashes(text_or_empty()).alias("words"))
    every = materialize(benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(text_or_empty()).alias("item_words")).withColumn("item", F.xxhash64("item_words")), "bench-items")
    items = materialize(every.dropDuplicates(["item"]).select("item", "item_words"), "bench-distinct")
    seeds = materialize(benchmark_seeds(items), "bench-seeds")
    counts = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}
    blocks = max(1, -(-sum(counts.values()) // MOST_SEEDS))
    numbers = sorted(counts) or [0]
    windows = _windows(rows, numbers)
    found = None
    for k in range(blocks):
        mine = F.pmod("item", F.lit(blocks)) == k
        near = windows.join(F.broadcast(seeds.where(mine)), ["seed", "mask"]).join(F.broadcast(items.where(mine)), "item")
        hits = near.where(~_follows_a_hit(numbers)).select("doc_id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift"), _best_stretch().alias("s"))
        hits = hits.where(100 * F.col("s.n_matched") >= LEAST_PERCENT * F.col("s.n_compared"))
        found = hits if found is None else found.unionByName(hits)
    order = F.struct("s.n_matched_item", "s.n_matched", (-F.col("shift")).alias("first"), "s.n_compared")
    best = found.groupBy("doc_id", "text_hash", "item").agg(F.max(order).alias("b")).join(every.select("item", "item_id").distinct(), "item")
    return best.select("doc_id", "text_hash", "item_id", F.col("b.n_matched").cast("long").alias("n_matched"), F.col("b.n_compared").cast("long").alias("n_compared"), F.col("b.n_matched_item").cast("long").alias("n_matched_item"), (-F.col("b.first")).cast("long").alias("first_word"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text hash) is in ids; broadcast if the ids, counted here, are few, else by shuffles."""
    gone = materialize(ids.select(F.struct("doc_id", "text_hash").alias("gone_key")).distinct(), "gone")
    if gone.count() <= MOST_IDS:
        gone = F.broadcast(gone)
    # the row travels as one struct, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash")).alias("row_key"))
    return rows.join(gone, F.col("row_key").eqNullSafe(F.col("gone_key")), "left_anti").select("row.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified overlap, columns as they are."""
    return without(docs, overlaps(docs, benchmark))
