"""Removal of repeated 20-word passages by relative Lempel-Ziv parsing.

A word goes if a window of 20 consecutive words covers it whose words also start earlier:
in a row with a smaller doc_id, or before it in the same text.

1. Reference blocks.  In every window the 6-word gram with the least hash (the leftmost of
   equals) is its anchor, so equal windows have the same anchor at the same place.  Around
   each anchor lies a block: all that windows through it can cover, 14 words before and 20
   from there.  Blocks are indexed by their gram; about every eighth word has one.  Grams
   that occur once have nothing to be matched with and are dropped.
2. Of blocks that are equal (by hash) the first in order is the reference.  Each later one
   is a factor of full length, and all of it is a duplicate span.  This resolves nearly all
   of a repeated passage without its words being read again.
3. The reference blocks that share a gram but are not equal are the edges of passages.
   Their words come together by gram, in order, and each is parsed greedily against all the
   earlier ones: from its first word the longest factor is taken that an earlier block has
   at the same place by the anchor.  A factor of 20 words or more is a duplicate span.  The
   parse goes on at the factor's end less 19 words, so windows that straddle the boundary of
   two factors are looked at too, and where there is no such factor, at the next word.
4. Each row's spans are joined and cut out.

A gram with more than MOST_BLOCKS different blocks is not parsed in one task: its windows
are compared by hash over the whole cluster, which finds the same spans.

How it runs.  An Arrow map finds the blocks (some 30 bytes for every 50 of text).  They are
shuffled once, by gram: in the order of gram, block and place, windows tell references from
later blocks and count a gram's blocks, and what meets no other block is never written.  The
rows of a gram are sorted in one task, which spills and holds no gram as a whole in memory.
The texts are shuffled once, by
document, for the edges of either way and for the result.  Hashes have 64 bits, so two different windows
are taken for equal with probability n ** 2 / 2 ** 65 for n of them.

Defined results.  Null or empty text: no words.  Texts under 20 words: nothing removed.
Very long texts: as others, a text is held by one task.  Rows with equal doc_id and equal
text are one document and get the same result; with different texts, the text's hash
decides which is earlier.  Null doc_id: before all others.  Empty table: empty result.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, text_or_empty
from quillstone.llm.suffix_dedup import POWERS, _mixed, prefixes, stretches, word_bounds

WINDOW, GRAM = 20, 6
BEFORE = WINDOW - GRAM
#: Words of a block at most; column BEFORE of a block's row holds the anchor's first word.
BLOCK = BEFORE + WINDOW
#: Blocks of a gram that one task parses; beyond, the distributed way.
MOST_BLOCKS = 20_000
#: Blocks parsed at once, if no gram alone has more.
CHUNK = 20_000
#: What tells a block's place.
OWN = ("doc_id", "text_hash", "place")
#: Bytes of texts whose blocks are looked for at once, if no text alone has more.
GROUP = 1 << 18


def text_bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def word_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where it starts."""
    begin, end = word_bounds(data)
    prefix, (_, down) = prefixes(data), POWERS.reach(len(data) + 1)
    return _mixed((prefix[end] - prefix[begin]) * down[begin]), begin


def sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums along the last axis whose differences, shifted back, are hashes of word sequences."""
    up, _ = POWERS.reach(codes.shape[-1] + 1)
    out = np.zeros((*codes.shape[:-1], codes.shape[-1] + 1), dtype=np.uint64)
    np.cumsum(codes * up[: codes.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every window's anchor: the text's number, place, words before and from there, hash of the gram and of the block.

    The texts are laid end to end, so that short ones cost no calls of their own.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    codes, begin = word_codes(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    windows = len(codes) - WINDOW + 1
    if windows <= 0:
        return (np.empty(0, dtype=np.int64),) * 6
    owner = np.searchsorted(start, begin, side="right") - 1
    total, (_, down) = sums(codes), POWERS.reach(len(codes) + 1)
    gram = _mixed((total[GRAM:] - total[:-GRAM]) * down[: len(codes) - GRAM + 1])
    # the place in the low half makes the least key the leftmost of equals
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, grams = 1, WINDOW - GRAM + 1
    while 2 * width <= grams:
        key, width = np.minimum(key[:-width], key[width:]), 2 * width
    least = np.minimum(key[:windows], key[grams - width : grams - width + windows])
    least = least[owner[:windows] == owner[WINDOW - 1 :]]
    at = np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64))
    of = owner[at]
    first = np.searchsorted(owner, of)
    low, high = np.maximum(at - BEFORE, first), np.minimum(at + WINDOW, np.searchsorted(owner, of, side="right"))
    reach = _mixed(((at - low) * BLOCK + high - at).astype(np.uint64))
    block = _mixed(_mixed((total[high] - total[low]) * down[low]) + reach)
    return of, at - first, at - low, high - at, gram[at].view(np.int64), block.view(np.int64)


FOUND = "doc_id long, text_hash long, place int, before int, after int, gram long, block long"


def found_blocks(texts: DataFrame) -> DataFrame:
    """Every block: its anchor's place in words, how far it reaches, its gram and its hash."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = (np.int32,) * 3 + (np.int64,) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, first, held, size = b.column("text"), 0, [], 0
            for k, t in enumerate(column):
                held.append(text_bytes(t))
                size += len(held[-1])
                if k + 1 == len(column) or size >= GROUP:
                    of, *found = blocks(held)
                    rows = pa.array(of + first)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_hash").take(rows), *[pa.array(x.astype(kind)) for x, kind in zip(found, kinds, strict=True)]], names=names)
                    held, first, size = [], k + 1, 0

    return texts.mapInArrow(run, FOUND)


EDGE = "doc_id long, text_hash long, place int, before int, after int, gram long, words binary"


def _edges(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted blocks with the hashes of their words, BLOCK of them, 0 where a block has none."""
    at = F.struct("place", "before", "after", "gram")
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(at).alias("wanted")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["text_hash"] == lists["_hash"]))
    names = [x.split()[0] for x in EDGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(b.column("text")):
                codes, _ = word_codes(np.frombuffer(text_bytes(t), dtype=np.uint8))
                mine = b.column("wanted").slice(k, 1).flatten()
                place, before, after = (mine.field(c).to_numpy().astype(np.int64) for c in ("place", "before", "after"))
                column = np.arange(BLOCK)
                there = (column >= (BEFORE - before)[:, None]) & (column < (BEFORE + after)[:, None])
                words = np.where(there, codes[np.clip(place[:, None] - BEFORE + column, 0, len(codes) - 1)], np.uint64(0))
                same = lambda c: b.column(c).take(pa.array(np.full(len(mine), k)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("doc_id"), same("text_hash"), *[mine.field(c) for c in ("place", "before", "after", "gram")], pa.array([w.tobytes() for w in words], pa.binary())], names=names)

    return joined.select("doc_id", "text_hash", "text", "wanted").mapInArrow(run, EDGE)


def window_codes(total: np.ndarray, rows: np.ndarray, start: int, n: int, gram: np.ndarray) -> np.ndarray:
    """Hashes of n words from a column of the given blocks, told apart by gram and column."""
    down = POWERS.reach(BLOCK + 1)[1][start]
    return _mixed(_mixed((total[rows, start + n] - total[rows, start]) * down) ^ _mixed(gram[rows] + np.uint64(start)))


def factors(words: np.ndarray, before: np.ndarray, after: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parses each block greedily against all earlier ones of its gram; rows are in order.

    Gives the factors of WINDOW words or more: row, first and last column (exclusive).
    At each column, the blocks that have a window there are an index: classes of equal
    words, which are split one word further at a time while a block that is being parsed
    still has an earlier one beside it.
    """
    total = sums(words)
    low, limit = BEFORE - before, BEFORE + after
    pointer, out = low.copy(), []
    for start in range(BEFORE + 1):
        rows = np.flatnonzero((low <= start) & (start + WINDOW <= limit))
        parsed = (pointer <= start) & (low <= start)
        longest, n = np.zeros(len(low), dtype=np.int64), WINDOW
        while len(rows) and parsed[rows].any():
            _, first, which, size = np.unique(window_codes(total, rows, start, n, gram), return_index=True, return_inverse=True, return_counts=True)
            later = first[which] != np.arange(len(rows))
            longest[rows[later]] = n
            if not parsed[rows[later]].any():
                break
            rows, n = rows[(size[which] > 1) & (limit[rows] > start + n)], n + 1
        hit = np.flatnonzero(parsed & (longest > 0))
        out.append((hit, np.full(len(hit), start), start + longest[hit]))
        pointer[parsed] = start + 1
        pointer[hit] = start + longest[hit] - WINDOW + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


SPAN = "doc_id long, text_hash long, lo int, hi int"


def _as_arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Words, reach before and after, grams and places of edges."""
    words = np.frombuffer(b"".join(rows.column("words").to_pylist()), dtype=np.uint64).reshape(-1, BLOCK)
    before, after, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("before", "after", "place"))
    return words, before, after, rows.column("gram").to_numpy().view(np.uint64), place


def _parsed(edges: DataFrame) -> DataFrame:
    """The spans of edges, gram by gram."""
    key = ["gram", "doc_id", "text_hash", "place"]

    def resolve(rows: pa.Table) -> pa.RecordBatch:
        # a document that stands in several rows is one
        own = [(rows.column(c).fill_null(-(1 << 63)) if c == "doc_id" else rows.column(c)).to_numpy() for c in key]
        rows = rows.filter(pa.array(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in own], axis=0)))))
        words, before, after, gram, place = _as_arrays(rows)
        row, first, last = factors(words, before, after, gram)
        at, lo = pa.array(row), place[row] - BEFORE
        own = [rows.column(c).combine_chunks().take(at) for c in ("doc_id", "text_hash")]
        return pa.RecordBatch.from_arrays([*own, pa.array((lo + first).astype(np.int32)), pa.array((lo + last).astype(np.int32))], names=["doc_id", "text_hash", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            if sum(map(len, held)) < CHUNK:
                continue
            # all but the last gram are whole
            rows = pa.Table.from_batches(held)
            gram = rows.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield resolve(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield resolve(pa.Table.from_batches(held))

    return edges.repartition("gram").sortWithinPartitions(*key).mapInArrow(run, SPAN)


def _compared(edges: DataFrame) -> DataFrame:
    """The same for grams with very many blocks: every window's hash is compared over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, before, after, gram, place = _as_arrays(pa.Table.from_batches([b]))
            total = sums(words)
            for start in range(BEFORE + 1):
                rows = np.flatnonzero((BEFORE - before <= start) & (start + WINDOW <= BEFORE + after))
                at, lo = pa.array(rows), (place[rows] - BEFORE + start).astype(np.int32)
                code = window_codes(total, rows, start, WINDOW, gram).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_hash").take(at), pa.array(lo), pa.array(lo + np.int32(WINDOW)), pa.array(code)], names=["doc_id", "text_hash", "lo", "hi", "window"])

    # in one plan with all that meets the texts, so that these are shuffled once; found twice, which costs less than a table of windows
    windows = edges.mapInArrow(run, SPAN + ", window long")
    first = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "lo")).alias("first")).where("n > 1").select("window", "first")
    own = F.struct("doc_id", "text_hash", "lo")
    return windows.join(first, "window").where(~own.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "lo", "hi")


def _met(every: DataFrame) -> DataFrame:
    """Blocks that others meet, of one shuffle by gram: `later` of an equal block, or the reference of one of several blocks of a gram."""
    own, by_block = F.struct(*OWN), Window.partitionBy("gram", "block").orderBy(*OWN)
    told = every.repartition("gram").withColumns({"later": ~own.eqNullSafe(F.first(own).over(by_block)), "nth": F.row_number().over(by_block)})
    told = told.withColumn("n_blocks", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(Window.partitionBy("gram")))
    return told.where(F.col("later") | ((F.col("nth") == 1) & (F.col("n_blocks") > 1))).select(*OWN, "before", "after", "gram", "later", "n_blocks")


def spans(docs: DataFrame, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, text) and the duplicate spans (doc_id, text_hash, lo, hi), in words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    met = materialize(_met(found_blocks(texts)), "rlz-met")
    found = met.where("later").select("doc_id", "text_hash", (F.col("place") - F.col("before")).alias("lo"), (F.col("place") + F.col("after")).alias("hi"))
    edges = met.where("not later")
    wide = edges.where(F.col("n_blocks") > most_blocks)
    if wide.limit(1).count():
        found = found.unionByName(_compared(_edges(texts, wide)))
    return texts, found.unionByName(_parsed(_edges(texts, edges.where(F.col("n_blocks") <= most_blocks))))


def deduplicate(docs: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 and the removed stretches (in words) of every row."""
    texts, found = spans(docs, most_blocks)
    lists = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("found")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["text_hash"] == lists["_hash"]), "left")
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:long,hi:long>>"
    kinds = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, f in zip(*[b.column(c) for c in ("doc_id", "text", "found")], strict=True):
                words = text_bytes(t).split()  # at the white space that word_bounds knows
                cut = stretches([(x["lo"], x["hi"]) for x in f.as_py() or ()])
                kept, at = [], 0
                for lo, hi in cut:
                    kept += words[at:lo]
                    at = hi
                kept += words[at:]
                rows.append((i.as_py(), len(words), len(words) - len(kept), len(cut), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in cut]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return joined.select("doc_id", "text", "found").mapInArrow(run, schema)
