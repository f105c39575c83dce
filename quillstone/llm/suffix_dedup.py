"""Removal of repeated 400-byte strings with a sparse, deep-shallow sorted suffix array.

A byte goes if some 400-byte string that covers it also starts anywhere else.
Beside that, passages of 50 words that stand anywhere else byte for byte, which may
take fewer bytes than 400, are found and reported, not removed.

1. Anchors.  In every window (of 400 bytes, or of 50 words) the 48-byte gram with the
   least hash (the leftmost of equals) is its anchor.  Equal windows have the same
   anchor at the same place, so all repeats meet at anchors, and about one byte in 135
   is an anchor.  An anchor's context is what windows through it can cover: 352 bytes
   before its start and 400 from there, or more where 50 words reach further.
2. Anchors whose gram occurs once are dropped.  If the whole context occurs again
   (by its hash), all of it goes, and no byte of it needs to be read again.
3. The rest are edges of repeats.  One context for each distinct one is brought
   together by gram, and sorted there: suffixes that start at eight places, 50 bytes
   apart, are ordered by multikey quicksort over 8-byte characters to a shallow depth
   of 64; groups that still agree go through blind tries, which look at branching
   bytes only and compare each suffix with one leaf.  Suffixes that agree in 350
   bytes make a class: every repeat of 400 bytes that runs through the anchor shows
   in one of the eight.
4. In a class, the 51 windows of 400 bytes that hold the common 350 are compared by
   hash; those found twice are covered.  A gram's windows of 50 words are compared by
   hash likewise.
5. Each document's covered stretches are joined and cut out.

A gram with more than MOST_CONTEXTS distinct contexts is not sorted in one task: its
windows' hashes are counted by a distributed aggregation instead, which is exact and
linear as well.  Hashes have 64 bits.

How it runs.  One Arrow map finds the anchors.  Anchors (some 30 bytes for each 135
of text) are grouped twice; the texts are shuffled once, by document, for the edge
contexts and again for the result (Spark reuses the exchange).  Both sides of the
joins back to the anchors are plain tables, so that Spark may split a gram that very
many anchors have over several tasks.

Defined results.  Null text: empty.  Texts under 400 bytes: nothing removed.  Texts
under 50 words (runs of what is not white space): no passages.  Repeated
rows: each is a copy of the other.  Rows with equal doc_id and different text are told
apart by the text's hash.  Empty table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, text_or_empty

LENGTH, GRAM = 400, 48
BEFORE = LENGTH - GRAM
STEP, SHALLOW = 50, 64
CORE = LENGTH - STEP
#: Words of a passage that is reported where it repeats.
PASSAGE = 50
STARTS = tuple(range(0, BEFORE, STEP))
#: Distinct contexts of a gram that one task sorts (45 MB of text); beyond, the distributed way.
MOST_CONTEXTS = 60_000
#: Bytes of contexts sorted at once, and contexts whose words are looked at at once.
CHUNK, FEW = 6 << 20, 1000
#: Bytes of texts whose anchors are looked for at once, if no text alone has more.
GROUP = 1 << 17
#: Sorts of covered stretches.
REMOVED, REPEATED = 0, 1

_RNG = np.random.default_rng(41)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the multiplier and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, base in (("up", _M), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = Powers()


def prefixes(data: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences, shifted back, are hashes of substrings; along the last axis."""
    up, _ = POWERS.reach(data.shape[-1] + 1)
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def least_in(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The places of the least keys in the windows of BEFORE + 1 keys where `whole` holds, and in those from lo to hi (inclusive); each place once.

    One doubling of the keys is held at a time.  Windows are in order, so their places are too.
    """
    level, fixed = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1, (BEFORE + 1).bit_length() - 1
    many = len(whole) if whole.any() else 0
    best, found, width = np.empty(len(lo), dtype=key.dtype), [], 1
    for k in range(max(int(level.max(initial=-1)), fixed if many else -1) + 1):
        mine = np.flatnonzero(level == k)
        best[mine] = np.minimum(key[lo[mine]], key[hi[mine] - width + 1])
        if k == fixed and many:
            found.append(np.minimum(key[:many], key[BEFORE + 1 - width : BEFORE + 1 - width + many])[whole])
        key, width = np.minimum(key[: max(len(key) - width, 0)], key[width:]), 2 * width
    places = [(x[np.concatenate(([True], x[1:] != x[:-1]))] & np.uint64(0xFFFFFFFF)).astype(np.int64) for x in (*found, best) if len(x)]
    return np.unique(np.concatenate((np.empty(0, dtype=np.int64), *places)))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    word = np.concatenate(([False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def same_owner(owner: np.ndarray) -> np.ndarray:
    """The words that a window of PASSAGE words starts with, all of one owner."""
    return np.flatnonzero(owner[: max(len(owner) - PASSAGE + 1, 0)] == owner[PASSAGE - 1 :])


def passage_reach(begin: np.ndarray, end: np.ndarray, owner: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the windows of PASSAGE words that hold the gram at each place; equal where there is none."""
    if not len(begin):
        return at, at
    first = np.searchsorted(begin, at, side="right") - 1  # the word that the gram starts in
    last = np.searchsorted(end, at + GRAM)  # the word that it ends in
    lowest = np.maximum(last - PASSAGE + 1, np.searchsorted(owner, of))
    highest = np.minimum(first, np.searchsorted(owner, of, side="right") - PASSAGE)
    some = (first >= 0) & (lowest <= highest)
    lowest, highest = np.where(some, lowest, 0), np.where(some, highest, 0)
    return np.where(some, begin[lowest], at), np.where(some, end[np.minimum(highest + PASSAGE - 1, len(end) - 1)], at)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the anchors of all windows: the text's number, place, reach before and after it, reach of words before and after it, gram and context.

    The texts are laid end to end, a space between, so that short ones cost no calls of their own.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    n = len(data) - GRAM + 1
    nothing = np.empty(0, dtype=np.int64)
    if n <= 0:
        return (nothing,) * 8
    begin, end = word_bounds(data)
    owner = np.searchsorted(start, begin, side="right") - 1
    prefix, (_, down) = prefixes(data), POWERS.reach(len(data) + 1)
    gram = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[:n])
    # the place in the low half makes the least key the leftmost of equals
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    whole = np.zeros(max(len(data) - LENGTH + 1, 0), dtype=bool)  # where a window lies in one text
    for lo, m in zip(start[size >= LENGTH], size[size >= LENGTH], strict=True):
        whole[lo : lo + m - LENGTH + 1] = True
    passage = same_owner(owner)
    at = least_in(key, begin[passage], end[passage + PASSAGE - 1] - GRAM, whole)
    of = np.searchsorted(start, at, side="right") - 1
    w_lo, w_hi = passage_reach(begin, end, owner, at, of)
    lo, hi = np.minimum(np.maximum(at - BEFORE, start[of]), w_lo), np.maximum(np.minimum(at + LENGTH, (start + size)[of]), w_hi)
    # equal contexts have the same windows, so how far either sort reaches is part of them
    reach = _mixed((at - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - at).astype(np.uint64)) + _mixed((at - w_lo).astype(np.uint64) * np.uint64(1 << 32) + (w_hi - at).astype(np.uint64) + np.uint64(1 << 31))
    context = _mixed(_mixed((prefix[hi] - prefix[lo]) * down[lo]) + reach)
    return of, at - start[of], at - lo, hi - at, at - w_lo, w_hi - at, gram[at].view(np.int64), context.view(np.int64)


ANCHOR = "doc_id long, text_hash long, place int, before int, after int, words_before int, words_after int, gram long, context long"


def found_anchors(docs: DataFrame) -> DataFrame:
    """Every anchor's place, gram and context (hash), how far the context reaches, and how far the windows of words do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int32,) * 5 + (np.int64,) * 2
        names = [x.split()[0] for x in ANCHOR.split(", ")]
        for b in batches:
            texts, first, held, size = b.column("text"), 0, [], 0
            for k, t in enumerate(texts):
                held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if k + 1 == len(texts) or size >= GROUP:
                    of, *columns = anchors(held)
                    rows = pa.array(of + first)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_hash").take(rows), *[pa.array(x.astype(kind)) for x, kind in zip(columns, kinds, strict=True)]], names=names)
                    held, first, size = [], k + 1, 0

    return docs.mapInArrow(run, ANCHOR)


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian character."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)


def shallow_sort(data: np.ndarray, start: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, breadth first: groups are split on one 8-byte character after the other.

    Gives the suffixes that still agree with others of their label, and their groups.
    """
    left = np.arange(len(start))
    for depth in range(0, SHALLOW, 8):
        if not len(left):
            break
        w = words_at(data, start[left] + depth)
        order = np.lexsort((w, label))
        l, w, left = label[order], w[order], left[order]
        group = np.cumsum(np.concatenate(([0], (l[1:] != l[:-1]) | (w[1:] != w[:-1]))))
        many = np.bincount(group)[group] > 1
        left, label = left[many], group[many]
    return left, label


def deep_sort(data: np.ndarray, start: np.ndarray, left: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blind tries over the groups that agree to the shallow depth, all tries grown at once.

    Each group compares its suffixes with one leaf; where a suffix leaves that leaf's
    path is its node, the byte there its branch, and the suffixes of a branch go on
    as a group of their own.  Gives the suffixes that agree in CORE bytes with others
    and their classes.
    """
    members, classes, number = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while len(left):
        order = np.argsort(label, kind="stable")
        left, label = left[order], label[order]
        first = np.concatenate(([True], label[1:] != label[:-1]))
        group = np.cumsum(first) - 1
        leaf = left[first][group]
        node = np.full(len(left), CORE)
        branch = np.zeros(len(left), dtype=np.int64)
        going = np.flatnonzero(leaf != left)
        for depth in range(SHALLOW, CORE, 8):
            if not len(going):
                break
            mine = words_at(data, start[left[going]] + depth)
            differ = mine ^ words_at(data, start[leaf[going]] + depth)
            off = differ != 0
            same = sum((differ[off] < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
            out = going[off]
            node[out] = np.minimum(depth + same, CORE)
            branch[out] = ((mine[off] >> (np.uint64(56) - np.uint64(8) * same.astype(np.uint64))) & np.uint64(255)).astype(np.int64)
            going = going[~off]
        whole = node >= CORE
        count = np.bincount(group[whole], minlength=group[-1] + 1)
        several = whole & (count[group] > 1)
        members.append(left[several])
        classes.append(number + group[several])
        number += int(group[-1]) + 1
        rest = ~whole
        left, key = left[rest], (group[rest] * (CORE + 1) + node[rest]) * 256 + branch[rest]
        _, label, size = np.unique(key, return_inverse=True, return_counts=True)
        many = size[label] > 1
        left, label = left[many], label[many]
    return np.concatenate(members), np.concatenate(classes)


def repeats(contexts: list[bytes], before: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, relative to the anchor, of the windows of each context that another of its group has too.

    Contexts without any have first > last.
    """
    n = np.array([len(c) for c in contexts], dtype=np.int64)
    begin = np.cumsum(n) - n
    data = np.frombuffer(b"".join(contexts) + bytes(LENGTH + 16), dtype=np.uint8)
    t = np.array(STARTS, dtype=np.int64)
    fits = (t[None, :] <= before[:, None]) & (CORE - t[None, :] <= (n - before)[:, None])
    owner, which = np.nonzero(fits)
    start = begin[owner] + before[owner] - t[which]
    left, label = shallow_sort(data, start, group[owner] * len(STARTS) + which)
    members, classes = deep_sort(data, start, left, label)
    first, last = np.full(len(n), LENGTH), np.full(len(n), -LENGTH)
    if not len(members):
        return first, last
    who, base = owner[members], begin[owner[members]]
    at, own = start[members] - base, _mixed(classes.astype(np.uint64) + np.uint64(1))
    top = np.uint64(pow(_M, LENGTH - 1, 1 << 64))
    # the window that ends STEP bytes after the core, then one byte to the left at a time, its hash rolled along
    h = np.zeros(len(members), dtype=np.uint64)
    place = start[members]
    for k in range(LENGTH - 1, -1, -1):
        h = h * np.uint64(_M) + _BYTE[data[np.minimum(place + k, len(data) - 1)]]
    for a in range(STEP + 1):
        lo = at - a
        ok = np.flatnonzero((lo >= 0) & (lo + LENGTH <= n[who]))
        if len(ok):
            _, back, size = np.unique(_mixed(h[ok]) ^ own[ok], return_inverse=True, return_counts=True)
            hit = ok[size[back] > 1]
            np.minimum.at(first, who[hit], lo[hit] - before[who[hit]])
            np.maximum.at(last, who[hit], lo[hit] - before[who[hit]])
        gone = _BYTE[data[np.clip(place - a + LENGTH - 1, 0, len(data) - 1)]] * top
        h = (h - gone) * np.uint64(_M) + _BYTE[data[np.maximum(place - a - 1, 0)]]
    return first, last


def repeated_passages(contexts: list[bytes], before: np.ndarray, words_before: np.ndarray, words_after: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive), relative to the anchor, of each context's windows of PASSAGE words that its group has twice or more.

    Contexts without any have first > last.
    """
    first, last = np.full(len(contexts), 1 << 30), np.full(len(contexts), -(1 << 30))
    lows, highs, whose, codes = [], [], [], []
    for k in range(0, len(contexts), FEW):
        parts = [c[b - x : b + y] for c, b, x, y in zip(contexts[k : k + FEW], before[k : k + FEW], words_before[k : k + FEW], words_after[k : k + FEW], strict=True)]
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        if not len(data):
            continue
        low, high = word_bounds(data)
        owner = np.searchsorted(begin, low, side="right") - 1
        i = same_owner(owner)
        lo, hi, own = low[i], high[i + PASSAGE - 1], owner[i]
        prefix, (_, down) = prefixes(data), POWERS.reach(len(data) + 1)
        # a window that holds its gram twice is in two contexts, so its place by the anchor belongs to it
        lows.append(lo - begin[own] - words_before[k + own])
        codes.append(_mixed(_mixed(_mixed((prefix[hi] - prefix[lo]) * down[lo]) + (hi - lo).astype(np.uint64)) + lows[-1].view(np.uint64)))
        highs.append(hi - begin[own] - words_before[k + own])
        whose.append(k + own)
    if whose:
        lo, hi, who = np.concatenate(lows), np.concatenate(highs), np.concatenate(whose)
        code = _mixed(np.concatenate(codes) + _mixed(group[who].astype(np.uint64) + np.uint64(1)))
        _, back, size = np.unique(code, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(size[back] > 1)
        np.minimum.at(first, who[hit], lo[hit])
        np.maximum.at(last, who[hit], hi[hit])
    return first, last


INTERVAL = "doc_id long, text_hash long, kind int, lo int, hi int"
CONTEXT = "doc_id long, text_hash long, place int, before int, words_before int, words_after int, gram long, bytes binary"


def _contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts, cut out of their documents."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "before", "after", "words_before", "words_after", "gram")).alias("wanted")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["text_hash"] == lists["_hash"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, t, wanted in zip(*[b.column(c) for c in ("doc_id", "text_hash", "text", "wanted")], strict=True):
                data = (t.as_py() or "").encode("utf-8", "surrogatepass")
                i, h = i.as_py(), h.as_py()
                for w in wanted.as_py():
                    p = w["place"]
                    rows.append((i, h, p, w["before"], w["words_before"], w["words_after"], w["gram"], data[p - w["before"] : p + w["after"]]))
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CONTEXT.split(", ")])

    return joined.select("doc_id", "text_hash", "text", "wanted").mapInArrow(run, CONTEXT)


def _sorted_edges(contexts: DataFrame) -> DataFrame:
    """Covered stretches of contexts, gram by gram, in chunks of bounded size."""

    def resolve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, hashes, place, before, words_before, words_after, gram, data = zip(*rows, strict=True)
        _, group = np.unique(np.array(gram, dtype=np.int64), return_inverse=True)
        place, before, words_before, words_after = (np.array(x, dtype=np.int64) for x in (place, before, words_before, words_after))
        first, last = repeats(list(data), before, group)
        for kind, lo, hi in ((REMOVED, first, last + LENGTH), (REPEATED, *repeated_passages(list(data), before, words_before, words_after, group))):
            hit = np.flatnonzero(lo < hi)
            take = lambda x: pa.array([x[k] for k in hit], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([take(ids), take(hashes), pa.array(np.full(len(hit), kind, np.int32)), pa.array((place + lo)[hit].astype(np.int32)), pa.array((place + hi)[hit].astype(np.int32))], names=[x.split()[0] for x in INTERVAL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and size >= CHUNK and row[6] != held[-1][6]:
                    yield from resolve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield from resolve(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, INTERVAL)


def _counted_edges(contexts: DataFrame) -> DataFrame:
    """The same for grams with very many contexts: every window's hash is counted over the cluster."""
    schema = "doc_id long, text_hash long, place int, kind int, lo int, hi int, window long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, place, before, words_before, words_after, gram, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = np.frombuffer(raw, dtype=np.uint8)
                low, high = word_bounds(data[before - words_before : before + words_after])
                many, some = max(len(data) - LENGTH + 1, 0), max(len(low) - PASSAGE + 1, 0)
                lo = np.concatenate((np.arange(many), low[:some] + before - words_before))
                hi = np.concatenate((np.arange(many) + LENGTH, high[len(high) - some :] + before - words_before))
                prefix, (_, down) = prefixes(data), POWERS.reach(len(data) + 1)
                kind = np.repeat(np.array([REMOVED, REPEATED], dtype=np.int32), (many, some))
                code = np.array([gram], dtype=np.int64).view(np.uint64)
                window = _mixed(_mixed((prefix[hi] - prefix[lo]) * down[lo]) + _mixed((hi - lo).astype(np.uint64) * np.uint64(2) + kind.astype(np.uint64)) + _mixed((lo - before).view(np.uint64)) * np.uint64(_M) + code)
                n = many + some
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([h] * n, pa.int64()), pa.array([place] * n, pa.int32()), pa.array(kind), pa.array((lo - before).astype(np.int32)), pa.array((hi - before).astype(np.int32)), pa.array(window.view(np.int64))], names=[x.split()[0] for x in schema.split(", ")])

    windows = contexts.mapInArrow(run, schema)
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    hit = windows.join(twice, "window").groupBy("doc_id", "text_hash", "place", "kind").agg(F.min("lo").alias("a"), F.max("hi").alias("z"))
    return hit.select("doc_id", "text_hash", "kind", (F.col("place") + F.col("a")).alias("lo"), (F.col("place") + F.col("z")).alias("hi"))


def covered(docs: DataFrame, most_contexts: int = MOST_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, text) and the covered stretches (doc_id, text_hash, kind, lo, hi), in bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    every = materialize(found_anchors(texts), "sd-anchors")
    grams = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")).where("n > 1").select("gram", (F.col("c0") != F.col("c1")).alias("mixed"))
    again = materialize(every.join(materialize(grams, "sd-grams"), "gram"), "sd-again")
    reach = ("place", "before", "after", "words_before", "words_after")
    distinct = again.groupBy("gram", "context", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", *reach)).alias("r"))
    distinct = materialize(distinct, "sd-contexts")
    whole = again.join(distinct.where("n > 1").select("gram", "context"), ["gram", "context"])
    of = lambda kind, lo, hi, some: F.when(some, F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi")))
    place, before, after = F.col("place"), F.least("before", F.lit(BEFORE)), F.least("after", F.lit(LENGTH))
    both = F.array(
        of(REMOVED, place - before, place + after, before + after >= LENGTH),
        of(REPEATED, place - F.col("words_before"), place + F.col("words_after"), F.col("words_before") + F.col("words_after") > 0),
    )
    found = whole.select("doc_id", "text_hash", F.inline(F.array_compact(both)))
    edges = distinct.where("mixed").select("gram", "r.*")
    wide = materialize(edges.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most_contexts).select("gram"), "sd-wide")
    if wide.limit(1).count():
        found = found.unionByName(_counted_edges(_contexts(texts, edges.join(wide, "gram", "left_semi"))))
        edges = edges.join(wide, "gram", "left_anti")
    return texts, found.unionByName(_sorted_edges(_contexts(texts, edges)))


def stretches(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of a list of stretches."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def deduplicate(docs: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, the removed stretches of every document, and the bytes in repeated passages."""
    texts, found = covered(docs, most_contexts)
    lists = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "lo", "hi")).alias("found")).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["text_hash"] == lists["_hash"]), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo:long,hi:long>>, n_passage_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, f in zip(*[b.column(c) for c in ("doc_id", "text", "found")], strict=True):
                data, mine = (t.as_py() or "").encode("utf-8", "surrogatepass"), f.as_py() or ()
                runs, passages = (stretches([(x["lo"], x["hi"]) for x in mine if x["kind"] == kind]) for kind in (REMOVED, REPEATED))
                kept, at = hashlib.sha256(), 0
                for lo, hi in runs:
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                length = lambda x: sum(hi - lo for lo, hi in x)
                rows.append((i.as_py(), len(data), length(runs), len(runs), kept.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in runs], length(passages)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "n_passage_bytes"])

    return joined.select("doc_id", "text", "found").mapInArrow(run, schema)
