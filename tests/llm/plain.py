"""Plain versions of the pipeline's stages, one row after the other."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from quillstone.llm import mixing, near_dup, sharding


def nearest_ids(docs, size):
    """Of each component of (id, text) pairs linked at 80 percent of their shingles the smallest id; all pairs are compared."""
    sets_of = {i: frozenset(near_dup.shingles(t, size).tolist()) for i, t in docs}
    up = {i: i for i in sets_of}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets_of)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets_of[a], sets_of[b]
            if x and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {top(i) for i in ids}


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def contaminated(docs, items):
    """Ids of the documents in which some stretch of an item agrees in 80 percent on some diagonal; items laid at every place."""
    out = set()
    for d, t in docs:
        w = np.array([hash(x) for x in words(t)], dtype=np.int64)
        for x in items:
            item = np.array([hash(y) for y in words(x)], dtype=np.int64)
            n, size = len(item), min(20, len(item))
            if not n:
                continue
            padded = np.concatenate((np.full(n - 1, -1, dtype=np.int64), w, np.full(n - 1, -1, dtype=np.int64)))
            hits = np.lib.stride_tricks.sliding_window_view(padded, n) == item
            sums = np.cumsum(np.concatenate((np.zeros((len(hits), 1), dtype=int), hits), axis=1), axis=1)
            if (100 * (sums[:, size:] - sums[:, :-size]) >= 80 * size).any():
                out.add(d)
                break
    return out


def raked(cells, budget, temperature=mixing.SOURCE_TEMPERATURE):
    """Probabilities of the cells {(source, lang, topic): tokens} that draw `budget` of all tokens at the target shares.

    Coordinate after coordinate, each category's factor is found by bisection.
    """
    keys = [k for k, n in cells.items() if n > 0]
    n = np.array([cells[k] for k in keys], dtype=float)
    total, wanted, of = n.sum(), [], []
    for axis, targets in enumerate((None, mixing.LANG_TARGETS, mixing.TOPIC_TARGETS)):
        names = sorted({k[axis] for k in keys})
        have = {a: sum(cells[k] for k in keys if k[axis] == a) for a in names}
        raw = {a: have[a] ** temperature if targets is None else targets.get(a, have[a] / total) for a in names}
        wanted.append(np.array([raw[a] / sum(raw.values()) * budget * total for a in names]))
        of.append(np.array([names.index(k[axis]) for k in keys]))
    factors = [np.full(len(w), 0.5) for w in wanted]
    for _ in range(400):
        for axis in range(3):
            rest = np.prod([factors[a][of[a]] for a in range(3) if a != axis], axis=0)
            for c, want in enumerate(wanted[axis]):
                mine = of[axis] == c
                lo, hi = 0.0, 1e9
                for _ in range(100):
                    mid = np.sqrt(lo * hi) if lo > 1e-9 else max(hi / 1e3, 1e-9)
                    lo, hi = (mid, hi) if (n[mine] * np.minimum(1, mid * rest[mine])).sum() < want else (lo, mid)
                factors[axis][c] = hi
    p = np.minimum(1, np.prod([factors[a][of[a]] for a in range(3)], axis=0))
    return dict(zip(keys, p, strict=True))


def ring_keys(df, blocks):
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    return df.select("doc_id", key.alias("key"), F.pmod(F.xxhash64(key, F.crc32(text)), F.lit(blocks)).alias("block"), F.crc32(text).alias("crc"), F.octet_length(text).alias("n")).collect()


def walked(rows, shards, nodes):
    """(doc_id, size, crc32, shard, slot): every row walks clockwise by itself, round by round, to the first shard with room."""
    points = sharding.ring_points(shards, nodes)
    place = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:4], 16)
    arc = lambda k: next((i for i, (p, _) in enumerate(points) if p >= place(k)), 0)
    least = lambda r: (r.block, r.doc_id is not None, r.doc_id or 0, r.crc, r.n)
    waiting = sorted(((a := arc(r.key), a, least(r), r) for r in rows), key=lambda x: x[:3])
    room, slots, out = sharding.quotas(len(rows), shards), Counter(), []
    while waiting:
        again = []
        for a, at, rank, r in waiting:
            s = points[at][1]
            if slots[s] < room[s]:
                out.append((r.doc_id, r.n + sharding.ROW_BYTES, r.crc, s, slots[s]))
                slots[s] += 1
            else:
                again.append((a, (at + 1) % len(points), rank, r))
        waiting = sorted(again, key=lambda x: (x[1], x[0], x[2]))
    return out
