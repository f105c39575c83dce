"""Near-duplicates by MinHash bands with sequential Bayesian verification.

1. Each text's set of word shingles is hashed (one Arrow map over the texts); kept
   are its size, a 128-bit hash of the whole set and a hash of each MinHash band.
2. Texts with equal sets form a class, by that hash.  From here on one row stands
   for a class, so exact copies cost nothing.
3. Classes that share a band meet in a bucket.  Each class is tied to the most
   central class of each of its buckets (never to all members), and the ties' components
   are the clusters: classes that share a band lie in one cluster.
4. A cluster of bounded size is settled in one task.  One member after the other, the
   most central first, is compared with all others by sequential Bayesian
   verification: signatures are read in batches, and a pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold is
   below `miss`; the survivors' full sets are compared exactly.  Members that are
   connected already need no comparison, so near copies cost about one pass.
5. A larger cluster is settled by distributed rounds: each bucket compares its members
   with a few pivots in the same way.  A pivot that has met every member of another
   component leaves the bucket, and a bucket whose members lie in one component is
   done.  The rounds end when no bucket is left; nothing is capped.
6. Confirmed links make components; the smallest doc_id of a component is kept.

A pair at the threshold of 0.8 shares none of the 24 bands of 4 with probability
3e-6, at 0.9 with 1e-11.

Defined results.  Null text, empty text or no word: empty set, linked with nothing, own
component.  Fewer words than a shingle has: the whole sequence is one shingle.
Repeated rows (equal ids): equal results.  Null doc_id: null component unless linked.
Empty table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, materialize_counted, text_or_empty
from quillstone.llm.components import components
from quillstone.llm.decontaminate import without

BANDS, ROWS, BATCH = 24, 4, 24
HASHES = BANDS * ROWS
PERCENT, MISS = 80, 1e-7
#: Pivots of a bucket in each round; the last number holds from there on.
PIVOTS = (1, 8, 64, 256)
#: Classes and shingles of a cluster that one task settles (some 200 MB at work).
MOST_CLASSES, MOST_SHINGLES = 30_000, 4_000_000

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    letters = data[~space]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    powers = _POWERS if sizes.max() <= len(_POWERS) else _powers(int(sizes.max()))
    return _mixed(np.add.reduceat(_BYTE[letters] * powers[place], first) + sizes.astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    total = np.full(n, min(size, len(w)), dtype=np.uint64)
    for k in range(min(size, len(w))):
        total = _mixed(total * _STEP + w[k : k + n])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    h = (found >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 19) // HASHES)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(h), step):
        np.minimum(out, (_MULTIPLY * h[k : k + step] + _ADD).min(axis=1), out=out)
    return out


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(signature values read, matches needed to go on) for each batch.

    Posterior of the similarity s after m matches of k, uniform prior: Beta(m + 1, k - m + 1);
    P(s >= t) is a binomial sum.
    """
    t = percent / 100
    upper = lambda m, k: sum(math.comb(k + 1, i) * t**i * (1 - t) ** (k + 1 - i) for i in range(m + 1))
    return [(k, next(m for m in range(k + 1) if upper(m, k) >= miss)) for k in range(BATCH, HASHES + 1, BATCH)]


def sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (hash of the set, null if empty) and bands (a hash of each)."""
    schema = "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>"
    number = np.arange(BANDS, dtype=np.uint64)

    def banded(sig: np.ndarray) -> np.ndarray:
        h = number + np.uint64(1)
        for column in sig.reshape(BANDS, ROWS).astype(np.uint64).T:
            h = _mixed(h * _STEP + column)
        return h.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, bands = [], [], []
            for t in b.column("text"):
                found = shingles(t.as_py(), size)
                n.append(len(found))
                key.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(banded(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text").mapInArrow(run, schema)


def settled(sets_of: list[np.ndarray]) -> np.ndarray:
    """The component (its first member's number) of each of a cluster's sets.  The list is emptied on the way."""
    n = len(sets_of)
    size = np.array([len(x) for x in sets_of])
    ends = np.cumsum(size)
    sig = np.array([signature(x) for x in sets_of])
    # numbers of four bytes for the shingles, set by set, so that no second array of the whole cluster is needed beside them
    known, code = np.unique(np.concatenate(sets_of)), np.empty(int(ends[-1]), dtype=np.uint32)
    for k in range(n):
        code[ends[k] - size[k] : ends[k]] = np.searchsorted(known, sets_of[k])
        sets_of[k] = None
    n_known = len(known)
    del known
    central = np.zeros(n, dtype=np.int64)
    for k in range(BANDS):
        _, same, count = np.unique(np.ascontiguousarray(sig[:, ROWS * k : ROWS * (k + 1)]).view(f"V{4 * ROWS}").ravel(), return_inverse=True, return_counts=True)
        central += count[same]
    order = np.argsort(-central, kind="stable")
    needed = least_matches()
    label, open_ones, mark = np.arange(n), np.ones(n, dtype=bool), np.zeros(n_known, dtype=bool)
    while True:
        left = order[open_ones[order]]
        labels, count = np.unique(label[left], return_counts=True)
        if len(labels) < 2:
            return label
        x = int(left[np.argmax(label[left] != labels[count.argmax()])] if count.max() > 1 else left[0])
        open_ones[x] = False
        alive = np.flatnonzero(open_ones & (label != label[x]))
        alive = alive[PERCENT * np.maximum(size[alive], size[x]) <= 100 * np.minimum(size[alive], size[x])]
        matches, at = np.zeros(n, dtype=np.int64), 0
        for read, least in needed:
            matches[alive] += (sig[alive, at:read] == sig[x, at:read]).sum(axis=1)
            alive, at = alive[matches[alive] >= least], read
        if not len(alive):
            continue
        mark[code[ends[x] - size[x] : ends[x]]] = True
        both = np.array([np.count_nonzero(mark[code[ends[i] - size[i] : ends[i]]]) for i in alive])
        mark[code[ends[x] - size[x] : ends[x]]] = False
        linked = alive[100 * both >= PERCENT * (size[alive] + size[x] - both)]
        if len(linked):
            joined = np.unique(np.append(label[linked], label[x]))
            label[np.isin(label, joined)] = joined[0]


def _settled_clusters(rows: DataFrame, size: int) -> DataFrame:
    """node and component of the members (cluster, key, text) of clusters of bounded size, one cluster after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a cluster only the sets are held, never its texts
        now, held, out = None, {}, ([], [])

        def flush() -> None:
            if len(held) > 1:
                names, sets_of = list(held), list(held.values())
                held.clear()
                label = settled(sets_of)
                out[0].extend(names)
                out[1].extend(names[k] for k in label)
            held.clear()

        for b in batches:
            for c, k, t in zip(b.column("cluster").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                if c != now:
                    flush()
                    now = c
                if k not in held:  # repeated rows give a class's text twice
                    held[k] = shingles(t.as_py(), size)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["node", "component"])
                out = ([], [])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["node", "component"])

    return rows.select("cluster", "key", "text").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "node binary, component binary")


def _signed(store: DataFrame, size: int) -> DataFrame:
    """key, n_shingles and signature of the classes of `store`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(x) for x in found], pa.int64()), pa.array([signature(x).tobytes() for x in found], pa.binary())], names=["key", "n_shingles", "signature"])

    return store.select("key", "text").mapInArrow(run, "key binary, n_shingles long, signature binary").dropDuplicates(["key"])


def _pruned(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b with signatures) whose posterior stays above the miss probability in every batch."""
    needed = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
            alive, matches, at = np.arange(len(x)), np.zeros(len(x), dtype=int), 0
            for read, least in needed:
                matches[alive] += (x[alive, at:read] == y[alive, at:read]).sum(axis=1)
                alive, at = alive[matches[alive] >= least], read
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(alive)), b.column("b").take(pa.array(alive))], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b with texts) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            for k, (b, ta, tb) in enumerate(zip(batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True)):
                if last[0] != b:  # pairs come sorted by their pivot
                    last = (b, shingles(tb.as_py(), size))
                x, y = shingles(ta.as_py(), size), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").sortWithinPartitions("b").mapInArrow(run, "a binary, b binary")


def _as(df: DataFrame, side: str, **columns: str) -> DataFrame:
    return df.select(F.col("key").alias(side), *[F.col(v).alias(k) for k, v in columns.items()])


def _settled_by_rounds(members: DataFrame, store: DataFrame, size: int) -> DataFrame:
    """node and component of the members (band, key) of clusters of any size."""
    classes = materialize(_signed(store, size), "nd-signed")
    counts = members.groupBy("band").agg(F.count("*").alias("n"))
    central = materialize(members.join(counts, "band").groupBy("key").agg(F.sum("n").alias("central")), "nd-central")
    links, tested, labels, step = None, None, None, 0
    while True:
        label = F.col("key") if labels is None else F.coalesce("component", F.col("key"))
        now = (members if labels is None else members.join(labels.withColumnRenamed("node", "key"), "key", "left")).select("band", "key", label.alias("component"))
        open_bands = now.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
        members, rows = materialize_counted(now.join(open_bands, "band"), "nd-members", F.lit(True))
        if not rows:
            return labels
        n = PIVOTS[min(step, len(PIVOTS) - 1)]
        ranked = members.join(central, "key").withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("central"), "key")))
        pivots = ranked.where(F.col("rank") <= n).select("band", F.col("key").alias("b"), F.col("component").alias("of"))
        pairs = members.join(pivots, "band").where("key <> b and component <> of").select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, new = materialize_counted(pairs, "nd-pairs", F.lit(True))
        members = members.join(pivots.select("band", F.col("b").alias("key")), ["band", "key"], "left_anti").select("band", "key")
        step += 1
        if not new:  # all of them have met before
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        joined = pairs.join(_as(classes, "a", na="n_shingles", sa="signature"), "a").join(_as(classes, "b", nb="n_shingles", sb="signature"), "b")
        alive = _pruned(joined.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))
        full = alive.join(_as(store, "a", ta="text"), "a").join(_as(store, "b", tb="text"), "b")
        found, new = materialize_counted(_confirmed(full, size).distinct(), "nd-links", F.lit(True))
        if links is not None and not new:
            continue
        links = found if links is None else links.unionByName(found)
        labels = components(links)


def linked_classes(docs: DataFrame, classes: DataFrame, size: int, most_classes: int = MOST_CLASSES, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """node and component of the classes that share a band with another one."""
    bands = classes.select("key", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(bands.join(shared, "band"), "nd-members")
    # the member with the most companions is in nearly every bucket of its group, so one hub stands for most of them
    ranked = members.join(members.groupBy("key").agg(F.sum("n").alias("central")), "key").select("band", "key", "central")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("central", "key")).alias("hub"))
    # a class has at most BANDS hubs; its most central one is its home, and only homes are tied to the others
    homes = materialize(members.join(hubs, "band").groupBy("key").agg(F.max("hub").alias("home"), F.collect_set("hub.key").alias("hubs")).select("key", F.col("home.key").alias("home"), "hubs"), "nd-homes")
    ties = homes.select(F.col("home").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct()
    tied = components(ties).select(F.col("node").alias("home"), "component")
    clusters = homes.join(tied, "home", "left").select("key", F.coalesce("component", "home").alias("cluster"))
    wanted = classes.select("key", "doc_id", "text_hash", "n_shingles").join(clusters, "key")
    large = materialize(wanted.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("t")).where((F.col("n") > most_classes) | (F.col("t") > most_shingles)).select("cluster"), "nd-large")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])
    rows = texts.join(wanted, same).select("cluster", "key", "text")
    if not large.limit(1).count():
        return _settled_clusters(rows, size)
    store = materialize(rows, "nd-texts")
    apart = store.join(large, "cluster", "left_semi").select("key", "text").dropDuplicates(["key"])
    open_ones = members.join(apart.select("key"), "key", "left_semi").select("band", "key")
    return _settled_clusters(store.join(large, "cluster", "left_anti"), size).unionByName(_settled_by_rounds(open_ones, apart, size))


def groups(docs: DataFrame, size: int = 4, most_classes: int = MOST_CLASSES, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept and stays (of a component's rows with the smallest id only the first) of every document."""
    held = materialize(sets(docs, size), "nd-sets")
    per_class = held.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = materialize(per_class.select("key", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"), "n_shingles", "bands"), "nd-classes")
    labels = materialize(linked_classes(docs, classes, size, most_classes, most_shingles), "nd-labels")
    home = classes.select("key", F.struct("doc_id", "text_hash").alias("first"))
    named = labels.withColumnRenamed("node", "key").join(home, "key")
    least = named.groupBy("component").agg(F.min("first").alias("smallest"))
    home = home.join(named.drop("first").join(least, "component").select("key", "smallest"), "key", "left").select("key", F.coalesce("smallest", "first").alias("first"))
    out = held.select("doc_id", "text_hash", "n_shingles", "key").join(home, "key", "left")
    own = F.struct("doc_id", "text_hash")
    out = out.withColumn("first", F.coalesce("first", own)).withColumn("component_id", F.col("first.doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), own.eqNullSafe(F.col("first")).alias("stays"))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each component, columns as they are; of equal rows one.

    The rest is told to the rows by (doc_id, text hash): in a broadcast if few, by shuffles beyond.
    """
    found = materialize(groups(docs, size), "nd-groups")
    left = without(docs, found.where("not stays"))
    twice = found.where("stays and n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not twice.limit(1).count():
        return left
    # the row travels as one struct, so that no name of its own can clash
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"))
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), key.alias("row_key"))
    again, same = twice.select(F.struct("doc_id", "text_hash").alias("again_key")), F.col("row_key").eqNullSafe(F.col("again_key"))
    once = rows.join(again, same, "left_semi").dropDuplicates(["row_key"])
    return rows.join(again, same, "left_anti").unionByName(once).select("row.*")
