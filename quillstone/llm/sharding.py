"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 places.  Every shard owns `virtual_nodes` points on it; a key
belongs to the arc of the next point clockwise.  A shard takes no more rows than
its quota; rows that find it full continue clockwise to the next point whose
shard has room.  The quotas differ by at most one row, so the law is `rows`.

How it runs.  Only the row counts of the arcs (at most shards * virtual_nodes
numbers, a bound set by parameters) reach the driver, where the overflow of each
arc is walked round the ring.  The walk yields segments "the rows ranked lo to hi
of arc a go to shard s, from slot b", at most one for each arc and one more for
each time a shard fills up.  Rows are ranked inside their arc and meet their
segment in a broadcast join of that bounded table.  Texts are never shuffled.

Hot arcs.  Ranks inside an arc are counted in blocks: an arc's rows are spread
over `blocks` by a second hash, ranked inside (arc, block), and shifted by the
counts of the blocks before.  Rows without a doc_id take their place by the text's
hash, so they cannot fill one arc.  Equal rows (or rows without an id and equal text)
are one group with a count before they are ranked; a group of more than CHUNK rows is
dealt out in chunks of ranks before it becomes rows again.

Defined results.  Null text: 16 bytes, no crc32 input but the empty text's.  Null
doc_id: placed by its text.  Equal rows: both are placed, in either order.  Empty
table: empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, small_table

RING = 1 << 16
#: Bytes that a row needs besides its text.
ROW_BYTES = 16
#: Equal rows that one task turns into rows at once.
CHUNK = 10_000


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order."""
    place = lambda s, v: int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:4], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def arcs(points: list[tuple[int, int]]) -> list[dict]:
    """The ranges of places that belong to each point: those after the point before it, up to its own."""
    out, after = [], 0
    for k, (place, _) in enumerate(points):
        if place >= after:
            out.append({"lo": after, "hi": place, "arc": k})
            after = place + 1
    if after < RING:
        out.append({"lo": after, "hi": RING - 1, "arc": 0})
    return out


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(demand: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[dict]:
    """Send each arc's rows to its shard, and what finds it full clockwise to the next shard with room.

    room: rows that each shard may still take; its sum must cover the demand.  In
    each round every piece tries one point, in ring order of the points.
    """
    left, used, out = list(room), [0] * len(room), []
    waiting = deque((a, a, 0, n) for a, n in sorted(demand.items()) if n)
    while waiting:
        again: list[tuple[int, int, int, int]] = []
        while waiting:
            arc, at, lo, hi = waiting.popleft()
            shard = points[at][1]
            take = min(left[shard], hi - lo)
            if take:
                out.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": shard, "base": used[shard]})
                left[shard] -= take
                used[shard] += take
            if lo + take < hi:
                again.append((arc, (at + 1) % len(points), lo + take, hi))
        waiting = deque(sorted(again, key=lambda x: (x[1], x[0])))
    return out


def ring_place(key: Column) -> Column:
    """A key's place: the first four hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int")


def assign(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64, blocks: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    points = ring_points(shards, virtual_nodes)
    place_arc = small_table(spark, arcs(points), "lo int, hi int, arc int").select("arc", F.explode(F.sequence("lo", "hi")).alias("place"))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        ring_place(key).alias("place"), F.pmod(F.xxhash64(key, F.crc32(text)), F.lit(blocks)).cast("int").alias("block"),
    )
    # RING rows of two ints: the broadcast is bounded by a constant
    slim = materialize(slim.join(F.broadcast(place_arc), "place").drop("place"), "shard-keys")
    counts = slim.groupBy("arc", "block").count()
    # at most shards * virtual_nodes numbers, whatever the input's size
    demand = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    segments = walk(demand, points, quotas(sum(demand.values()), shards))
    # at most shards * virtual_nodes * blocks rows
    before = F.sum("count").over(Window.partitionBy("arc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    where = counts.select("arc", "block", F.coalesce(before, F.lit(0)).alias("before"))
    pieces = small_table(spark, segments, "arc int, lo long, hi long, shard int, base long")
    groups = slim.groupBy("arc", "block", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("arc", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    groups = materialize(groups.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "shard-groups")
    rows = lambda g: g.withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    chunks = groups.where(F.col("n") > CHUNK).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))))
    chunks = chunks.select("arc", "block", "doc_id", "text_crc32", "size", F.least(F.lit(CHUNK), F.col("n") - F.col("offset")).alias("n"), (F.col("first") + F.col("offset")).alias("first"))
    ranked = rows(groups.where(F.col("n") <= CHUNK)).unionByName(rows(chunks.repartition("arc", "block", "doc_id", "text_crc32", "size", "first")))
    ranked = ranked.join(F.broadcast(where), ["arc", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    found_in = (ranked["arc"] == pieces["arc"]) & (ranked["rank"] >= pieces["lo"]) & (ranked["rank"] < pieces["hi"])
    placed = ranked.join(F.broadcast(pieces), found_in)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard"), (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
