"""Merkle manifest of a table: a tree of hashes for each group, one over the groups, and a proof for every row.

A row's leaf is the sha-256 of its columns.  In each group the leaves stand in order, and
every 8 consecutive nodes (the last run: fewer, even one) become the hash of their digests,
until one is left, the group's subroot.  The subroots, in order of the group, make the root
by the same rule.

1. Leaves are range-partitioned and sorted by (group, order).  The rows that each
   partition has of each group are counted; their running sums over the partitions are the
   offsets that say at which place of its group a partition begins.
2. Each partition builds, of every group it holds a part of, all subtrees that lie in it
   whole (aligned runs of 8, and the group's last run).  Nodes whose run reaches into
   another partition are its ragged edge: at most 14 for each level of a group that goes on
   elsewhere, and one for a group that does not.
3. Ragged nodes are shuffled by their coordinate (group, level, run), level by level, which
   makes the upper part of each tree.  Subroots go through the same three steps.
4. From the top down, each ragged node gets its proof; the partitions build their subtrees
   again and hand the proofs on to the rows.

Rows are held by one task at a time only as far as a range partition goes (PARTITION rows,
about 100 bytes each).  A hot group is cut by the ranges like any other; of rows that are
equal in the order, their leaves and then their places in the scan decide, so they are cut
too.  What goes from level to level grows with the number of partitions and groups.

Defined results.  Null columns: the leaf says so.  Null group: the first group.  Null order:
the first rows.  Equal order: by leaf; equal rows have equal leaves, so it does not matter
which of them comes first.  Null or empty text, very long text: hashed whole by Spark.
Empty table: empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, materialize_counted

#: Nodes of a run.
FAN = 8
#: Rows of a range partition, about.
PARTITION = 250_000
#: Bits of a row's number that monotonically_increasing_id() gives to its place in the partition.
PLACES = 33

PROOF = "array<struct<left:string,right:string>>"


def digest_of(columns: Sequence[Column]) -> Column:
    """The leaf of a row: each column as its byte count, a colon and the value; a hyphen where it is null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def _joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def local_levels(digests: list[str], start: int, total: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """The subtrees that consecutive leaves, from place `start` of a group of `total`, hold whole.

    Gives (first place, digests) of each level, and the ragged edge: (level, place, digest)
    of the nodes without a parent here, the group's top among them.
    """
    levels, ragged, level = [(start, digests)], [], 0
    while True:
        end = start + len(digests)
        low, high = -(-start // FAN), -(-total // FAN) if end == total else end // FAN
        if total == 1 or low >= high:
            ragged += [(level, start + k, d) for k, d in enumerate(digests)]
            return levels, ragged
        inside = range(FAN * low - start, min(FAN * high, end) - start)
        ragged += [(level, start + k, d) for k, d in enumerate(digests) if k not in inside]
        digests = [_joined(digests[k : k + FAN]) for k in inside[::FAN]]
        start, total, level = low, -(-total // FAN), level + 1
        levels.append((start, digests))


def local_proofs(levels: list[tuple[int, list[str]]], above: dict[tuple[int, int], list[dict]]) -> list[list[dict]]:
    """The proof of each leaf of local_levels, given those of the ragged edge."""
    known: list[list[dict]] = []
    for level in range(len(levels) - 1, -1, -1):
        start, digests = levels[level]
        first = levels[level + 1][0] if level + 1 < len(levels) else 0
        mine = []
        for k in range(len(digests)):
            place = start + k
            proof = above.get((level, place))
            if proof is None:
                run = place - place % FAN - start
                step = {"left": "".join(digests[run:k]), "right": "".join(digests[k + 1 : run + FAN])}
                proof = [step, *known[place // FAN - first]]
            mine.append(proof)
        known = mine
    return known


def _parts(leaves: pa.Table) -> list[tuple[str, int, int]]:
    """(group, first row, row after the last) of sorted leaves."""
    groups = leaves.column("tree").to_pylist()
    cuts = [k for k in range(len(groups)) if not k or groups[k] != groups[k - 1]]
    return [(groups[a], a, b) for a, b in zip(cuts, [*cuts[1:], len(groups)], strict=True)]


RAGGED = "part long, tree string, level int, place long, digest string, start long, total long"


def _ragged(leaves: pa.Table, spans: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("at")
    part, digests = leaves.column("part")[0].as_py(), leaves.column("leaf").to_pylist()
    known = {s["tree"]: (s["start"], s["total"]) for s in spans.to_pylist()}
    rows = []
    for tree, a, b in _parts(leaves):
        start, total = known[tree]
        rows += [{"part": part, "tree": tree, "level": level, "place": place, "digest": d, "start": start, "total": total} for level, place, d in local_levels(digests[a:b], start, total)[1]]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.Table.from_pylist(rows, schema=pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RAGGED.split(", "))]))


def _proved(leaves: pa.Table, frontier: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("at")
    digests, known = leaves.column("leaf").to_pylist(), {}
    for f in frontier.to_pylist():
        start, total, above, top = known.setdefault(f["tree"], (f["start"], f["total"], {}, f["top"]))
        above[f["level"], f["place"]] = f["proof"]
    proofs, tops = [], []
    for tree, a, b in _parts(leaves):
        start, total, above, top = known[tree]
        proofs += local_proofs(local_levels(digests[a:b], start, total)[0], above)
        tops += [top] * (b - a)
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    return leaves.drop_columns(["part", "at", "tree"]).append_column("proof", pa.array(proofs, pa.list_(step))).append_column("top", pa.array(tops, pa.list_(pa.string())))


class Forest:
    """The trees of (tree, order columns, leaf) rows; further columns travel with them."""

    def __init__(self, rows: DataFrame, order: Sequence[str], partition: int = PARTITION) -> None:
        spark = rows.sparkSession
        rows, n = materialize_counted(rows.withColumn("at", F.monotonically_increasing_id()), "mk-leaves", F.lit(True))
        keys = ["tree", *order, "leaf", "at"]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // partition))
        ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        numbered = ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", PLACES))
        self.leaves = materialize(numbered, "mk-sorted")
        before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        spans = self.leaves.groupBy("tree", "part").agg(F.count("*").alias("n"))
        self.spans = materialize(spans.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("total")), "mk-spans")
        self.ragged = materialize(self.leaves.groupBy("part").cogroup(self.spans.groupBy("part")).applyInArrow(_ragged, RAGGED), "mk-ragged")
        self._finish_levels()

    def _finish_levels(self) -> None:
        """Joins ragged nodes into runs, level by level, up to the tops."""
        largest = self.spans.agg(F.max("total")).first()[0] or 0
        self.runs: list[DataFrame] = []
        made, width = None, 1
        nodes = self.ragged.select("tree", "level", "place", "digest", "total")
        tops = nodes.where(F.col("total") <= 1)
        while width < largest:
            level = len(self.runs)
            here = nodes.where((F.col("level") == level) & (F.col("total") > width))
            if made is not None:
                here = here.unionByName(made.where(F.col("total") > width))
            kids = F.array_sort(F.collect_list(F.struct("place", "digest")))
            runs = materialize(here.groupBy("tree", "total", F.expr(f"place div {FAN}").alias("run")).agg(kids.alias("kids")), "mk-runs")
            self.runs.append(runs)
            width *= FAN
            made = runs.select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("place"), F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"), "total")
            ended = (F.col("total") <= width) & (F.col("total") > width // FAN)
            tops = tops.unionByName(made.where(ended)).unionByName(nodes.where((F.col("level") == level + 1) & ended))
        self.tops = materialize(tops.select("tree", "digest"), "mk-tops")

    def proved(self, beyond: DataFrame) -> DataFrame:
        """All rows with `proof`, their siblings up to the very top, and `top`, the digests on the way (subroot, then root).

        beyond: (tree, proof, top) of every tree's own top.
        """
        # the top of a tree of `total` leaves stands at the first level that has room for all of them
        heights = sum((F.when(F.col("total") > F.lit(FAN**k), 1).otherwise(0) for k in range(len(self.runs))), F.lit(0))
        totals = self.spans.select("tree", "total").distinct()
        tops = materialize(beyond.join(totals, "tree").select("tree", heights.cast("int").alias("level"), F.lit(0).cast("long").alias("place"), "proof", "top"), "mk-known")
        every, upper = tops, tops.where("false")
        for level in range(len(self.runs) - 1, -1, -1):
            kids = self.runs[level].select("tree", F.col("run").alias("up"), "kids").select("tree", "up", "kids", F.explode("kids").alias("kid"))
            side = lambda keep: F.array_join(F.transform(F.filter("kids", lambda x: keep(x["place"], F.col("kid.place"))), lambda x: x["digest"]), "")
            step = F.struct(side(lambda a, b: a < b).alias("left"), side(lambda a, b: a > b).alias("right"))
            above = tops.where(F.col("level") == level + 1).unionByName(upper).select("tree", F.col("place").alias("up"), "proof", "top")
            mine = kids.join(above, ["tree", "up"]).select("tree", F.lit(level).alias("level"), F.col("kid.place").alias("place"), F.concat(F.array(step), "proof").alias("proof"), "top")
            upper = materialize(mine, "mk-known")
            every = every.unionByName(upper)
        frontier = self.ragged.join(every, ["tree", "level", "place"]).select("part", "tree", "level", "place", "start", "total", "proof", "top")
        kept = [f for f in self.leaves.schema.fields if f.name not in ("part", "at", "tree")]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"proof {PROOF}", "top array<string>"])
        return self.leaves.groupBy("part").cogroup(frontier.groupBy("part")).applyInArrow(_proved, schema)


def manifest(rows: DataFrame, columns: Sequence[str], group: str, order: str, altered: Column | None = None, partition: int = PARTITION) -> DataFrame:
    """`order` column, leaf, `altered` (null where the column given is), proof, subroot and root of every row.

    altered: the leaf that a row is to be checked with instead of its own.
    """
    # a mark before the value keeps a null group apart from an empty one, and first
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    altered = F.lit(None).cast("string") if altered is None else altered
    leaves = rows.select(tree.alias("tree"), F.col(order).alias("id"), digest_of([F.col(c) for c in columns]).alias("leaf"), altered.alias("altered"))
    trees = Forest(leaves, ["id"], partition)
    top = Forest(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf")), ["name"], partition)
    root = top.tops.select("tree", F.array().cast(PROOF).alias("proof"), F.array("digest").alias("top"))
    beyond = top.proved(root).select(F.col("name").alias("tree"), "proof", F.concat(F.array("leaf"), "top").alias("top"))
    out = trees.proved(materialize(beyond, "mk-beyond"))
    return out.select(F.col("id").alias(order), "leaf", "altered", "proof", F.col("top")[0].alias("subroot"), F.col("top")[1].alias("root"))


def folded(leaf: Column, proof: str = "proof") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings_digest(proof: str = "proof") -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)
