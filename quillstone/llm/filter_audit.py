"""Audit of how filters interact: what every filter removes in every order of application.

All orders of the filters form a trie.  Two prefixes with the same filters leave the same
rows, so the trie is walked depth first with one state for each set of filters: a state's
survivors are a persisted DataFrame, made from its parent's survivors by one more filter,
and a set that was met before is not walked again.  At each state one aggregation counts,
for every filter that is still open, the survivors that it removes: the actual removals on
every edge of the trie.  With n filters that is 2 ** n states and n * 2 ** (n - 1) edges
for n! orders.

1. Verdicts.  One pass over the texts evaluates each filter to a boolean column.  A
   filter that compares texts across the table (an earlier equal text) is a shuffle of
   digests.  Verdicts, part and labels are written once; a row has a few bytes.
2. The walk.  States on the path from the root to the current one are persisted (at most
   one for each filter), and unpersisted on the way back.  A lost executor's blocks are
   made again from the verdict table by at most n filters.  Counts go into a table, by part.
3. The report.  A fixed list of (order, step, state, filter) is attached to every part, and
   the counts of each edge are looked up.

Hot parts are aggregated before the shuffle.  Nothing but the filters' names is on the
driver; the number of parts is not bounded.

Defined results.  Null or empty text: no words, no characters.  Very long texts: as others.
Null part: the empty string.  Null doc_id: has no smaller doc_id and is none, no label fits it.
Repeated rows: each counts; equal texts under one doc_id are not copies of each other.
Several labels of a doc_id: it is good (toxic) if one of them says so.  Empty table: empty
result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import uuid
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import SPACE, let, materialize, shared_dir

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = r"[#$%&*|]"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: too few words, too few different ones, too many capitals, a symbol."""
    words = let(F.array_remove(F.split(text, SPACE), ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("n_distinct")))
    return {
        "A": words["n"] < LEAST_WORDS,
        "B": 100 * words["n_distinct"] < LEAST_DISTINCT_PERCENT * words["n"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS_PERCENT * F.length(text),
        "D": F.regexp_like(text, F.lit(SYMBOLS)),
    }


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, good, toxic and whether each filter of LETTERS fails a row."""
    text = F.coalesce("text", F.lit(""))
    told = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.md5(text).alias("digest"), *[c.alias(k) for k, c in text_filters(text).items()])
    told = materialize(told, "fa-told")
    first = told.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").select("digest", "first")
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    joined = told.join(first, "digest", "left").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    mark = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("boolean").alias(c)
    return joined.select("part", mark("good"), mark("toxic"), *LETTERS[:-1], copy.alias(LETTERS[-1]))


class Walk:
    """Depth-first walk over the sets of filters; counts every edge of every set once."""

    def __init__(self, rows: DataFrame, filters: str = LETTERS) -> None:
        self.filters, self.done, self.tables = filters, set(), []
        self.spark = rows.sparkSession
        self.folder = f"{shared_dir(self.spark)}/fa-states-{uuid.uuid4().hex}"
        self._visit(frozenset(), rows)

    def _count(self, state: frozenset[str], survivors: DataFrame) -> None:
        """Writes the state's rows (part, alive, filter, removed, good, toxic), one for each filter that is open."""
        edge = lambda f: F.struct(
            F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic")
        )
        edges = F.array(*[edge(f) for f in self.filters if f not in state])
        path = f"{self.folder}/{'-'.join(['state', *sorted(state)])}"
        named = F.lit("".join(sorted(state))).alias("state")
        survivors.groupBy("part").agg(F.count("*").alias("alive"), edges.alias("edges")).select("part", named, "alive", F.inline("edges")).write.parquet(path)
        self.tables.append(path)

    def _visit(self, state: frozenset[str], survivors: DataFrame) -> None:
        self.done.add(state)
        if len(state) == len(self.filters):
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        self._count(state, survivors)
        for f in self.filters:
            after = state | {f}
            if f not in state and after not in self.done:
                self._visit(after, survivors.where(~F.col(f)))
        survivors.unpersist()

    def edges(self) -> DataFrame:
        """Every edge: part, state (its filters, sorted), filter, alive before it, removed by it, and good and toxic rows among these."""
        return self.spark.read.parquet(*self.tables)


def orders(filters: str = LETTERS) -> list[dict]:
    """Every step of every order: its filter, and those before it, sorted."""
    every = itertools.permutations(filters)
    return [{"filter_order": "".join(p), "step": k + 1, "state": "".join(sorted(p[:k])), "filter": f} for p in every for k, f in enumerate(p)]


def report(rows: DataFrame, filters: str = LETTERS) -> DataFrame:
    """One row for each part, order and step, from the verdicts of verdicts()."""
    edges, n = Walk(rows, filters).edges(), len(filters)
    size, removed = F.length("state"), F.col("removed")
    # in so many orders the filter comes right after just the filters of the state
    times = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)])[size]
    overall = edges.groupBy("part", "filter").agg(
        F.sum(F.when(size == 0, removed)).alias("failing"), F.sum(F.when(size == n - 1, removed)).alias("unique"), F.sum(removed * times).alias("shapley")
    )
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order:string,step:int,state:string,filter:string>>")
    parts = rows.select("part").distinct().select("part", F.inline(steps))
    joined = parts.join(edges, ["part", "state", "filter"], "left").join(overall, ["part", "filter"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        "part", "filter_order", "step", count(F.col("alive") - removed).alias("kept"), count(removed).alias("removed"),
        (count(F.col("failing")) - count(removed)).alias("redundant"), count(F.col("unique")).alias("unique_fails"),
        count(F.col("good")).alias("good_lost"), count(F.col("toxic")).alias("toxic_lost"), count(F.col("shapley")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return report(materialize(verdicts(docs, labels, part), "fa-verdicts"))
