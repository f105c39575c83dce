"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, materialize_counted


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) of every node in links.

    Each round every node takes the smallest label among its own and its
    neighbours', then the label of that label.  Labels are written to the shared
    folder after each round, so the plan does not grow and lost executors cost one
    round.  Label sums are pre-aggregated; a node with very many neighbours is a
    hot key of a join that Spark may split.
    """
    both = materialize(links.select(F.col(a).alias("node"), F.col(b).alias("near")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("near"))).distinct(), "cc-links")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("component")), "cc-labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("heard")), "near").groupBy("node").agg(F.min("heard").alias("heard"))
        new = labels.join(told, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("beyond"))
        new = new.join(jump, "label").select("node", "before", F.least("label", "beyond").alias("component"))
        new, changed = materialize_counted(new, "cc-labels", F.col("before") != F.col("component"))
        labels = new.select("node", "component")
        if not changed:
            return labels
