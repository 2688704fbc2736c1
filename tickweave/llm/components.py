"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: bigint); component is the smallest node reachable.

    Each round takes the smallest label beside a node and then that label's own label; rounds grow with the
    logarithm of the longest chain, and only (node, label) rows move. Nothing reaches the driver but a count of changes.
    """
    both = edges.select("a", "b").filter("a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        beside = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        near = labels.join(beside, "node").select("node", "component", F.least("component", "_near").alias("_label"))
        jump = labels.select(F.col("node").alias("_label"), F.col("component").alias("_far"))
        moved = cut(near.join(jump, "_label", "left").select("node", F.coalesce("_far", "_label").alias("component"), (F.coalesce("_far", "_label") != F.col("component")).alias("_changed")))
        labels = moved.drop("_changed")
        if moved.filter("_changed").isEmpty():
            return labels
