"""Connected components by smallest labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` for ``nodes(node)`` and undirected ``edges(a, b)``.

    Every round a node takes the smallest label around it and then that label's
    own label, so long chains close quickly.  Every round is
    written and read back; only the number of changed labels comes back to the driver.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = held = stored(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(
            F.min("component").alias("near"))
        lowered = labels.join(around, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = lowered.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = stored(lowered.join(jump, "component", "left").select(
            "node", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = jumped.where(F.col("old") != F.col("component")).count()
        discard(held)
        labels, held = jumped.select("node", "component"), jumped
        if not changed:
            discard(both)
            return labels
