"""Connected components of an edge table, by joins and aggregates with the labels kept in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b long); label is the smallest node of its component.

    Each round every node takes the smallest label among its own and its neighbours', then the label of its label,
    so that long chains halve. It ends when no label changes. Minima are combined before the shuffle, so a node may
    have any number of edges. No edges give an empty table.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels.node == seen.a, "left").select("node", "label", F.least("label", "near").alias("near"))
        over = labels.select(F.col("node").alias("hop"), F.col("label").alias("hop_label"))
        stepped = materialise(
            near.join(over, near.near == over.hop, "left").select("node", F.least("near", "hop_label").alias("label"), (F.least("near", "hop_label") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = stepped.select("node", "label")
        if stepped.where("moved").isEmpty():
            return labels
