"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round takes the smallest label next to a node, then the label of that label; both are aggregations with
    a partial step, so a node with very many edges costs no task more than others. Labels stay in tables in the
    shared folder. No edges give no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hung = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = stored(
            hung.join(up, "component").select("node", "was", F.least("component", "up").alias("component")), "labels"
        )
        drop_stored(labels)
        labels = jumped.drop("was")
        labels._quillmark_path = jumped._quillmark_path
        if jumped.where("component <> was").isEmpty():
            drop_stored(both)
            return labels
