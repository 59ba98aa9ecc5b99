"""Connected components of edges in a table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) of longs -> (node, root): root is the smallest node that can be reached. Nodes without an edge don't occur.

    A round takes each node to the smallest label next to it and then to that one's label, so that paths halve.
    """
    both = settle(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), name)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        own = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("root").alias("up"))
        jumped = own.join(up, "to", "left").select("node", F.least("to", F.coalesce("up", "to")).alias("root"), (F.least("to", F.coalesce("up", "to")) < F.col("root")).alias("changed"))
        done = settle(jumped, name)
        changed = done.where("changed").limit(1).count()
        drop_settled(labels)
        labels = done.select("node", "root")
        if not changed:
            drop_settled(both)
            return labels
