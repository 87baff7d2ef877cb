"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import discard, kept


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``: the smallest node reachable.

    Each round takes the smallest label among neighbours and then the label of
    that label, so that the rounds grow with the logarithm of a path's length.
    Minima combine before the shuffle, so a node with very many edges needs no
    task of its own. Rounds are written to the shared folder. An edge table
    without rows gives no rows; loops and repeated edges change nothing.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = kept(both, f"{name}-edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), f"{name}-labels")
    was = labels
    while True:
        # each node's own label and its neighbours', one row a node
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.lit(None).cast("long").alias("was"), "component")
        own = labels.select("node", F.col("component").alias("was"), "component")
        lower = own.union(near).groupBy("node").agg(F.max("was").alias("was"), F.min("component").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("jumped"))
        moved = lower.join(jump, "via").select("node", "was", F.least("via", "jumped").alias("component"))
        moved = kept(moved, f"{name}-labels")
        discard(was)
        labels, was = moved.select("node", "component"), moved
        if moved.where("component <> was").isEmpty():
            discard(both)
            return labels
