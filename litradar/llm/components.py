"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of the undirected edges ``a, b``; the component is its smallest node.

    Each round every node points to its smallest neighbour, pointers are followed twice, and the edges are rewritten to
    the ends of the pointers; edges inside a component vanish, so the tables shrink. Rounds end when no edge is left.
    All steps are grouped minima and joins with one right row per key, so a node with very many edges splits well.
    """
    ends = edges.select("a", "b").where(F.col("a") != F.col("b"))
    ends = cut_lineage(ends.union(ends.select("b", "a")).distinct())
    labels = cut_lineage(ends.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while not ends.isEmpty():
        point = cut_lineage(ends.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        for _ in range(2):
            onward = point.select(F.col("a").alias("to"), F.col("to").alias("_next"))
            point = cut_lineage(point.join(onward, "to", "left").select("a", F.coalesce("_next", "to").alias("to")))
        moved = point.select(F.col("a").alias("component"), F.col("to").alias("_to"))
        labels = cut_lineage(labels.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component")))
        first = ends.join(point, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        both = first.join(point, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        ends = cut_lineage(both.where(F.col("a") != F.col("b")).distinct())
    return labels
