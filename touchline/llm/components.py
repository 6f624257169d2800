"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the smallest node that it reaches.

    Labels fall to the smallest neighbouring label and then jump to their own label's label, so rounds grow with the
    logarithm of a path's length. Every round is a grouped minimum over written tables: nothing is collected but one
    count, a node with many edges is summed before the shuffle, and a lost executor costs one round's work.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("label")), "b")
        lowest = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = settle(labels.join(lowest, "node").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("before")))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = settle(nearer.join(jump, "label", "left").select(
            "node", F.least("label", "far").alias("label"), "before"))
        if after.where("label <> before").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
