"""Connected components over DataFrames, by alternating neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours (partial sums before the shuffle, so a hub is no
    hot task), then lets the label's own label replace it; rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder and the one before it is removed. Self loops and repeated edges are
    harmless; an empty input gives an empty result.
    """
    both = edges.select("a", "b").where("a <> b")
    both = scratch.save(both.union(both.select("b", "a")).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("above"))
        after = scratch.save(step.join(up, "low", "left").select("node", F.least("low", F.coalesce("above", "low")).alias("next"), F.col("root").alias("was")), "labels")
        changed = after.where("next <> was").limit(1).count()
        scratch.drop(labels)
        labels = after.select("node", F.col("next").alias("root"))
        labels._scratch_path = after._scratch_path
        if not changed:
            return labels
