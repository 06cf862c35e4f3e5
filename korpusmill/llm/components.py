"""Connected components of a link table by repeated contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.common import drop, stored


def connected(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of links (a, b), stored. Self-links and repeated links don't matter.

    Each round sends a node to its least neighbour (or itself) and moves the links' ends along; links inside one node vanish, so the table
    shrinks fast, stars in one round. Every round is written to the shared folder: lineage stays short, a lost executor costs a round at most;
    a round's tables go when the next one's are written.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("least")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("least")))
        sent = stored(ends.groupBy("node").agg(F.min("least").alias("label")))
        at = lambda c: sent.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}"))  # noqa: B023,E731
        moved = edges.join(at("a"), "a").join(at("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        after = stored(moved.where("a < b").distinct())
        drop(edges)
        edges = after
        if labels is None:
            labels = sent
        else:
            now = stored(labels.join(sent.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
            drop(labels, sent)
            labels = now
    if labels is None:
        return stored(edges.select(F.col("a").alias("node"), F.col("b").alias("label")))
    drop(edges)
    return labels
