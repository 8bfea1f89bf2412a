"""Connected components of an edge list, by alternating large-star and small-star steps (joins and grouped minima only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialise


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with b < a. Both keep the components and never lengthen a path; together they fold long chains by a factor a round."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # large star: larger neighbours of a node hang on the least of all its neighbours and itself
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # small star: a node and its smaller neighbours hang on the least of them
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b) but lone loops: the smallest node reachable.

    Rounds go on until the edges are stars; their number grows with the logarithm of the longest path, whatever the order of the nodes, and has no cap. Each round's edges (never more than the distinct input edges plus
    nodes) are written to the shared folder. Minima of hubs are combined before the shuffle; the joins meet unique keys on one side, so adaptive execution splits a hub's rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = materialise(pairs, "cc-edges"), None
    while True:
        was = mark
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == was or not mark["n"]:
            break
        now = materialise(_starred(now), "cc-edges")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
