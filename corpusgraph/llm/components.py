"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.runtime import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them. All edges point downwards here."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    below = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return below.union(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; longs, a <> b); ``root`` is the least node of its component.

    Each round is written to shared storage. The least of a node's neighbours is a map-side aggregate, and a node
    with very many edges only lengthens a join that Spark can split. The rounds end when a round changes no edge,
    about the logarithm of the longest path later."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, mark = materialise(down, "edges"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        state = materialise(_small_star(_large_star(state).distinct()).distinct(), "edges")
    tied = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tied.union(tied.select(F.col("root").alias("node"), "root").distinct())
