"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.store import settle

MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node of `edges (a, b)`; the root is the component's least node.

    Each round links all larger neighbours of a node to its least neighbour,
    then all smaller ones (large star, small star). The number of edges never
    grows, the number of rounds is about the squared logarithm of the longest
    chain, and the minima are pre-aggregated before the shuffle. Edges stay in
    tables; the driver sees two counts a round.
    """
    e = settle(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # done when no least end of an edge hangs below another node
        if e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        e = settle(_small_star(settle(_large_star(e), "large")), "small")
    raise RuntimeError("components did not settle")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    joined = e.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
