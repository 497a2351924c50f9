"""Connected components as DataFrame joins: contraction to the least neighbour with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of an edge, the component being its least node.

    Each round every node of the contracted graph points to its least
    neighbour, chains are halved by pointer jumping, and edges are relabelled;
    rounds grow with the logarithm of the longest chain. ``cut`` materialises a
    DataFrame (a checkpoint or a written table). Loops are allowed; null ends
    are skipped. Raises if ``MAX_ROUNDS`` are not enough.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = lambda e: e.union(e.select(F.col("b"), F.col("a")))
    labels = cut(both(pairs).select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    live = cut(pairs.where("a <> b").distinct())
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            return labels
        up = both(live).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        up = cut(up)
        for _ in range(2):
            over = up.select(F.col("a").alias("q"), F.col("p").alias("pp"))
            up = up.join(over, F.col("p") == F.col("q"), "left").select("a", F.coalesce("pp", "p").alias("p"))
        up = cut(up)
        to = up.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        labels = cut(labels.join(to, F.col("component") == F.col("q"), "left").select("node", F.coalesce("pp", "component").alias("component")))
        a = live.join(to, F.col("a") == F.col("q"), "left").select(F.coalesce("pp", "a").alias("a"), "b")
        live = cut(
            a.join(to, F.col("b") == F.col("q"), "left").select("a", F.coalesce("pp", "b").alias("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        )
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds; {live.count()} edges remain")
