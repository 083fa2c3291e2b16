"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour is tied to the smallest node around."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return (
        tied.unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for each node that has an edge.

    `edges` has the columns a and b; nodes need an order. Direction, loops and repeated edges don't
    matter. Neighbours are never gathered: the smallest is an aggregate with a partial before the
    shuffle, and joins meet one row a node. Each round is written to the shared folder; only a count
    comes to the driver. It ends when a round has exactly the edges of the one before. Rounds grow
    with the logarithm of the size.
    """
    ordered = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    state = stage(ordered.distinct(), "edges")
    count, same = state.count(), False
    while count and not same:
        last, before = state, count
        state = stage(_small_star(stage(_large_star(state), "edges")), "edges")
        count = state.count()
        # Edges are distinct, so as many of which none is new are the same ones.
        same = count == before and state.join(last, ["a", "b"], "left_anti").isEmpty()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
