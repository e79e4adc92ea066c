"""Connected components of a graph given as edges, by alternating stars.

Large-star links every neighbour above a node to the smallest node it knows; small-star
does so with the neighbours below. Both keep components whole; after a few rounds (about
the logarithm of the longest path) every node hangs from the smallest of its component. Rounds
are cut by written tables, and minima are pre-aggregated, so a node with very many
neighbours costs one row for each task before the join, which Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MOST_ROUNDS = 60


def stars(edges: DataFrame) -> DataFrame:
    """One round: large-star, then small-star; edges are (a, b)."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a and b != m").select(F.col("m").alias("b"), F.col("b").alias("a"))
    large = large.union(least.where("a != m").select(F.col("m").alias("b"), "a")).distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has an edge to another."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.sum("b").alias("m")).first()
        if seen == state or not seen["n"]:
            break
        state = seen
        now = materialize(stars(now), "edges")
    else:
        raise RuntimeError("components did not settle")
    member = lambda x: F.struct(F.col(x).alias("node"), F.col("b").alias("component"))
    return now.select(F.inline(F.array(member("a"), member("b")))).distinct()
