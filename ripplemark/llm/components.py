"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins over all edges; a round's edges
are written to the shared folder, so lineage stays short. A hub with a third of
all edges is one row in the grouped side of a join, and adaptive execution
splits the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Saved


def _large_star(edges: DataFrame) -> tuple[DataFrame, Saved]:
    """Each larger neighbour of a node moves to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    # a written table, as only a join of two shuffles can split the rows of a hub
    least = Saved(least.select("c", F.least("c", "m").alias("m")), "least")
    return both.where("v > u").join(least.df, F.col("u") == F.col("c")).select(F.col("m").alias("u"), "v"), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, Saved]:
    """Each node and its smaller neighbours move to the least of them."""
    least = Saved(edges.groupBy(F.col("v").alias("c")).agg(F.min("u").alias("m")), "least")
    moved = edges.join(least.df, F.col("v") == F.col("c")).where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.df.select(F.col("m").alias("u"), F.col("c").alias("v"))).distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v) edges; root is the least node of the component.

    Edges may repeat and run either way; loops and nulls count for nothing.
    Without edges there are no rows.
    """
    now = Saved(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        new = now.df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if new == mark:
            break
        mark, last = new, now
        large, a = _large_star(last.df)
        mid = Saved(large, "edges")
        small, b = _small_star(mid.df)
        now = Saved(small, "edges")
        for done in (last, a, mid, b):
            done.drop()
    leaves = now.df.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return leaves.unionByName(now.df.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
