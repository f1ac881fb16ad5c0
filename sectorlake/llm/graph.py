"""Connected components of an edge table, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node it
    can reach.

    Alternating large-star and small-star rounds: every node's edges are
    rehung on its smallest neighbour until the graph is a forest of stars.
    The number of rounds grows with the logarithm of a component's size, and
    a hub of m edges costs m rows.  Every round is written to the shared
    folder, so lineage stays short and lost executors are no loss.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    pairs = keep(pairs)
    for _ in range(MAX_ROUNDS):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang on u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        # small star: v and its smaller neighbours hang on v's smallest neighbour
        hung = large.join(low, "v")
        small = (
            hung.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
            .union(low.select(F.col("m").alias("u"), "v"))
            .where("u < v")
            .distinct()
        )
        small = keep(small)
        stars = small.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        if stars.isEmpty():
            inner = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
            if inner.isEmpty():
                pairs = small
                break
        pairs = small
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("label")).union(pairs.select("u", "u").distinct().toDF("node", "label"))
