"""Connected components of a graph that is given as edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("node", "root"), F.lit(1 << 31))), F.lit(0))).first())


def stars(edges: DataFrame) -> DataFrame:
    """Edges (node, root) with node > root -> one edge from every node but the least of its component to that least node.

    Each round links every node's larger neighbours to its least one, then its smaller ones; it ends when a round
    changes nothing. Edges are written to the shared folder after each half, so no plan grows with the rounds.
    """
    edges = materialise(edges.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = materialise(both.groupBy("node").agg(F.min("root").alias("least")))
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.least("node", "least").alias("root"))
        large = materialise(large.distinct())
        discard(least, edges)
        least = materialise(large.groupBy("node").agg(F.min("root").alias("least")))
        small = large.join(least, "node").where(F.col("root") != F.col("least")).select(F.col("root").alias("node"), F.col("least").alias("root"))
        edges = materialise(small.unionByName(least.select("node", F.col("least").alias("root"))).distinct())
        discard(least, large)
        if (new := _state(edges)) == state:
            break
        state = new
    return edges
