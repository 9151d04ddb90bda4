"""Connected components of an edge list, by alternating large and small stars.

Edges stay in tables; the driver sees one count and one sum for each round. Rounds grow with the
logarithm of the longest path, not with the size of a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node (the larger ones, or the smaller ones and itself) to the least
    of its neighbours and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "_a")
    joined = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    edges: two long columns a and b, in any order, repeats allowed. Nulls and loops are ignored.
    Each round is written to the shared folder, so a lost executor costs a part of one round."""
    edges = materialize(edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        before, edges = edges, materialize(_star(_star(edges, True), False), "edges")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            found = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()), "components")
            discard(edges)
            return found
        seen = now
    raise RuntimeError("components did not settle")
