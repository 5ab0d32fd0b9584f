"""Connected components of an edge table, by alternating star contraction.

Each round rewires edges towards smaller neighbours (large star, then small star) and
is written to the shared folder, so neither lineage nor the driver grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import join_facts, settle


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m) of (a, b) edges, m the smallest b of a.  The centre of a large component is a hot key."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_facts(edges, least, "a", "n", total).select("a", "b", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of a node join its smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _with_least(both, 2 * total).withColumn("m", F.least("m", "a"))
    return near.where("b > a AND b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Smaller neighbours of a node, and the node itself, join the smallest of them; edges have a > b."""
    near = _with_least(edges, total)
    moved = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(near.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    """Number and order-free digest of the edges."""
    return edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (a, b) edges, root the component's smallest node.

    Nodes are comparable values; self-edges, repeated edges and an empty table are
    allowed, null nodes are not.  Roots of their own are listed too if an edge names
    them.  Rounds go on until one changes nothing; their number grows with the logarithm
    of a component's size.
    """
    current = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, before = _mark(current), None
    while mark != before:
        # The large star comes back once more in the small star, which needs its rows twice.
        large = settle(_large_star(current, mark["n"]), "large_stars")
        current, before = settle(_small_star(large, large.count()), "stars"), mark
        mark = _mark(current)  # stars with the same rows as the round before are final: every node points at its root
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
