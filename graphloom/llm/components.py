"""Connected components by alternating large-star and small-star steps, DataFrame operations only.

Each step is a grouped minimum (summed before the shuffle) and an equi-join against one row a node,
so a hub that holds a third of all edges is split by the adaptive skew join and never meets in one
task. The rounds needed grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of any ordered type -> (node, root): root is the least node that can be reached.

    Self loops and rows with a null end give no edge; repeated and reversed rows count once. Nodes
    without an edge aren't listed. Raises RuntimeError if it isn't done after ``rounds`` rounds.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _state(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        e = materialize(_small_star(_large_star(e)).distinct(), "edges")
        now = _state(e)
        if now == seen:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        seen = now
    raise RuntimeError(f"components not settled after {rounds} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least node of its neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return e.join(low, "u").select(moved.alias("u"), F.col("m").alias("v"))
