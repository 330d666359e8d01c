"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.session import through_table


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): the least of u and its neighbours. Combines before the shuffle; a hub's
    rows meet its minimum in a join, which adaptive execution can split."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) long edges -> (node, root): each node that has an edge, and the least node reachable.

    Large-star moves neighbours above a node to its minimum, small-star those below it; a fixed
    point is a forest of stars. Every round is written to the shared folder, which cuts lineage.
    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = through_table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _toward_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = through_table(small.where("u != v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
