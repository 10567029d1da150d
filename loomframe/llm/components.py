"""Connected components of an edge table by alternating large and small stars.

Every round rewrites the edges through joins and partial aggregates and writes them to the shared
folder; no links or labels reach the driver, and the number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.session import materialize

MAX_ROUNDS = 200  # far beyond what any graph needs; passing it is an error, never a shorter result


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the least node among it and its neighbours."""
    both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    moved = both.join(least, "v").filter(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.filter(F.col("v") != F.col("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Neighbours below a node, and the node itself, move to the least of them; edges point down (v > u)."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter(F.col("v") != F.col("u"))
    return moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the least node reachable. Nodes that are their own least are left out."""
    down = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    down = materialize(down.distinct(), "links")
    state = _state(down)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        down = materialize(_small_star(_large_star(down)), "links")
        before, state = state, _state(down)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return down.select(F.col("v").alias("node"), F.col("u").alias("component"))
