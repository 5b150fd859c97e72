"""Connected components of an undirected graph, by alternating stars.

Each round keeps the edges as a set that only shrinks or moves towards the
smallest id: a large-star step links the larger neighbours of a node to its
smallest neighbour, a small-star step does so for the smaller ones. The least
neighbour comes from a groupBy (combined before the shuffle) and is joined
back, so that a node with very many edges is a skewed join, which Spark
splits, and never one group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges point from ``u`` to the smaller ``v``."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        moved = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Return ``(id, component)`` for every id that an edge touches.

    ``component`` is the smallest id that links reach. Null ends, loops and
    repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = cut(
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        now = cut(_star(_star(now, large=True), large=False))
        before, seen = seen, _digest(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
