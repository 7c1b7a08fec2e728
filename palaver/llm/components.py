"""Connected components by alternating large and small stars, one table of edges a round, none of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, stash


def _star(edges: DataFrame, large: bool, rows: int) -> tuple[DataFrame, str]:
    """Edges (u > v).  Large: neighbours above a node go to its least neighbour.  Small: a node and its lower neighbours do."""
    both = edges.select(F.col("u").alias("at"), F.col("v").alias("to"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("at"), F.col("u").alias("to")))
    least, least_at = stash(both.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("least")), "least", 2 * rows)
    joined = both.join(least, "at")
    moved = joined.filter("to > at" if large else "to != least").select(F.col("to").alias("u"), F.col("least").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("at").alias("u"), F.col("least").alias("v")))
    out = stash(moved.filter("u > v").distinct(), "star", 2 * rows)
    discard(edges.sparkSession, least_at)
    return out


def _state(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return found[0], found[1] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; ``links`` holds longs (a, b) in either order.  The component is its smallest node."""
    spark = links.sparkSession
    edges, edges_at = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        wide, wide_at = _star(edges, True, state[0])
        discard(spark, edges_at)
        edges, edges_at = _star(wide, False, state[0])
        discard(spark, wide_at)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
