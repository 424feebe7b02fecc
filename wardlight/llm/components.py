"""Connected components by alternating star contraction; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import cut, drop


def _hang(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each u with the least of itself and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # least(u, u): this side is shuffled anew, since adaptive execution splits a hub's partition only where both sides of a
    # join come straight from a shuffle.
    least = _hang(both).select(F.least("u", "u").alias("u"), "m")
    hung = both.join(least, "u").where(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges point to smaller nodes (u > v): hangs a node and its smaller neighbours on the least of them."""
    hung = edges.join(_hang(edges), "u")
    flat = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
    return flat.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v), undirected, of any ordered type → (node, component), component being the least node.

    Nulls and loops are ignored, repeated edges count once; nodes without an edge do not appear; no edges give no rows.
    The least neighbour is a partial aggregate, so a hub with very many edges is combined before its shuffle, and the
    join after it is one whose skewed partitions adaptive execution splits. Each round is written
    to the shared folder and the round before it is deleted. Nothing is collected but two numbers a round.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now = cut(edges.where("u <> v").select(u.alias("u"), v.alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        after = cut(_small(_large(now)))
        drop(now)
        now, found = after, mark(after)
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components have not settled")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
