"""Connected components of a table of edges by alternating star steps (a distributed union-find).

A large-star step hangs every neighbour above a node onto the smallest node it sees, a small-star step does so for the
neighbours below; in a logarithmic number of rounds every edge leads from a node to the smallest of its component.
Minima are pre-aggregated into tables of their own and met by joins that Spark can split, so a node with very many edges is no single task.
Each round ends in a table in the shared folder. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settled


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settled(both.groupBy("u").agg(F.min("v").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = settled(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns a, b); component is its smallest node.
    Loops and nulls are left out; an edge may repeat and point either way. No edges: no rows."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = settled(now, "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        now = settled(_small(settled(_large(now), "edges")), "edges")
        if (after := _mark(now)) == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"no end of star steps after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
