"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .skew import join_keyed


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it is connected with) for each node of ``edges`` (a, b; longs).

    Each round links all larger neighbours of a node to its least neighbour, then all smaller ones;
    minima are aggregated before the shuffle, nodes with a great share of the edges are
    joined by broadcast, and rows hold two longs. Rounds grow with the logarithm
    of the longest path. Every round ends in a written table. No edges in, no rows out.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _signature(now)
    while state[0]:
        now = written(_small_star(written(_large_star(now, state[0])), state[0]))
        if (after := _signature(now)) == state:
            break
        state = after
    parents = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return parents.unionByName(parents.select(F.col("label").alias("node"), "label").distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("rows")).select("x", "rows", F.least("x", "m").alias("m"))
    return join_keyed(both.filter("y > x"), least, "x", "rows", 2 * total).select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
    moved = join_keyed(edges, least, "u", "rows", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
