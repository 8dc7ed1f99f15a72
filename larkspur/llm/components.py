"""Connected components of an edge table by alternating stars, as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import met, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (u, v) can reach; nodes are longs.

    Large-star links the larger neighbours of a node to its smallest one, small-star the smaller ones and
    the node itself; after about log(n) squared rounds every component is one star. A node's neighbours
    are never gathered: their minimum is aggregated and joined back, and what a hub's edges meet is broadcast. Each round ends in a written table.
    """
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(_least(both).withColumn("m", F.least("n", "m")))
        large = met(both.where("v > u"), least, [("u", "n")], ["m"], "degree", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct())
        least = saved(_least(large))
        small = met(large, least, [("u", "n")], ["m"], "degree", large.count())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        edges = saved(small.where("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _least(edges: DataFrame) -> DataFrame:
    """(n, m, degree): the smallest neighbour of each node and how many it has."""
    return edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
