"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwell.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("least")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of an edge.

    Large and small stars in turn: each node's larger neighbours, then its smaller ones, are tied
    to the least it knows, until nothing changes. Each turn is sums by node and joins, which adaptive
    execution splits at a hub. Loops and nulls are left out.
    """
    edges = cut_lineage(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        large = cut_lineage(large)
        tied = large.join(_least(large), "u")
        edges = cut_lineage(tied.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            tied.select("u", F.col("least").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
