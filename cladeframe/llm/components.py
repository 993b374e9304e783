"""Connected components of a distributed graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v). Minima are combined before they are shuffled, and joined
    back to the edges, so a node with very many neighbours is split like any skewed join."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    to = both.join(least, "u")
    out = to.where("v > u") if large else to.where("v <> m")
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); a component is named by its smallest node.

    Edges are undirected; loops and repeats do no harm. The rounds end when nothing changes; their
    number grows with the logarithm of the nodes. Each round is written to the shared folder.
    """
    edges = checkpoint(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while True:
        edges = checkpoint(stars(stars(edges, True), False))
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
