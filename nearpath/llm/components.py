"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.sources.workdir import discard, settle_in


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v``; a component is
    named by its smallest node.

    Alternates large and small stars: each node hands its larger, then its
    smaller neighbours on to the smallest one. Neighbours meet in an aggregate
    and a join, never in one list, so a node may have any number of them. Each
    round is written to the shared folder, which also cuts the lineage.
    """
    edges, folder = settle_in(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = None
    while (now := _state(edges)) != before and now[0]:
        before, old = now, folder
        edges, folder = settle_in(_small_star(_large_star(edges)), "edges")
        discard(edges.sparkSession, old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("centre"), F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("centre"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge goes from a larger node to a smaller one
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("centre"), "m")
    passed = edges.join(least, F.col("u") == F.col("centre")).select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        passed.where(F.col("u") != F.col("v"))
        .unionByName(least.select(F.col("centre").alias("u"), F.col("m").alias("v"))).distinct()
    )
