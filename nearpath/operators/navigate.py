"""Ranking the buckets of an index for every query.

The walk to reproduce takes the most probable waiting node first, where a
node waits under its own probability, given its parent. Its order of leaves
needs no queue. Take two leaves and the ancestor where they part: once that
ancestor has been taken, the branch whose weakest node is stronger is
finished first. So the leaves sort, descending, by the list of the smallest
probabilities from each level down: (min(p1..pL), min(p2..pL), ..., pL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpath.functions.paths import ROOT_KEY, path_key
from nearpath.operators.knn import broadcast_catalog
from nearpath.operators.score import (
    SharedTree, broadcast_queries, expand, score_leaves, share_tree,
)
from nearpath.sources.workdir import settle

SCORES = ("conditional", "joint")

def order_keys(probs: Column, score: str = "conditional") -> Column:
    """The sort key of a leaf, to be taken in descending order."""
    if score == "joint":
        return F.array(F.aggregate(probs, F.lit(1.0), lambda total, p: total * p))
    if score != "conditional":
        raise ValueError(f"unknown score {score!r}, expected one of {SCORES}")
    levels = F.sequence(F.lit(1), F.size(probs))
    return F.transform(
        levels, lambda level: F.array_min(F.slice(probs, level, F.size(probs)))
    )


def leaf_probabilities(scores: DataFrame, buckets: DataFrame, n_levels: int) -> DataFrame:
    """Chain the scores of the levels into one row per query and bucket.

    ``scores`` is ``(query_id, parent_key, class, prob)``; only paths listed in
    ``buckets`` remain, so a class that holds no object takes no place. A bucket
    may end at any level.
    """
    step = scores.select("query_id", "parent_key", "class", "prob")
    known = broadcast_catalog(buckets.select("path_key"))
    reached = step.filter(F.col("parent_key") == ROOT_KEY).select(
        "query_id", F.array("class").alias("path"), F.array("prob").alias("probs")
    ).withColumn("path_key", path_key("path"))
    leaves = reached.join(known, "path_key", "left_semi")
    for _ in range(1, n_levels):
        reached = (
            reached.withColumnRenamed("path_key", "parent_key")
            .join(step, ["query_id", "parent_key"])
            .select(
                "query_id",
                F.array_append("path", F.col("class")).alias("path"),
                F.array_append("probs", F.col("prob")).alias("probs"),
            )
            .withColumn("path_key", path_key("path"))
        )
        leaves = leaves.unionByName(reached.join(known, "path_key", "left_semi"))
    return leaves


def rank_buckets(
    leaves: DataFrame, n_buckets: int | None = None, score: str = "conditional"
) -> DataFrame:
    """The first buckets of every query: ``(query_id, bucket_rank, path, path_key, probs)``.

    Equal keys fall to the smaller path. Asking for more buckets than there
    are returns all of them.
    """
    window = Window.partitionBy("query_id").orderBy(F.col("_keys").desc(), "path")
    ranked = leaves.withColumn("_keys", order_keys(F.col("probs"), score)).withColumn(
        "_rank", F.row_number().over(window)
    )
    if n_buckets is not None:
        ranked = ranked.filter(F.col("_rank") <= n_buckets)
    return ranked.select(
        "query_id", F.col("_rank").cast("long").alias("bucket_rank"), "path", "path_key", "probs"
    )


def walk_levels(
    queries: DataFrame, nodes: DataFrame, buckets: DataFrame, n_buckets: int,
    score: str = "conditional",
) -> DataFrame:
    """The leaves that can be among each query's best, for a tree of any size.

    No leaf below a node sorts before the node's own bound: the smallest
    probability (or, for ``joint``, the product) down to it. A first walk goes
    down with the ``n_buckets`` best nodes of each query and level; the n-th best
    leaf it finds is a lower bound of the n-th best of all. The second walk
    expands every node that reaches it and drops the others with all that lies
    below them. Rows are ``(query_id, path, path_key, probs)``; at each level a
    query has rows for the children of its waiting nodes only.
    """
    levels = [row[0] for row in nodes.select("level").distinct().orderBy("level").collect()]
    queries = broadcast_queries(queries.select("query_id", "v"))
    inner = broadcast_catalog(nodes.select("path_key"))
    ends = broadcast_catalog(buckets.select("path_key"))
    held = broadcast_catalog(
        nodes.select("path_key").unionByName(buckets.select("path_key")).distinct())
    root = queries.select(
        "query_id", F.expr("cast(array() as array<int>)").alias("path"),
        F.lit(ROOT_KEY).alias("path_key"), F.expr("cast(array() as array<double>)").alias("probs"),
        F.lit(1.0).alias("bound"))
    # the same leaf, scored beside other rows, may differ in the last bits
    slack = 1 - 1e-9
    best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "path")

    def down(keep) -> DataFrame:
        """Every leaf reached when ``keep`` chooses among the children of a level."""
        found, frontier = None, root
        for level in levels:
            children = settle(
                keep(expand(frontier, queries, nodes.filter(F.col("level") == level), score)),
                "frontier")
            leaves = children.join(ends, "path_key", "left_semi")
            found = leaves if found is None else found.unionByName(leaves)
            frontier = children.join(inner, "path_key", "left_semi")
        return found

    def beam(children: DataFrame) -> DataFrame:
        known = children.join(held, "path_key", "left_semi")
        return known.withColumn("_rank", F.row_number().over(best)).filter(
            F.col("_rank") <= n_buckets).drop("_rank")

    first = down(beam).withColumn("_rank", F.row_number().over(best))
    least = settle(
        first.filter(F.col("_rank") == n_buckets)
        .select("query_id", (F.col("bound") * slack).alias("least")), "least")

    def reaching(children: DataFrame) -> DataFrame:
        # a query whose first walk found fewer leaves keeps everything
        return children.join(least, "query_id", "left").filter(
            F.col("bound") >= F.coalesce("least", F.lit(-1.0))).drop("least")

    return down(reaching).select("query_id", "path", "path_key", "probs")


def navigate(
    queries: DataFrame, nodes: DataFrame, buckets: DataFrame, n_buckets: int,
    score: str = "conditional", tree: SharedTree | None = None,
) -> DataFrame:
    """Rank the buckets of an index for every query, keeping ``n_buckets``.

    A tree that can be broadcast is scored in one pass over the queries; a
    larger one by two walks from level to level (:func:`walk_levels`).
    """
    if n_buckets < 1:
        raise ValueError("n_buckets must be at least 1")
    tree = tree or share_tree(nodes, buckets)
    if tree is not None:
        leaves = score_leaves(queries, tree, n_buckets, score)
    else:
        leaves = walk_levels(queries, nodes, buckets, n_buckets, score)
    return rank_buckets(leaves, n_buckets, score)
