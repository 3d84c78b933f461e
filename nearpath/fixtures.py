"""Inputs derived from the ``embeddings`` table for the registered queries.

Every embedding is an object and a query. The stand-in for a trained index is
a tree of class means: a node scores a vector with the softmax of ten times
its inner product with the mean of each class, which is a logistic node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.functions.paths import path_key
from nearpath.functions.vectors import as_doubles, l2_normalize
from nearpath.operators.score import NODE_SCHEMA
from nearpath.plans.index import bucket_catalog
from nearpath.sources.workdir import settle

SHARPNESS = 10.0

# Values of a vector that are added up into one value of the reduced vector.
FOLD = 4


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v")
    )


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("query_id"), "v")


def scaled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are not of unit length: each grows with its label."""
    scale = 1 + F.col("label") / 4
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"),
        F.transform(as_doubles("embedding"), lambda x: x * scale).alias("v"),
    )


def folded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced representation: sums of neighbouring values, unit length."""
    v = as_doubles("embedding")
    starts = F.sequence(F.lit(1), F.size(v), F.lit(FOLD))
    folded = F.transform(
        starts,
        lambda at: F.aggregate(F.slice(v, at, FOLD), F.lit(0.0), lambda total, x: total + x),
    )
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), l2_normalize(folded).alias("v")
    )


def assignments(spark: SparkSession, sf_dir: str, n_levels: int) -> DataFrame:
    """Paths by label, then by the id modulo 3, by its third modulo 2, by its sixth modulo 2."""
    steps = [
        F.col("label"),
        F.pmod(F.col("vec_id"), F.lit(3)).cast("int"),
        F.pmod(F.floor(F.col("vec_id") / 3), F.lit(2)).cast("int"),
        F.pmod(F.floor(F.col("vec_id") / 6), F.lit(2)).cast("int"),
    ]
    return (
        embeddings(spark, sf_dir)
        .select(F.col("vec_id").alias("id"), F.array(*steps[:n_levels]).alias("path"))
        .withColumn("path_key", path_key("path"))
    )


def centroid_nodes(vectors: DataFrame, paths: DataFrame, n_levels: int) -> DataFrame:
    """A node table whose logistic nodes score by the means of their classes."""
    everything = vectors.join(paths.select("id", F.col("path").alias("leaf")), "id")

    def at_level(level: int) -> DataFrame:
        placed = everything.filter(F.size("leaf") > level)
        parent = F.slice("leaf", 1, level) if level else F.expr("cast(array() as array<int>)")
        means = (
            placed.groupBy(parent.alias("path"), F.col("leaf")[level].alias("class"))
            .agg(Summarizer.mean(array_to_vector(as_doubles("v"))).alias("mean"))
            .select("path", "class", vector_to_array("mean").alias("mean"))
        )
        members = means.groupBy("path").agg(
            F.array_sort(F.collect_list(F.struct("class", "mean"))).alias("members")
        )
        d = F.size(F.col("members")[0]["mean"])
        columns = F.transform(
            F.sequence(F.lit(0), d - 1),
            lambda j: F.transform("members", lambda m: m["mean"][j] * SHARPNESS),
        )
        return members.select(
            "path",
            path_key("path").alias("path_key"),
            F.lit(level).alias("level"),
            F.lit("logistic").alias("kind"),
            F.array(d, F.size("members")).alias("layers"),
            F.concat(
                F.flatten(columns), F.array_repeat(F.lit(0.0), F.size("members"))
            ).alias("weights"),
            F.size("members").alias("n_classes"),
            F.size("members").alias("n_requested"),
            F.size("members").alias("n_predicted"),
        )

    return reduce(DataFrame.unionByName, map(at_level, range(n_levels))).select(*NODE_SCHEMA.names)


class FixtureTree:
    """Objects, queries, paths, nodes and buckets of one such tree."""

    def __init__(self, spark: SparkSession, sf_dir: str, n_levels: int, reduced: bool = False,
                 ragged: bool = False):
        self.n_levels = n_levels
        self.vectors = folded_objects(spark, sf_dir) if reduced else objects(spark, sf_dir)
        self.queries = as_queries(self.vectors)
        self.assignments = assignments(spark, sf_dir, n_levels)
        if ragged:  # even labels end at the first level
            path = F.when(F.col("path")[0] % 2 == 0, F.slice("path", 1, 1)).otherwise(F.col("path"))
            self.assignments = self.assignments.withColumn("path", path).withColumn(
                "path_key", path_key("path"))
        # Both have a row per node or bucket and are used several times.
        self.nodes = settle(centroid_nodes(self.vectors, self.assignments, n_levels), "nodes")
        self.buckets = settle(bucket_catalog(self.assignments), "buckets")


def tiny_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very short vectors: their inner products differ far behind the point."""
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"),
        F.transform(as_doubles("embedding"), lambda x: x * 5e-4).alias("v"),
    )


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Almost equal vectors: the first one of the table, moved a little towards each."""
    table = embeddings(spark, sf_dir)
    first = table.orderBy("vec_id").select(as_doubles("embedding")).first()[0]
    moved = F.zip_with(
        F.array(*map(F.lit, first)), as_doubles("embedding"), lambda a, b: a + b * 3e-4)
    return table.select(F.col("vec_id").alias("id"), moved.alias("v"))


def perturbed_copies(
    spark: SparkSession, sf_dir: str, copies: int, partitions: int, amplitude: float = 0.05
) -> DataFrame:
    """Every embedding ``copies`` times, each copy moved a little by a fixed rule.

    Ids are new and unique: ``copy * 2^32 + vec_id``.
    """
    table = embeddings(spark, sf_dir).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    )
    turn = F.col("vec_id") * 37 + F.col("copy") * 101
    moved = F.transform(
        as_doubles("embedding"),
        lambda x, i: x + amplitude * F.sin(turn * (i + 1)),
    )
    return table.repartition(partitions, "vec_id", "copy").select(
        (F.col("copy").cast("long") * F.lit(1 << 32) + F.col("vec_id")).alias("id"),
        moved.cast("array<float>").alias("v"),
    )
