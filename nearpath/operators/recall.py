"""Comparing found neighbours with the true ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _recall(wanted: DataFrame, found: DataFrame, k: int, by: list[str]) -> DataFrame:
    keys = [*by, "query_id", "neighbor_id"]
    got = found.filter(F.col("rank") <= k).select(*keys, F.lit(1).alias("hit"))
    per_query = (
        wanted.join(got, keys, "left").groupBy(*by, "query_id").agg(F.count("hit").alias("hits"))
    )
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("hits").alias("hits"),
        (F.sum("hits") / (F.count(F.lit(1)) * k)).alias("recall"),
    )


def recall_at_k(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of the k true neighbours that were found: one row."""
    wanted = truth.filter(F.col("rank") <= k).select("query_id", "neighbor_id")
    return _recall(wanted, found, k, [])


def recall_sweep(
    found: DataFrame, truth: DataFrame, n_buckets: Sequence[int], k: int = 10
) -> DataFrame:
    """Recall for every number of buckets of a sweep: one row per number."""
    numbers = F.array(*[F.lit(n).cast("long") for n in n_buckets])
    wanted = truth.filter(F.col("rank") <= k).select(
        F.explode(numbers).alias("n_buckets"), "query_id", "neighbor_id"
    )
    return _recall(wanted, found, k, ["n_buckets"])
