"""Merging candidates into the k best per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_top_k(candidates: DataFrame, k: int, *partition_by: str) -> DataFrame:
    """Rank by (distance, neighbor_id) and keep k rows per query.

    The filter sits on the bare row number, so Spark cuts every map output to
    k rows per query before the shuffle.
    """
    groups = partition_by or ("query_id",)
    window = Window.partitionBy(*groups).orderBy("distance", "neighbor_id")
    return (
        candidates.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= k)
        .select(
            *groups,
            F.col("_rank").cast("long").alias("rank"),
            "neighbor_id",
            "distance",
        )
    )
