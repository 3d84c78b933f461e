"""Reading vector sets and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearpath.functions.vectors import as_floats
from nearpath.sources.workdir import work_dir


def read_vectors(
    spark: SparkSession, path: str, id_col: str, vector_col: str, id_name: str = "id"
) -> DataFrame:
    """Two columns of a Parquet table as ``(id BIGINT, v ARRAY<FLOAT>)``."""
    return spark.read.parquet(path).select(
        F.col(id_col).cast("long").alias(id_name), as_floats(vector_col).alias("v")
    )


def align_vectors(vectors: DataFrame, other: DataFrame, id_name: str = "id") -> DataFrame:
    """Carry a second representation of the same rows as column ``v_search``."""
    return vectors.join(other.select(id_name, F.col("v").alias("v_search")), id_name)


def read_ground_truth(
    spark: SparkSession, path: str, id_col: str = "query_id", knns_col: str = "knns"
) -> DataFrame:
    """One array of neighbour ids per query to ``(query_id, rank, neighbor_id)``."""
    rows = spark.read.parquet(path)
    return rows.select(
        F.col(id_col).cast("long").alias("query_id"), F.posexplode(knns_col).alias("pos", "n")
    ).select(
        "query_id",
        (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("n").cast("long").alias("neighbor_id"),
    )


def with_row_ids(rows: DataFrame, *order_by: str, name: str = "id") -> DataFrame:
    """Number rows 1..n in the order of columns that identify a row.

    The rows are range partitioned and written once, so the partition a row
    fell into is settled; each partition is then numbered on its own, shifted
    by the rows before it. No task sorts or counts the whole table.
    """
    spark = rows.sparkSession
    folder = work_dir(spark, "row-ids")
    (
        rows.repartitionByRange(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .write.partitionBy("_part")
        .parquet(folder)
    )
    parts = spark.read.parquet(folder)
    counts = parts.groupBy("_part").count()
    # One row per partition of the range sort, so this window stays small.
    before = counts.select(
        "_part",
        (
            F.sum("count").over(Window.orderBy("_part")) - F.col("count")
        ).alias("_before"),
    )
    position = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return (
        parts.withColumn("_position", position)
        .join(F.broadcast(before), "_part")
        .select(
            (F.col("_before") + F.col("_position")).cast("long").alias(name),
            *[c for c in rows.columns if c != name],
        )
    )
