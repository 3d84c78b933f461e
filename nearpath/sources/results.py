"""Result tables: neighbours and the record of the run that produced them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NEIGHBORS = "neighbors"
RUNS = "runs"

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("algo", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("clustering_algorithms", T.ArrayType(T.StringType())),
        T.StructField("n_categories", T.ArrayType(T.IntegerType())),
        T.StructField("model_types", T.ArrayType(T.StringType())),
        T.StructField("epochs", T.ArrayType(T.IntegerType())),
        T.StructField("lrs", T.ArrayType(T.DoubleType())),
        T.StructField("solver", T.StringType()),
        T.StructField("train_rows", T.IntegerType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("metric", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("normalized", T.BooleanType()),
        T.StructField("n_buckets", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("build_s", T.DoubleType()),
        T.StructField("cluster_s", T.DoubleType()),
        # Seconds of a search of its own; a sweep answers several runs at once
        # and has the seconds of all of them together.
        T.StructField("query_s", T.DoubleType()),
        T.StructField("sweep_s", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
    ]
)


def write_neighbors(neighbors: DataFrame, folder: str, run_id: str) -> DataFrame:
    """Store ``(query_id, rank, neighbor_id, distance)`` rows of one run and read them back."""
    target = f"{folder}/{NEIGHBORS}/run_id={run_id}"
    neighbors.select("query_id", "rank", "neighbor_id", "distance").write.mode(
        "overwrite"
    ).parquet(target)
    return neighbors.sparkSession.read.parquet(target)


def write_neighbors_of_runs(neighbors: DataFrame, folder: str) -> None:
    """Store rows of several runs, told apart by ``run_id``, in one write."""
    neighbors.select("query_id", "rank", "neighbor_id", "distance", "run_id").write.mode("append").partitionBy("run_id").parquet(
        f"{folder}/{NEIGHBORS}")


def read_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{NEIGHBORS}")


def append_runs(spark: SparkSession, folder: str, runs: list[dict]) -> DataFrame:
    """Append one row per run; returns the rows just written."""
    rows = [tuple(run.get(field.name) for field in RUN_SCHEMA) for run in runs]
    frame = spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1)
    frame.write.mode("append").parquet(f"{folder}/{RUNS}")
    return frame


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/{RUNS}")
