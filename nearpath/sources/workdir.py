"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder path below ``spark.checkpoint.dir``.

    Tables written there outlive lost executors. Without that setting only a
    local session gets a folder of its own; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # not local-cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="nearpath-")
    return f"{root.rstrip('/')}/nearpath-{label}-{uuid.uuid4().hex}"


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the working folder and read them back: they are computed once."""
    return settle_in(rows, label)[0]


def settle_in(rows: DataFrame, label: str) -> tuple[DataFrame, str]:
    """:func:`settle`, and the folder, for a caller that discards it later."""
    folder = work_dir(rows.sparkSession, label)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a table of the working folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
