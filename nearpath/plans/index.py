"""The index: five Parquet tables, and the search over them.

Objects lie in files of even size, in the order of their buckets' paths; a small
bucket shares a file, a large one has several. The table ``files`` says which
paths each file begins and ends with, so the buckets that a search visits become
a list of files, whatever their number.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearpath.functions.paths import path_key, path_of
from nearpath.operators.knn import broadcast_catalog, knn_in_buckets, knn_sweep
from nearpath.operators.navigate import navigate
from nearpath.operators.score import NODE_SCHEMA, SharedTree, share_tree

NODES, BUCKETS, OBJECTS, FILES, META = "nodes", "buckets", "objects", "files", "meta"

BUCKET_SCHEMA = "path array<int>, path_key string, n_objects long"
FILE_SCHEMA = "file string, first_path array<int>, last_path array<int>, n_objects long"
META_SCHEMA = (
    "n_levels int, n_objects long, n_buckets long, node_bytes long, value_type string, "
    "build_s double, cluster_s double"
)

# Bytes of objects that go to one task, and file, when the objects table is written.
TASK_BYTES = 256 << 20


def bucket_catalog(assignments: DataFrame) -> DataFrame:
    """The leaves that hold objects: ``(path, path_key, n_objects)``."""
    return assignments.groupBy("path", "path_key").agg(F.count(F.lit(1)).alias("n_objects"))


def node_catalog(assignments: DataFrame, level: int) -> DataFrame:
    """The inner nodes of a level that hold objects: ``(path, path_key, n_objects)``."""
    prefix = F.slice("path", 1, level).alias("path")
    return (
        assignments.select(prefix)
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n_objects"))
        .select("path", path_key("path").alias("path_key"), "n_objects")
    )


def attach_paths(objects: DataFrame, assignments: DataFrame) -> DataFrame:
    """Objects with the bucket they are stored in."""
    return objects.join(assignments.select("id", "path", "path_key"), "id")


def write_clustered(objects: DataFrame, buckets: DataFrame, folder: str, dimension: int) -> None:
    """Write objects in the order of their buckets' paths, in files of even size.

    The catalogue's counts say where in that order a bucket begins. A row goes
    to the file of its bucket's beginning plus its id's hash below the bucket's
    count: a bucket that holds a third of all rows fills many files, and small
    buckets lie together. ``buckets`` is ``(path, path_key, n_objects)``.
    """
    row_bytes = 8 * dimension + 64
    total = buckets.agg(F.sum("n_objects")).first()[0] or 0
    files = max(-(-total * row_bytes // TASK_BYTES),
                objects.sparkSession.sparkContext.defaultParallelism)
    rows_each = max(1, -(-total // files))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    begins = broadcast_catalog(buckets.select(
        "path_key", F.col("n_objects").alias("_n"),
        F.coalesce(F.sum("n_objects").over(before), F.lit(0)).alias("_begin")))
    place = F.col("_begin") + F.pmod(F.xxhash64("id"), F.col("_n"))
    (
        objects.join(begins, "path_key", "left")
        .withColumn("_file", F.coalesce((place / rows_each).cast("int"), F.lit(0)))
        .repartitionById(files, F.col("_file"))
        .sortWithinPartitions("path_key")
        .drop("_n", "_begin", "_file")
        .write.parquet(folder)
    )


def list_files(objects: DataFrame) -> DataFrame:
    """``FILE_SCHEMA`` rows of a folder of objects; reads their paths only."""
    return objects.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("path").alias("first_path"), F.max("path").alias("last_path"),
        F.count(F.lit(1)).alias("n_objects"))


class FileRanges:
    """Which files hold the objects of given paths. One row a file is kept here."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda row: (row["first_path"], row["last_path"]))
        self.files = [row["file"] for row in rows]
        self.first = [row["first_path"] for row in rows]
        self.last = [row["last_path"] for row in rows]

    def holding(self, paths) -> list[str]:
        chosen = set()
        for path in paths:
            # both ends ascend: a file ends where the next one begins, or before
            chosen.update(range(bisect_left(self.last, path), bisect_right(self.first, path)))
        return [self.files[i] for i in sorted(chosen)]


def store_objects(objects: DataFrame, buckets: DataFrame, folder: str) -> int:
    """Write the tables ``objects`` and ``files``; how many objects were written."""
    dimension = objects.agg(F.max(F.size("v"))).first()[0] or 0
    write_clustered(objects, buckets, f"{folder}/{OBJECTS}", dimension)
    spark = objects.sparkSession
    written = spark.read.schema(objects.schema).parquet(f"{folder}/{OBJECTS}")
    list_files(written).coalesce(1).write.parquet(f"{folder}/{FILES}")
    files = spark.read.schema(FILE_SCHEMA).parquet(f"{folder}/{FILES}")
    return files.agg(F.sum("n_objects")).first()[0] or 0


@dataclass
class Index:
    """``nodes``, ``buckets``, ``objects`` (id, v, path, path_key) and their ``files``
    below one folder."""

    spark: SparkSession
    folder: str
    _tree: SharedTree | None = field(default=None, repr=False)

    def _read(self, table: str, schema) -> DataFrame:
        # With the schema given, no job looks into the files first.
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    @cached_property
    def meta(self) -> dict:
        return self._read(META, META_SCHEMA).first().asDict()

    @cached_property
    def nodes(self) -> DataFrame:
        return self._read(NODES, NODE_SCHEMA).select(*NODE_SCHEMA.names)

    @cached_property
    def buckets(self) -> DataFrame:
        return self._read(BUCKETS, BUCKET_SCHEMA)

    @cached_property
    def objects(self) -> DataFrame:
        vector = f"v array<{self.meta['value_type']}>"
        return self._read(OBJECTS, f"id long, {vector}, path array<int>, path_key string")

    @cached_property
    def files(self) -> FileRanges:
        return FileRanges(self._read(FILES, FILE_SCHEMA).collect())

    def objects_of(self, keys: Sequence[str]) -> DataFrame:
        """The objects in files that hold the buckets of these keys, and few others."""
        chosen = self.files.holding(path_of(key) for key in keys)
        if not chosen:
            return self.objects.limit(0)
        places = [f"{self.folder}/{OBJECTS}/{name}" for name in chosen]
        return self.spark.read.schema(self.objects.schema).parquet(*places)

    @property
    def assignments(self) -> DataFrame:
        return self.objects.select("id", "path", "path_key")

    @property
    def n_buckets(self) -> int:
        return self.meta["n_buckets"]

    def bucket_order(
        self, queries: DataFrame, n_buckets: int, score: str = "conditional"
    ) -> DataFrame:
        """The buckets every query visits: ``(query_id, bucket_rank, path, path_key, probs)``."""
        if self._tree is None:
            self._tree = share_tree(
                self.nodes, self.buckets, self.meta["node_bytes"], self.meta["n_buckets"]
            )
        return navigate(queries, self.nodes, self.buckets, n_buckets, score, self._tree)

    def search(
        self,
        queries: DataFrame,
        n_buckets: int = 1,
        k: int = 10,
        queries_search: DataFrame | None = None,
        metric: str = "cosine",
        score: str = "conditional",
        **options,
    ) -> DataFrame:
        """The k nearest objects of each query in its first ``n_buckets`` buckets.

        ``queries`` navigate; ``queries_search``, by default the same, are
        compared with the stored objects. Rows are
        ``(query_id, rank, neighbor_id, distance)``.
        """
        visits = self.bucket_order(queries, n_buckets, score)
        searched = queries if queries_search is None else queries_search
        return knn_in_buckets(
            visits, searched, self.objects, k, metric=metric, prune=self.objects_of, **options)

    def sweep(
        self,
        queries: DataFrame,
        n_buckets: Sequence[int],
        k: int = 10,
        queries_search: DataFrame | None = None,
        metric: str = "cosine",
        score: str = "conditional",
        **options,
    ) -> DataFrame:
        """:meth:`search` for several numbers of buckets, navigating and comparing once."""
        visits = self.bucket_order(queries, max(n_buckets), score)
        searched = queries if queries_search is None else queries_search
        return knn_sweep(
            visits, searched, self.objects, n_buckets, k, metric=metric, prune=self.objects_of,
            **options)

    def save(self, folder: str) -> Index:
        """Copy the tables to another folder."""
        self.nodes.write.parquet(f"{folder}/{NODES}")
        self.buckets.write.parquet(f"{folder}/{BUCKETS}")
        self._read(META, META_SCHEMA).write.parquet(f"{folder}/{META}")
        store_objects(self.objects, self.buckets, folder)
        return load_index(self.spark, folder)


def load_index(spark: SparkSession, folder: str) -> Index:
    index = Index(spark, folder)
    if index.meta["n_levels"] < 1:
        raise ValueError(f"{folder} does not hold an index")
    return index
