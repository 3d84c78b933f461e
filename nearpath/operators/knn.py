"""Exact nearest neighbours, over all objects or inside chosen buckets.

Both are the same job: every object and every visit of a query carries a
bucket key, and a brute-force search has one bucket that holds everything.
Queries that are few enough are broadcast, and the objects are scanned where they
lie; no object is shuffled. More queries and the objects are dealt into the cells
of a grid by one shuffle: a cell holds a bounded part of the queries and streams a
part of the objects past them. A task hands on at most k rows per group of a query,
never a row per pair.

Many tasks would still hand on k rows each. So a search of n tasks first runs
about sqrt(n) of them, spread evenly, and merges what they find. The k-th best
distance of a few objects is an upper bound of the k-th best of all; broadcast
to the scan, it leaves to every task only what reaches it. Both merges then see
about sqrt(n) times k rows of a query instead of n times k, and the answer is
the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearpath.functions.paths import ROOT_KEY
from nearpath.operators.kernel import RunningTopK, nearest, rows_by_key, to_matrix, unit_rows
from nearpath.operators.topk import merge_top_k
from nearpath.sources.workdir import settle

METRICS = ("cosine", "inner_product")

# Query vectors plus visits that may be broadcast, in bytes.
BROADCAST_BYTES = 16 << 20

# What a visit takes at most, in bytes.
VISIT_BYTES = 64

# Queries, their visits and the best of their objects in one cell of a grid, in bytes.
CELL_BYTES = 128 << 20

# What one of the best objects of a query takes in a task, in bytes.
FOUND_BYTES = 80

# Cells of a grid per core, so that none waits long for the last of them.
CELLS_PER_CORE = 3

# Queries and visits that make a cell worth having, in bytes.
LEAST_CELL_BYTES = 32 << 10

# Values of object vectors that a task compares at once.
SCAN_VALUES = 4_000_000

# Visited buckets that are listed in a filter, by which an index prunes folders.
LISTED_KEYS = 200_000

# Tasks of a scan from which on a few of them are run first, for bounds.
SEEDED_TASKS = 64

# Visited buckets that are listed beside a choice of files, to skip rows before
# they reach the scan.
FILTERED_KEYS = 1_000

# Bucket statistics that may be broadcast, in bytes.
CATALOG_BYTES = 64 << 20

# What a row dealt into a grid is; a cell gets them in this order.
_QUERY, _VISIT, _OBJECT = 0, 1, 2

CANDIDATES = "query_id long, bucket_rank long, neighbor_id long, distance double"
_CANDIDATES_ARROW = pa.schema(
    [
        ("query_id", pa.int64()),
        ("bucket_rank", pa.int64()),
        ("neighbor_id", pa.int64()),
        ("distance", pa.float64()),
    ]
)


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def _vectors(column, metric: str) -> np.ndarray:
    matrix = to_matrix(column)
    return unit_rows(matrix) if metric == "cosine" and len(matrix) else matrix


def broadcast_catalog(rows: DataFrame) -> DataFrame:
    """Hint a broadcast for rows with a ``path_key`` if they are small enough."""
    size = rows.agg(F.sum(F.octet_length("path_key") + 64)).first()[0] or 0
    return F.broadcast(rows) if size <= CATALOG_BYTES else rows


def scan_tasks(frame: DataFrame) -> int:
    """How many tasks a frame has that is only read and mapped; costs no job.

    0 for one with a shuffle of its own: running a few of its tasks first would
    run that shuffle twice.
    """
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return 0 if "Exchange" in plan else frame.rdd.getNumPartitions()


class _Part:
    """Queries, the visits of these, and what the best rows are kept for."""

    def __init__(
        self, queries: pa.Table, visits: pa.Table | None, metric: str, per_bucket: bool,
        reach: Sequence[int] | None,
    ):
        self.metric = metric
        self.query_ids = query_ids = queries.column("query_id").to_numpy()
        self.matrix = _vectors(queries.column("v"), metric)
        if visits is None:
            visiting = np.arange(len(query_ids))
            ranks = np.ones(len(query_ids), dtype=np.int64)
            by_bucket = {ROOT_KEY: visiting}
        else:
            wanted = visits.column("query_id").to_numpy()
            order = np.argsort(query_ids, kind="stable")
            at = np.minimum(np.searchsorted(query_ids[order], wanted), max(len(order) - 1, 0))
            # A visit whose query is not among the queries finds nothing.
            known = query_ids[order][at] == wanted if len(order) else np.zeros(len(wanted), bool)
            visits = visits.filter(pa.array(known))
            visiting = order[at[known]] if len(order) else np.zeros(0, np.int64)
            ranks = visits.column("bucket_rank").to_numpy()
            by_bucket = rows_by_key(visits.column("path_key"))
        # A task keeps k rows per group: a query, a visit, or a query and the first
        # of the wanted numbers of buckets that reaches the visit.
        if per_bucket:
            groups, n_groups = np.arange(len(visiting)), len(visiting)
        elif reach is not None:
            numbers = np.array(sorted(set(reach)), dtype=np.int64)
            tag = np.searchsorted(numbers, ranks)
            inside = tag < len(numbers)
            by_bucket = {key: rows[inside[rows]] for key, rows in by_bucket.items()}
            tag = np.minimum(tag, len(numbers) - 1)
            groups, n_groups = visiting * len(numbers) + tag, len(query_ids) * len(numbers)
            ranks = numbers[tag]
        else:
            groups, n_groups = visiting, len(query_ids)
        self.visiting, self.ranks, self.by_bucket = visiting, ranks, by_bucket
        self.groups, self.n_groups = groups, n_groups

    def scan(
        self, batches: Iterator[pa.RecordBatch], k: int, known: np.ndarray | None = None
    ) -> Iterator[pa.RecordBatch]:
        """The best of the objects ``(id, v, path_key)`` that stream by."""
        best = RunningTopK(self.n_groups, k, bounds=known)
        for batch in batches:
            for objects in _slices(batch):
                self._compare(objects, k, best)
                for part in best.settle():
                    yield self._emit(part)
        for part in best.finish():
            yield self._emit(part)

    def _compare(self, objects: pa.RecordBatch, k: int, best: RunningTopK) -> None:
        ids = objects.column("id").to_numpy()
        vectors = _vectors(objects.column("v"), self.metric)
        for key, members in rows_by_key(objects.column("path_key")).items():
            visit = self.by_bucket.get(key)
            if visit is None or not len(visit):
                continue
            rows, neighbor_id, distance = nearest(
                self.matrix[self.visiting[visit]], ids[members], vectors[members], k,
                best.bounds[self.groups[visit]],
            )
            found = visit[rows]
            best.add(
                self.groups[found], neighbor_id, distance, self.visiting[found], self.ranks[found])

    def _emit(self, part) -> pa.RecordBatch:
        _, neighbor_id, distance, query, rank = part
        columns = (self.query_ids[query], rank, neighbor_id, distance)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_CANDIDATES_ARROW)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    values = len(batch.column("v").flatten())
    step = max(1, batch.num_rows * SCAN_VALUES // max(values, SCAN_VALUES))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def _scan_candidates(
    visits: DataFrame | None, queries: DataFrame, objects: DataFrame, k: int, metric: str,
    per_bucket: bool, reach: Sequence[int] | None,
    prune: Callable[[list[str]], DataFrame] | None,
) -> DataFrame:
    """Broadcast the (size-checked) queries and scan the objects in place."""
    spark = objects.sparkSession
    if visits is not None:
        visit_rows = visits.select("query_id", "path_key", "bucket_rank").toArrow()
    part = _Part(
        queries.select("query_id", "v").toArrow(), None if visits is None else visit_rows,
        metric, per_bucket, reach)
    shared = spark.sparkContext.broadcast(part)

    def scan(batches: Iterator[pa.RecordBatch], known: np.ndarray | None):
        return shared.value.scan(batches, k, known)

    objects = objects.select("id", "v", "path_key")
    if visits is not None:
        keys = [key for key, rows in part.by_bucket.items() if len(rows)]
        if prune:  # the scan drops the other objects of the files that are left
            objects = prune(keys).select("id", "v", "path_key")
        if not prune or len(keys) <= FILTERED_KEYS:
            objects = _visited(objects, keys)
    n_tasks = scan_tasks(objects)
    if n_tasks < SEEDED_TASKS:
        return objects.mapInArrow(lambda batches: scan(batches, None), CANDIDATES)

    every = math.isqrt(n_tasks)

    def scan_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the other tasks end without reading their rows
        return scan(batches if TaskContext.get().partitionId() % every == 0 else iter(()), None)

    by = ("query_id", "bucket_rank") if per_bucket or reach is not None else ("query_id",)
    kth = (
        merge_top_k(objects.mapInArrow(scan_some, CANDIDATES), k, *by)
        .filter(F.col("rank") == k).select(*by, "distance").toArrow()  # a row a group
    )
    group_of = {}
    for group, query, rank in zip(
        part.groups.tolist(), part.query_ids[part.visiting].tolist(), part.ranks.tolist()
    ):
        group_of[(query, rank)[: len(by)]] = group
    bounds = np.full(part.n_groups, np.inf)
    keys = zip(*(kth.column(name).to_pylist() for name in by))
    bounds[[group_of[key] for key in keys]] = kth.column("distance").to_numpy()
    seeds = spark.sparkContext.broadcast(bounds)
    return objects.mapInArrow(lambda batches: scan(batches, seeds.value), CANDIDATES)


def _visited(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Only the objects of visited buckets; on an index this prunes folders."""
    if not keys:
        return objects.limit(0)
    if len(keys) <= LISTED_KEYS:
        quoted = ", ".join("'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'" for key in keys)
        return objects.filter(F.expr(f"path_key IN ({quoted})"))
    # The scan drops the others anyway; a join spares it their vectors.
    visited = objects.sparkSession.createDataFrame([(key,) for key in keys], "path_key string")
    return objects.join(broadcast_catalog(visited), "path_key", "left_semi")


def _grid_candidates(
    visits: DataFrame | None, queries: DataFrame, objects: DataFrame, k: int, metric: str,
    per_bucket: bool, reach: Sequence[int] | None,
    prune: Callable[[list[str]], DataFrame] | None, n_queries: int, total: int, n_groups: int,
) -> DataFrame:
    """Every part of the queries meets every slice of the objects in a cell of its own.

    One shuffle deals both; a cell gets its queries and visits first and then
    streams its objects, so it never holds more than its part of the queries.
    ``total`` is the size of queries and visits in bytes.
    """
    objects = objects.select("id", "v", "path_key")
    if visits is not None:
        kept = visits if reach is None else visits.filter(F.col("bucket_rank") <= max(reach))
        wanted = kept.select("path_key").distinct()
        keys = [row["path_key"] for row in wanted.limit(LISTED_KEYS + 1).collect()]
        if len(keys) > LISTED_KEYS:
            objects = objects.join(broadcast_catalog(wanted), "path_key", "left_semi")
        else:
            if prune:
                objects = prune(keys).select("id", "v", "path_key")
            objects = _visited(objects, keys)

    # A row of a query or of its best goes to or comes from each slice, an object
    # goes to each part: the parts that make the fewest rows, if they are small enough.
    cells = min(
        CELLS_PER_CORE * objects.sparkSession.sparkContext.defaultParallelism,
        1 + total // LEAST_CELL_BYTES)
    ratio = (n_queries + n_groups * k) / max(objects.count(), 1)
    n_parts = max(
        -(-(total + n_groups * k * FOUND_BYTES) // CELL_BYTES),
        min(cells, math.ceil(math.sqrt(cells * ratio))))
    n_slices = -(-cells // n_parts)

    vector = queries.schema["v"].dataType
    if vector != objects.schema["v"].dataType:
        vector = T.ArrayType(T.DoubleType())
    part = F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int")
    slice_ = F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("int")

    def rows(frame: DataFrame, kind: int, id_col: str, **columns) -> DataFrame:
        if kind == _OBJECT:
            frame = frame.withColumn("_slice", slice_).withColumn(
                "_part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        else:
            frame = frame.withColumn("_part", part).withColumn(
                "_slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
        return frame.select(
            (F.col("_part") * n_slices + F.col("_slice")).alias("cell"),
            F.lit(kind).alias("kind"), F.col(id_col).cast("long").alias("id"),
            *(columns.get(name, F.lit(None)).cast(kind_of).alias(name)
              for name, kind_of in (("v", vector), ("path_key", "string"), ("bucket_rank", "long"))),
        )

    dealt = rows(queries.select("query_id", "v"), _QUERY, "query_id", v=F.col("v"))
    if visits is not None:
        dealt = dealt.unionByName(rows(
            visits.select("query_id", "bucket_rank", "path_key"), _VISIT, "query_id",
            path_key=F.col("path_key"), bucket_rank=F.col("bucket_rank")))
    dealt = dealt.unionByName(
        rows(objects, _OBJECT, "id", v=F.col("v"), path_key=F.col("path_key")))
    visiting = visits is not None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {_QUERY: [], _VISIT: []}

        def streamed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("kind").to_numpy()
                for kind, rows in held.items():
                    if (kinds == kind).any():
                        rows.append(batch.filter(pa.array(kinds == kind)))
                if (kinds == _OBJECT).any():
                    yield batch.filter(pa.array(kinds == _OBJECT))

        objects = streamed()
        first = next(objects, None)  # by then all queries and visits are held
        if first is None or not held[_QUERY] or (visiting and not held[_VISIT]):
            return
        queries = pa.Table.from_batches(held[_QUERY]).rename_columns({"id": "query_id"})
        visits = None
        if visiting:
            visits = pa.Table.from_batches(held[_VISIT]).rename_columns({"id": "query_id"})
        own = _Part(queries, visits, metric, per_bucket, reach)
        for rows in held.values():
            rows.clear()
        del queries, visits
        yield from own.scan(chain([first], objects), k)

    return (
        dealt.repartitionById(n_parts * n_slices, F.col("cell")).sortWithinPartitions("kind")
        .mapInArrow(search, CANDIDATES)
    )


def bucket_candidates(
    visits: DataFrame | None,
    queries: DataFrame,
    objects: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    per_bucket: bool = False,
    reach: Sequence[int] | None = None,
    broadcast_bytes: int | None = None,
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    prune: Callable[[list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Local winners ``(query_id, bucket_rank, neighbor_id, distance)`` of a search.

    ``visits`` is ``(query_id, bucket_rank, path_key)``, ``queries`` is
    ``(query_id, v)`` and ``objects`` is ``(id, v, path_key)``. Without
    ``visits`` each query visits all objects, under the root key. With
    ``per_bucket`` the k best of every visited bucket are kept; with ``reach``,
    numbers of buckets, the k best of what each number reaches beyond the next
    smaller one, which is then the ``bucket_rank``. The ids of each side must be
    unique. Visits without their query find nothing. ``prune`` gives, for the
    visited keys, a part of ``objects`` that holds all of theirs.

    A query set above ``broadcast_bytes`` is not broadcast but dealt into a grid
    with the objects, and its rows, after ``finish``, are written.
    """
    _check_metric(metric)
    if k < 1:
        raise ValueError("k must be at least 1")
    limit = max(1, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    total = size["n"] * ((size["d"] or 0) * 8 + VISIT_BYTES)
    if visits is not None:
        visits = settle(visits, "visits")
        n_visits = visits.count()
        total += n_visits * VISIT_BYTES
    if total <= limit or size["n"] <= 1:
        return finish(_scan_candidates(visits, queries, objects, k, metric, per_bucket, reach, prune))
    per_query = len(set(reach)) if reach is not None else 1
    groups = n_visits if per_bucket and visits is not None else size["n"] * per_query
    return settle(finish(_grid_candidates(
        visits, queries, objects, k, metric, per_bucket, reach, prune, size["n"], total, groups)),
        "found")


def knn_in_buckets(
    visits: DataFrame | None, queries: DataFrame, objects: DataFrame, k: int = 10, **options
) -> DataFrame:
    """The k nearest objects of each query inside the buckets it visits.

    Fewer than k objects in reach give fewer rows.
    """
    return bucket_candidates(
        visits, queries, objects, k, finish=lambda rows: merge_top_k(rows, k), **options)


def knn_brute_force(
    queries: DataFrame, objects: DataFrame, k: int = 10, metric: str = "cosine", **options
) -> DataFrame:
    """The k nearest of all objects: a search of one bucket that holds them all."""
    everything = objects.withColumn("path_key", F.lit(ROOT_KEY))
    return knn_in_buckets(None, queries, everything, k, metric=metric, **options)


def without_self(found: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of a search for k + 1 among the queries themselves,
    less each query's own row."""
    return merge_top_k(found.filter(F.col("neighbor_id") != F.col("query_id")), k)


def candidate_counts(visits: DataFrame, buckets: DataFrame) -> DataFrame:
    """How many objects each query would compare: ``(query_id, n_candidates)``."""
    sizes = broadcast_catalog(buckets.select("path_key", "n_objects"))
    return (
        visits.join(sizes, "path_key")
        .groupBy("query_id")
        .agg(F.sum("n_objects").alias("n_candidates"))
    )


def knn_sweep(
    visits: DataFrame, queries: DataFrame, objects: DataFrame, n_buckets: Sequence[int],
    k: int = 10, **options,
) -> DataFrame:
    """One search at the largest number of buckets that answers every smaller one.

    Rows are ``(n_buckets, query_id, rank, neighbor_id, distance)``. A task keeps
    k rows for each number and query, of the buckets that number is the first
    to reach; a search is the merge of those of its own and smaller numbers.
    """
    numbers = sorted(set(n_buckets))
    listed = F.array(*[F.lit(n).cast("long") for n in numbers])
    reached = F.filter(listed, lambda n: n >= F.col("bucket_rank"))

    def finish(candidates: DataFrame) -> DataFrame:
        kept = merge_top_k(candidates, k, "bucket_rank", "query_id").drop("rank")
        return merge_top_k(
            kept.withColumn("n_buckets", F.explode(reached)), k, "n_buckets", "query_id")

    return bucket_candidates(visits, queries, objects, k, reach=numbers, finish=finish, **options)
