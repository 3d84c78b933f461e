"""Centroid clustering by the threshold algorithm, in whole numbers.

A vector counts when it has ``dimension`` components, none null, NaN or
infinite; its components become ``floor(scale * x)``. Clustering is then exact:
sums and squared distances are integers, and ties go to the smaller number.

To find the nearest centroid, each dimension has the list of all centroids by
their value there. The walk starts at the vector's own value in each list and
goes outward, one centroid a list at a time; a centroid met for the first time
gets its exact distance. Whatever no list has shown yet is, in each dimension,
at least as far as that list's frontier, so the walk stops when the squared
frontier distances add up to strictly more than the best exact distance.

A round is one scan of the vectors: tasks add up their clusters, and only
``k * dimension`` sums and counts, whatever the size of the table, come to the
driver. Vectors are written once, as integers, and not shuffled.

A row without an id is clustered like others but never starts a centroid. Equal
rows are vectors of their own. With fewer vectors than ``k`` there are as many
centroids as vectors; a table without vectors gives no rows. Components of
131072 and more are an error: their squared distances do not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpath.sources.workdir import discard, settle, settle_in

K = 8
ROUNDS = 10
DIMENSION = 64
SCALE = 1024
SEED = 3
#: Vectors times centroids (or components) that a task holds at once.
CELLS = 1 << 20

SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()),
                  ("n", pa.int64())])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


class CentroidLists:
    """Centroids, and for each dimension their numbers and values by value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.number = np.argsort(centroids, axis=0, kind="stable")
        self.value = np.take_along_axis(centroids, self.number, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector,
        and how many exact distances that took."""
        k, dimension = self.centroids.shape
        step = max(1, CELLS // max(k, dimension))
        parts = [self._walk(vectors[a:a + step]) for a in range(0, len(vectors), step)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), 0
        cluster, distance, evaluated = zip(*parts)
        return np.concatenate(cluster), np.concatenate(distance), sum(evaluated)

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        k, dimension = self.centroids.shape
        n, far = len(vectors), np.int64(1) << 40
        right = np.stack([
            np.searchsorted(self.value[:, d], vectors[:, d]) for d in range(dimension)], axis=1)
        left = right - 1
        best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        seen = np.zeros((n, k), bool)
        walking, evaluated, dims = np.arange(n), 0, np.arange(dimension)[None, :]
        for _ in range(k):
            x, low, high = vectors[walking], left[walking], right[walking]
            below = np.where(low >= 0, x - self.value[np.maximum(low, 0), dims], far)
            above = np.where(high < k, self.value[np.minimum(high, k - 1), dims] - x, far)
            down = below <= above
            met = np.zeros((len(walking), k), bool)
            met[np.arange(len(walking))[:, None],
                self.number[np.where(down, low, high), dims]] = True
            met &= ~seen[walking]
            seen[walking] |= met
            rows, numbers = np.nonzero(met)
            exact = self._distances(x, rows, numbers)
            evaluated += len(rows)
            # numbers ascend within a row: of equal distances the first stays
            order = np.lexsort((numbers, exact, rows))
            first = order[np.append(True, np.diff(rows[order]) != 0)[: len(order)]]
            row, distance, number = walking[rows[first]], exact[first], numbers[first]
            better = (distance < best[row]) | ((distance == best[row]) & (number < cluster[row]))
            best[row[better]], cluster[row[better]] = distance[better], number[better]
            left[walking] = low - down
            right[walking] = high + ~down
            frontier = np.minimum(below, above)
            walking = walking[(frontier * frontier).sum(axis=1) <= best[walking]]
            if not len(walking):
                break
        return cluster.astype(np.int32), best, evaluated

    def _distances(self, x: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(rows), np.int64), max(1, CELLS // x.shape[1])
        for a in range(0, len(rows), step):
            apart = x[rows[a:a + step]] - self.centroids[numbers[a:a + step]]
            out[a:a + step] = (apart * apart).sum(axis=1)
        return out


def whole_vectors(
    rows: DataFrame, dimension: int, scale: int, id_col: str, vector_col: str
) -> DataFrame:
    """``(vec_id, v)`` of the rows that count, their components as integers."""
    limit = (1 << 27) / scale
    v = F.col(f"`{vector_col}`").cast("array<double>")

    def whole(x: Column) -> Column:
        too_large = F.raise_error(F.lit(f"a component is {limit:g} or more, or -{limit:g} or less"))
        return F.when(F.abs(x) < limit, F.floor(x * scale).cast("int")).otherwise(
            too_large.cast("int"))

    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("x"))
        .where((F.size("x") == dimension) & finite)
        .select("vec_id", F.transform("x", whole).alias("v"))
    )


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors whose hashed ids are smallest, in that order; ties by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = (
        vectors.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "v")
        .orderBy("key", "v").limit(k)
    )
    return [row["v"] for row in chosen.collect()]


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then each centroid that
    has vectors to the floor of their mean."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, dimension = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, totals, n = CentroidLists(shared.value), np.zeros((k, dimension), np.int64), 0
        counts = np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch)
            cluster, _, _ = lists.nearest(own)
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            held, first = np.unique(cluster[order], return_index=True)
            totals[held] += np.add.reduceat(own[order], first, axis=0)
            n += len(own)
            if n >= 1 << 34:  # sums stay far inside a long
                yield sums(totals, counts)
                totals[:], counts[:], n = 0, 0, 0
        yield sums(totals, counts)

    def sums(totals: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        held = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(held, dimension), pa.int32()),
            pa.array(np.tile(np.arange(dimension), len(held)), pa.int32()),
            pa.array(totals[held].ravel(), pa.int64()),
            pa.array(np.repeat(counts[held], dimension), pa.int64()),
        ], schema=SUMS)

    moved = (
        vectors.select("v").mapInArrow(add_up, "cluster int, place int, total long, n long")
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    )
    out = centroids.copy()
    for row in moved.collect():  # k * dimension rows
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    shared.destroy()
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = CentroidLists(centroids)
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _ = lists.nearest(matrix(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(cluster), pa.array(distance)], schema=ASSIGNED)

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def centroid_clusters(
    rows: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    dimension: int = DIMENSION,
    scale: int = SCALE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Each vector's cluster, distance and the sums of distances
    (``cluster_inertia``, ``inertia``), and the final centroids."""
    spark = rows.sparkSession
    vectors, folder = settle_in(
        whole_vectors(rows, dimension, scale, id_col, vector_col), "whole-vectors")
    centroids = np.array(starts(vectors, k, seed), np.int64).reshape(-1, dimension)
    if not len(centroids):
        empty = spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long")
        return empty, centroids
    for _ in range(rounds):
        moved = next_centroids(vectors, centroids)
        if (moved == centroids).all():
            break  # every further round would be the same
        centroids = moved
    assigned = settle(assign(vectors, centroids), "clusters")
    discard(spark, folder)
    inertia = {
        row["cluster"]: row["s"]
        for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    }
    sums = spark.createDataFrame(
        [(c, s, sum(inertia.values())) for c, s in inertia.items()],
        "cluster int, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(sums), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    """SHA-256 of each centroid's components, as decimals joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
