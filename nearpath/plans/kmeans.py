"""k-means of all nodes of a level at once, on all of their rows.

One pass over the rows is one iteration of every node: tasks send each row to
the nearest centre of its node and hand on one partial sum per node and
cluster; the sums are added up by Spark and give the next centres. The number of
jobs does not depend on the number of nodes, and a node with a third of all
rows is as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearpath.operators.kernel import rows_by_key, to_matrix

SEED = 2023
MAX_ITERATIONS = 25

Centres = dict[str, np.ndarray]

SUMS = "path_key string, cluster int, n long, total array<double>"


def first_centres(rows: DataFrame, asked: dict[str, int], seed: int = SEED) -> Centres:
    """Random rows of each node: those with the smallest hash of their id.

    Equal vectors are one centre, so a node may start with fewer than asked.
    """
    sizes = rows.sparkSession.createDataFrame(list(asked.items()), "path_key string, k int")
    place = Window.partitionBy("path_key").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    chosen = (
        rows.select("id", "path_key").withColumn("_place", F.row_number().over(place))
        .filter(F.col("_place") <= max(asked.values()))
        .join(F.broadcast(sizes), "path_key").filter(F.col("_place") <= F.col("k"))
        .select("id", "_place")
    )
    found = rows.join(F.broadcast(chosen), "id").select("path_key", "_place", "v").toArrow()
    found = found.sort_by([("path_key", "ascending"), ("_place", "ascending")])
    matrix, keys = to_matrix(found.column("v")), rows_by_key(found.column("path_key"))
    out = {}
    for key, members in keys.items():
        own = matrix[members]
        _, first = np.unique(own, axis=0, return_index=True)
        out[key] = own[np.sort(first)]
    return out


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector; equal distances go to the first one."""
    lengths = (centres * centres).sum(axis=1)
    return np.argmin(lengths - 2 * (vectors @ centres.T), axis=1)


def _sums(rows: DataFrame, shared) -> DataFrame:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = to_matrix(batch.column("v"))
            for key, members in rows_by_key(batch.column("path_key")).items():
                centres = shared.value.get(key)
                if centres is None:
                    continue
                own = vectors[members]
                label = nearest_centre(own, centres)
                if key not in sums:
                    sums[key] = (np.zeros(len(centres), np.int64), np.zeros(centres.shape))
                n, total = sums[key]
                n += np.bincount(label, minlength=len(centres))
                order = np.argsort(label, kind="stable")
                heads = np.flatnonzero(np.diff(label[order], prepend=-1))
                total[label[order][heads]] += np.add.reduceat(own[order], heads, axis=0)
        for key, (n, total) in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({
                "path_key": [key] * len(used), "cluster": pa.array(used, pa.int32()),
                "n": n[used], "total": [total[c] for c in used],
            })

    return rows.select("v", "path_key").mapInArrow(add_up, SUMS)


def fit_centres(
    rows: DataFrame, asked: dict[str, int], iterations: int = MAX_ITERATIONS, seed: int = SEED
) -> Centres:
    """Centres of every node of ``rows`` (id, v, path_key) that ``asked`` names.

    Stops before ``iterations`` only when no centre moves any more. Clusters
    that end without rows are left out. The caller checks that all centres
    together may be broadcast.
    """
    asked = {key: k for key, k in asked.items() if k > 0}
    if not asked:
        return {}
    context = rows.sparkSession.sparkContext
    centres = first_centres(rows, asked, seed)
    for _ in range(iterations):
        shared = context.broadcast(centres)
        added = (
            _sums(rows, shared).groupBy("path_key", "cluster")
            .agg(F.sum("n").alias("n"), vector_to_array(
                Summarizer.sum(array_to_vector("total"))).alias("total"))
            .toArrow()
        )
        shared.destroy()
        totals, n = to_matrix(added.column("total")), added.column("n").to_numpy()
        cluster = added.column("cluster").to_numpy()
        moved: Centres = {}
        for key, members in rows_by_key(added.column("path_key")).items():
            members = members[np.argsort(cluster[members])]
            moved[key] = totals[members] / n[members, None]
        same = all(np.array_equal(moved[key], centres[key]) for key in centres)
        centres = moved
        if same:
            break
    return centres


def with_clusters(rows: DataFrame, centres: Centres) -> DataFrame:
    """Adds ``cluster``, the nearest centre of the row's node."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = to_matrix(batch.column("v"))
            out = np.zeros(len(vectors), np.int32)
            for key, members in rows_by_key(batch.column("path_key")).items():
                if key in shared.value:
                    out[members] = nearest_centre(vectors[members], shared.value[key])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out)], names=[*batch.schema.names, "cluster"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(label, f"{kind}, cluster int")
