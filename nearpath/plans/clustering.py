"""Clustering algorithms by name. A user may register more."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.clustering import KMeans

from nearpath.plans.kmeans import MAX_ITERATIONS, SEED

LABEL = "cluster"


@dataclass(frozen=True)
class ClusteringAlgorithm:
    """How the rows of a node are clustered.

    By default it is the k-means that fits all nodes of a level at once, on all
    their rows. ``label(matrix, k)`` gives the cluster, 0 to k - 1, of every row
    of a matrix instead; it runs inside grouped tasks, one group a node, all nodes
    of a level in one job, on the node's training rows (all of them, or about
    ``train_rows`` of a larger node). ``make(k)`` gives an estimator from column
    ``features`` to column ``cluster``, which is fitted on all rows node by node:
    for few nodes.
    """

    make: Callable[[int], Estimator] | None = None
    iterations: int = MAX_ITERATIONS
    label: Callable[[np.ndarray, int], np.ndarray] | None = None


def k_means(k: int) -> KMeans:
    """An estimator for ``make``."""
    return KMeans(
        k=k, initMode="random", maxIter=MAX_ITERATIONS, seed=SEED,
        featuresCol="features", predictionCol=LABEL,
    )


# The names a configuration may use. Both are k-means from random
# rows with 25 iterations.
ALGORITHMS: dict[str, ClusteringAlgorithm] = {
    "faiss_kmeans": ClusteringAlgorithm(),
    "scikit_kmeans": ClusteringAlgorithm(),
}


def clustering_algorithm(choice: str | ClusteringAlgorithm) -> ClusteringAlgorithm:
    if isinstance(choice, ClusteringAlgorithm):
        return choice
    if choice not in ALGORITHMS:
        raise ValueError(f"unknown clustering algorithm {choice!r}, expected one of {list(ALGORITHMS)}")
    return ALGORITHMS[choice]
