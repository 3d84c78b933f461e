"""Running an experiment: build, search, compare, and record the run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.functions.vectors import l2_normalize
from nearpath.operators.knn import knn_brute_force
from nearpath.operators.recall import recall_sweep
from nearpath.plans.build import build_index
from nearpath.plans.config import BuildConfig
from nearpath.sources.results import append_runs, write_neighbors, write_neighbors_of_runs
from nearpath.sources.workdir import settle

INDEX_TYPES = ("baseline", "learned-index")


@dataclass
class ExperimentConfig:
    """One experiment. ``metric_search`` compares with the search representation."""

    build: BuildConfig
    index_type: str = "learned-index"
    k: int = 10
    n_buckets_perc: Sequence[float] = (10,)
    n_buckets: Sequence[int] = ()
    normalize: bool = True
    metric_search: str = "inner_product"
    score: str = "conditional"
    data: str = ""
    size: str = ""
    save: bool = True

    def __post_init__(self):
        if self.index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {self.index_type!r}, expected one of {INDEX_TYPES}")


def buckets_to_visit(
    percentages: Sequence[float], n_buckets_in_index: int, numbers: Sequence[int] = ()
) -> list[int]:
    """Numbers of buckets for shares of the index, without zeros and repeats."""
    wanted = {int(p / 100 * n_buckets_in_index) for p in percentages} | set(numbers)
    return sorted(n for n in wanted if n > 0)


def normalized(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("v", l2_normalize("v"))


def run_experiment(
    objects: DataFrame,
    queries: DataFrame,
    config: ExperimentConfig,
    folder: str,
    objects_search: DataFrame | None = None,
    queries_search: DataFrame | None = None,
    truth: DataFrame | None = None,
) -> DataFrame:
    """Run one experiment and store its neighbours and run rows below ``folder``.

    ``objects`` is (id, v) and ``queries`` is (query_id, v). Without ``truth``
    the recall is measured against a brute-force search. Returns the run rows,
    one per number of buckets. Only one search is made for all of them: it
    navigates once, and each number reuses the candidates within its reach. Its
    seconds are the ``sweep_s`` of every run; ``query_s`` stays empty.
    """
    spark = objects.sparkSession
    if (objects_search is None) != (queries_search is None):
        raise ValueError("give the search representation of both objects and queries")
    if config.normalize:
        objects, queries = normalized(objects), normalized(queries)
    compared = objects if objects_search is None else objects_search
    comparing = queries if queries_search is None else queries_search
    base = {
        "algo": config.index_type,
        "data": config.data,
        "size": config.size,
        "normalized": config.normalize,
        "k": config.k,
    }

    if config.index_type == "baseline":
        run_id = uuid.uuid4().hex
        started = time.time()
        found = knn_brute_force(comparing, compared, config.k, metric="cosine")
        found = write_neighbors(found, folder, run_id)
        query_s = time.time() - started
        recall = None
        if truth is not None:
            everything = found.withColumn("n_buckets", F.lit(1).cast("long"))
            recall = recall_sweep(everything, truth, [1], config.k).first()["recall"]
        run = {**base, "run_id": run_id, "metric": "cosine", "build_s": 0.0, "cluster_s": 0.0,
               "query_s": query_s, "recall": recall}
        return append_runs(spark, folder, [run])

    target = f"{folder}/index-{uuid.uuid4().hex}" if config.save else None
    index = build_index(objects, config.build, target, search_objects=objects_search)
    meta = index.meta
    numbers = buckets_to_visit(config.n_buckets_perc, meta["n_buckets"], config.n_buckets)
    if not numbers:
        raise ValueError("the shares asked for are less than one bucket")
    if truth is None:
        truth = settle(
            knn_brute_force(comparing, compared, config.k, metric=config.metric_search), "truth"
        )

    started = time.time()
    found = settle(
        index.sweep(
            queries, numbers, config.k, queries_search=comparing,
            metric=config.metric_search, score=config.score,
        ),
        "found",
    )
    sweep_s = time.time() - started
    recalls = {
        row["n_buckets"]: row["recall"]
        for row in recall_sweep(found, truth, numbers, config.k).collect()
    }
    run_ids = {n: uuid.uuid4().hex for n in numbers}
    named = F.create_map(*[F.lit(x) for pair in run_ids.items() for x in pair])
    write_neighbors_of_runs(
        found.withColumn("run_id", F.element_at(named, F.col("n_buckets").cast("int"))), folder)
    build = config.build
    return append_runs(spark, folder, [
        {
            **base,
            "run_id": run_ids[n],
            "clustering_algorithms": build.clustering_names,
            "n_categories": build.n_categories,
            "model_types": build.model_types,
            "epochs": build.epochs,
            "lrs": [float(lr) for lr in build.lrs],
            "solver": build.solver,
            "train_rows": build.train_rows,
            "seed": build.seed,
            "metric": config.metric_search,
            "score": config.score,
            "n_buckets": n,
            "build_s": meta["build_s"],
            "cluster_s": meta["cluster_s"],
            "sweep_s": sweep_s,
            "recall": recalls.get(n),
        }
        for n in numbers
    ])
