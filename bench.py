"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query
is the best of two runs after a first one that warms up the session; builds
run once. ``scale`` repeats the search on ``BENCH_COPIES`` copies of the table,
each vector moved by nearly its own length, with one model of the published
shape (120 leaves, one hidden layer of 512) but ``BENCH_EPOCHS`` epochs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from nearpath import fixtures as fx  # noqa: E402
from nearpath.operators.knn import candidate_counts, knn_brute_force, without_self  # noqa: E402
from nearpath.operators.recall import recall_at_k  # noqa: E402
from nearpath.plans.build import build_index  # noqa: E402
from nearpath.plans.config import BuildConfig  # noqa: E402
from nearpath.queries import QUERIES  # noqa: E402
from nearpath.sources.workdir import work_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "100"))
EPOCHS = int(os.environ.get("BENCH_EPOCHS", "10"))
AMPLITUDE = 0.15

HEADLINE = [
    "l2_normalize",
    "knn_brute_cosine",
    "knn_brute_inner_product",
    "knn_brute_grid",
    "predict_proba",
    "nav_order_two_level",
    "nav_order_three_level",
    "bucket_candidates",
    "knn_bucketed",
    "knn_bucketed_grid",
    "knn_two_space",
    "recall_at_k",
    "recall_sweep",
]


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.time()
    action()
    return round(time.time() - started, 3)


def scale_run(spark: SparkSession) -> dict:
    """Build, search and recall on a larger table: one model with 120 leaves, of
    which 4 are visited."""
    folder = work_dir(spark, "bench-vectors")
    fx.perturbed_copies(spark, SF_DIR, COPIES, int(CPUS) * 2, AMPLITUDE).write.parquet(folder)
    objects = spark.read.parquet(folder)
    queries = fx.as_queries(fx.objects(spark, SF_DIR))
    n_objects, n_queries = objects.count(), queries.count()
    truth_folder = work_dir(spark, "bench-truth")
    brute = timed(lambda: knn_brute_force(queries, objects).write.parquet(truth_folder))
    built = {}

    def build():
        built["index"] = build_index(
            objects, BuildConfig("faiss_kmeans", EPOCHS, "MLP-4", 0.01, [120])
        )

    build_s = timed(build)
    index = built["index"]
    run(index.search(queries, 4))
    search = min(timed(lambda: run(index.search(queries, 4))) for _ in range(2))
    recall = recall_at_k(index.search(queries, 4), spark.read.parquet(truth_folder)).first()
    compared = candidate_counts(index.bucket_order(queries, 4), index.buckets).agg(
        F.sum("n_candidates")).first()[0]
    return {
        "n_objects": n_objects,
        "n_queries": n_queries,
        "brute_force_s": brute,
        "build_s": build_s,
        "build_vectors_per_s": round(n_objects / build_s),
        "search_4_of_120_s": search,
        "search_queries_per_s": round(n_queries / search),
        "search_compared_per_s": round(compared / search),
        "brute_compared_per_s": round(n_objects * n_queries / brute),
        "recall_4_of_120": round(recall["recall"], 4),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("nearpath-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # a local session; on a cluster the folder is a shared one
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="nearpath-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        query = QUERIES[name].run
        run(query(spark, SF_DIR))
        times[name] = min(timed(lambda: run(query(spark, SF_DIR))) for _ in range(2))

    objects = fx.objects(spark, SF_DIR)
    queries = fx.as_queries(objects)
    built = {}

    def build():
        built["index"] = build_index(
            objects, BuildConfig("scikit_kmeans", 100, "MLP", 0.01, [10, 10])
        )

    times["index_build"] = timed(build)
    index = built["index"]
    run(index.search(queries, 10))
    times["learned_search"] = min(timed(lambda: run(index.search(queries, 10))) for _ in range(2))
    found = without_self(index.search(queries, 10, 11), 10)
    recall = recall_at_k(found, without_self(knn_brute_force(queries, objects, 11), 10)).first()
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")),
        "recall_10_of_100_buckets_without_self": round(recall["recall"], 4),
    }
    if COPIES > 0:
        result["scale"] = scale_run(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
