"""Building, storing, searching and measuring a trained index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpath import fixtures as fx
from nearpath.functions.paths import path_key
from nearpath.operators.knn import knn_brute_force, knn_in_buckets
from nearpath.operators.kernel import forward
from nearpath.operators.score import NODE_SCHEMA, assign_paths
from nearpath.plans import models
from nearpath.plans.build import _training_rows, build_index, cluster_level, node_sizes
from nearpath.plans.clustering import ALGORITHMS, ClusteringAlgorithm, k_means
from nearpath.plans.config import BuildConfig
from nearpath.plans.experiment import ExperimentConfig, buckets_to_visit, run_experiment
from nearpath.plans.index import (
    FileRanges, Index, bucket_catalog, load_index, node_catalog, store_objects,
)
from nearpath.plans.kmeans import fit_centres
from nearpath.plans.models import Node
from nearpath.sources.results import read_neighbors, read_runs
from nearpath.sources.workdir import work_dir


def rows(result):
    return sorted(
        (r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in result.collect()
    )


@pytest.fixture(scope="module")
def objects(spark, sf_dir):
    return fx.objects(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def queries(objects):
    return fx.as_queries(objects)


@pytest.fixture(scope="module")
def index(objects):
    return build_index(objects, BuildConfig("scikit_kmeans", 40, "MLP-6", 0.01, [5, 3]))


@pytest.fixture(scope="module")
def truth(objects, queries):
    return knn_brute_force(queries, objects).persist()


def test_every_object_has_one_full_path(index, objects):
    placed = index.assignments
    assert placed.count() == placed.select("id").distinct().count() == objects.count()
    assert placed.filter(F.size("path") != 2).count() == 0
    assert index.buckets.agg(F.sum("n_objects")).first()[0] == objects.count()
    assert index.meta["n_objects"] == objects.count()
    assert node_catalog(placed, 1).agg(F.sum("n_objects")).first()[0] == objects.count()


def test_nodes_cover_the_tree(index):
    nodes = {r["path_key"]: r for r in index.nodes.collect()}
    assert nodes["b"]["level"] == 0
    inner = {r["path_key"] for r in node_catalog(index.assignments, 1).collect()}
    assert set(nodes) == {"b"} | inner


def test_all_buckets_is_exact(index, queries, truth):
    assert rows(index.search(queries, index.n_buckets)) == rows(truth)
    assert rows(index.search(queries, 10_000)) == rows(truth)
    assert rows(index.search(queries, 10_000, broadcast_bytes=60_000)) == rows(truth)


@pytest.mark.parametrize("k", [3, 25])
def test_k_is_honoured(index, queries, objects, k):
    found = index.search(queries, index.n_buckets, k)
    assert rows(found) == rows(knn_brute_force(queries, objects, k))


def test_recall_grows_with_buckets(index, queries, truth):
    numbers = list(range(1, index.n_buckets + 1))
    found = index.sweep(queries, numbers).persist()
    for n in (1, 4):
        single = found.filter(F.col("n_buckets") == n)
        assert rows(single) == rows(index.search(queries, n))
    from nearpath.operators.recall import recall_sweep

    recalls = [
        r["recall"] for r in recall_sweep(found, truth, numbers).orderBy("n_buckets").collect()
    ]
    assert recalls == sorted(recalls)
    assert recalls[0] < 1 and recalls[-1] == 1
    # Far better than the share of the objects that was compared.
    assert recalls[len(recalls) // 4] > 0.4


def test_search_is_exact_inside_the_visited_buckets(index, queries, objects):
    found = {}
    for q, rank, neighbor, distance in rows(index.search(queries, 3, 4)):
        found.setdefault(q, []).append((distance, neighbor))
    bucket = {r["id"]: r["path_key"] for r in index.assignments.collect()}
    reach = {}
    for r in index.bucket_order(queries, 3).collect():
        reach.setdefault(r["query_id"], set()).add(r["path_key"])
    vectors = {r["id"]: np.array(r["v"], dtype=float) for r in objects.collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    for q, x in unit.items():
        inside = [i for i in unit if bucket[i] in reach[q]]
        distances = 1 - np.array([(x * unit[i]).sum() for i in inside])
        wanted = sorted(zip(distances.tolist(), inside))[:4]
        assert [i for _, i in found[q]] == [i for _, i in wanted]
        assert np.allclose([d for d, _ in found[q]], [d for d, _ in wanted], atol=1e-12)


def test_save_and_load(index, queries, spark):
    folder = work_dir(spark, "saved")
    index.save(folder)
    again = load_index(spark, folder)
    assert again.meta == index.meta
    assert rows(again.search(queries, 3)) == rows(index.search(queries, 3))


def test_visited_buckets_prune_files(index, queries, monkeypatch):
    """A search reads only files that hold a visited bucket."""
    read = []
    plain = Index.objects_of
    monkeypatch.setattr(Index, "objects_of", lambda self, keys: read.append(plain(self, keys)) or read[-1])
    one = queries.filter("query_id = 7")
    key = index.bucket_order(one, 1).first()["path_key"]
    found = index.search(one, 1)
    assert {r["neighbor_id"] for r in found.collect()} <= {
        r["id"] for r in index.objects.filter(F.col("path_key") == key).collect()}
    files = {f.rsplit("/", 1)[1] for f in read[0].inputFiles()}
    assert 0 < len(files) < len(index.files.files)
    held = {r["f"] for r in index.objects.filter(F.col("path_key") == key).select(
        F.col("_metadata.file_name").alias("f")).distinct().collect()}
    assert held <= files


def test_files_are_even_and_a_hot_bucket_has_many(spark, monkeypatch):
    """A third of all rows in one bucket, and thousands of small buckets in few files."""
    monkeypatch.setattr("nearpath.plans.index.TASK_BYTES", 72 * 300)
    rows = spark.range(9000).select(
        "id", F.array(F.col("id").cast("double")).alias("v"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(5), F.lit(5))).otherwise(
            F.array((F.col("id") % 10).cast("int"), (F.col("id") % 1000).cast("int"))).alias("path"),
    ).withColumn("path_key", path_key("path"))
    folder = work_dir(spark, "even")
    assert store_objects(rows, bucket_catalog(rows), folder) == 9000
    files = spark.read.parquet(f"{folder}/files").collect()
    assert len(files) == 30
    assert max(f["n_objects"] for f in files) < 2 * 300
    ranges = FileRanges(files)
    assert len(ranges.holding([[5, 5]])) >= 9
    assert 1 <= len(ranges.holding([[0, 10]])) <= 2
    everything = spark.read.parquet(f"{folder}/objects")
    for path in ([5, 5], [0, 10], [9, 999], [5, 4], [7, 77]):
        names = ranges.holding([path])
        held = everything.where(F.col("path") == F.array(*map(F.lit, path))).select(
            F.col("_metadata.file_name")).distinct().collect()
        assert {r[0] for r in held} <= set(names)


def test_a_million_buckets_still_prune():
    """300,000 visited buckets choose the files they are in, and need no folders."""
    rows = [{"file": f"f{i}", "first_path": [i, 0], "last_path": [i, 999], "n_objects": 1}
            for i in range(1000)]
    ranges = FileRanges(rows)
    chosen = ranges.holding([a, b] for a in range(300) for b in range(1000))
    assert chosen == [f"f{i}" for i in range(300)]
    hot = FileRanges([{"file": f"h{i}", "first_path": [1] if i else [0], "last_path": [1], "n_objects": 1}
                      for i in range(5)])
    assert len(hot.holding([[1]])) == 5 and hot.holding([[0]]) == ["h0"] and not hot.holding([[2]])


@pytest.mark.parametrize("extra, message", [
    ("objects", "1 ids are only in objects and 0 only in search_objects"),
    ("search", "0 ids are only in objects and 1 only in search_objects")])
def test_an_id_of_one_space_only_is_an_error(spark, objects, extra, message):
    more = objects.unionByName(objects.limit(1).withColumn("id", F.lit(999_999).cast("long")))
    config = BuildConfig("scikit_kmeans", 3, "MLP-6", 0.01, [3])
    sides = (more, objects) if extra == "objects" else (objects, more)
    with pytest.raises(ValueError, match=message):
        build_index(sides[0], config, search_objects=sides[1])
    built = build_index(sides[0], config, search_objects=sides[1], allow_unmatched=True)
    assert built.objects.count() == objects.count()


def test_many_visited_buckets_prune_folders(spark, capsys):
    """More than two thousand buckets are still a filter on folders."""
    folder = work_dir(spark, "many")
    spark.range(4).selectExpr(
        "id", "array(1D, CAST(id AS DOUBLE)) AS v", "concat('b', id) AS path_key"
    ).write.partitionBy("path_key").parquet(folder)
    objects = spark.read.schema("id long, v array<double>, path_key string").parquet(folder)
    queries = spark.range(2501).selectExpr("id AS query_id", "array(1D, 2D) AS v")
    visits = queries.selectExpr("query_id", "1L AS bucket_rank", "concat('b', query_id + 2) AS path_key")
    found = knn_in_buckets(visits, queries, objects, 1)
    found.explain()
    filters = capsys.readouterr().out.split("PartitionFilters:")[1].split("\n")[0]
    assert "path_key" in filters and ("IN (" in filters or "INSET" in filters)
    assert sorted(r["neighbor_id"] for r in found.collect()) == [2, 3]


def test_single_level_and_logistic(spark, objects, queries, truth):
    index = build_index(objects, BuildConfig("faiss_kmeans", 30, "logistic", 0.01, [6]))
    assert index.n_buckets <= 6
    assert {r["kind"] for r in index.nodes.collect()} <= {"logistic", "constant"}
    assert rows(index.search(queries, index.n_buckets)) == rows(truth)


def test_small_and_equal_nodes(spark):
    """Copies, a single object, and fewer objects than classes."""
    rng = np.random.default_rng(4)
    matrix = np.concatenate([np.tile([1.0, 0, 0], (40, 1)), rng.normal(size=(6, 3)) - 5, [[0, 9, 0]]])
    objects = spark.createDataFrame(
        [(i, x.tolist()) for i, x in enumerate(matrix)], "id long, v array<double>"
    )
    index = build_index(objects, BuildConfig("scikit_kmeans", 30, "MLP-8", 0.01, [3, 4, 2]))
    assert index.assignments.filter(F.size("path") != 3).count() == 0
    assert index.meta["n_objects"] == len(matrix)
    kinds = [r["kind"] for r in index.nodes.collect()]
    assert "constant" in kinds
    queries = fx.as_queries(objects)
    assert rows(index.search(queries, 100, 5, metric="inner_product")) == rows(
        knn_brute_force(queries, objects, 5, "inner_product")
    )


def test_clusters_come_from_all_rows(spark, objects):
    """However few rows the classifier gets, the clusters are those of all rows."""
    rows = objects.withColumn("path_key", F.lit("b"))
    whole = fit_centres(rows, {"b": 4})["b"]
    x = np.array([r["v"] for r in objects.orderBy("id").collect()], dtype=float)
    label = ((x[:, None] - whole[None]) ** 2).sum(axis=2).argmin(axis=1)
    few = BuildConfig("scikit_kmeans", 3, "MLP-8", 0.01, [4], train_rows=40)
    sizes = node_sizes(rows.withColumn("path", F.expr("cast(array() as array<int>)")), 4)
    sample = _training_rows(rows, sizes, 40)
    got = cluster_level(rows, sample, {"b": 4}, few.levels[0], few.seed).collect()
    assert 0 < len(got) < 100
    assert all(label[r["id"]] == r["cluster"] for r in got)


def test_centres_are_means_of_their_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    keys = [f"b{i % 3}" for i in range(300)]
    rows = spark.createDataFrame(
        [(i, x[i].tolist(), keys[i]) for i in range(300)], "id long, v array<double>, path_key string"
    ).repartition(5)
    centres = fit_centres(rows, {"b0": 4, "b1": 1, "b2": 7}, iterations=200)
    assert {k: len(c) for k, c in centres.items()} == {"b0": 4, "b1": 1, "b2": 7}
    for key, c in centres.items():
        own = x[[k == key for k in keys]]
        label = ((own[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.allclose(c, [own[label == j].mean(axis=0) for j in range(len(c))])


def test_batches_of_nodes_give_the_same_index(objects, index, monkeypatch):
    monkeypatch.setattr("nearpath.plans.build.BATCH_BYTES", 1)
    again = build_index(objects, BuildConfig("scikit_kmeans", 40, "MLP-6", 0.01, [5, 3]))
    key = lambda i: sorted((r["id"], r["path_key"]) for r in i.assignments.collect())
    assert key(again) == key(index)


def test_jobs_do_not_grow_with_nodes(spark, objects):
    counts = []
    for fan in ([2, 2], [9, 2]):
        group = f"build-{fan}"
        spark.sparkContext.setJobGroup(group, group)
        build_index(objects, BuildConfig(ClusteringAlgorithm(iterations=2), 1, "logistic", 0.1, fan))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 3


def test_missing_classes_are_an_error(objects, monkeypatch):
    monkeypatch.setattr("nearpath.plans.build._fit_nodes", lambda labelled, *_: labelled.sparkSession.createDataFrame(
        [Node((), "logistic", [64, 2], [0.0] * 130, 1).row()], NODE_SCHEMA))
    with pytest.raises(RuntimeError, match="do not predict"):
        build_index(objects, BuildConfig("scikit_kmeans", 1, "logistic", 0.1, [2]))
    allowed = build_index(objects, BuildConfig("scikit_kmeans", 1, "logistic", 0.1, [2], allow_missing=True))
    assert allowed.nodes.first()["n_predicted"] == 1


def test_training_sample_still_places_every_object(objects, queries, truth):
    config = BuildConfig("scikit_kmeans", 20, "MLP-7", 0.01, [4, 2], train_rows=60)
    index = build_index(objects, config)
    assert index.meta["n_objects"] == objects.count()
    assert rows(index.search(queries, 100)) == rows(truth)


def test_two_representations(spark, sf_dir):
    reduced, full = fx.folded_objects(spark, sf_dir), fx.scaled_objects(spark, sf_dir)
    index = build_index(
        reduced, BuildConfig("scikit_kmeans", 20, "MLP-7", 0.01, [4]), search_objects=full
    )
    assert index.objects.select(F.size("v").alias("d")).distinct().collect() == [(64,)]
    found = index.search(
        fx.as_queries(reduced), 100, queries_search=fx.as_queries(full), metric="inner_product"
    )
    assert rows(found) == rows(
        knn_brute_force(fx.as_queries(full), full, metric="inner_product")
    )


def test_no_objects(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    with pytest.raises(ValueError, match="no objects"):
        build_index(empty, BuildConfig("scikit_kmeans", 5, "MLP", 0.1, [2]))


# --- configuration -------------------------------------------------------------


def test_single_values_stand_for_every_level():
    single = BuildConfig("scikit_kmeans", 7, "MLP-2", 0.5, [4, 3, 2])
    short = BuildConfig(["scikit_kmeans"], [7], ["MLP-2"], [0.5], [4, 3, 2])
    assert single.levels == short.levels
    assert [level.n_categories for level in single.levels] == [4, 3, 2]


def test_levels_keep_their_own_values():
    config = BuildConfig(
        ["scikit_kmeans", "faiss_kmeans", "scikit_kmeans"], [1, 2, 3], ["MLP", "logistic", "MLP-9"],
        [0.1, 0.2, 0.3], [4, 3, 2])
    assert [level.epochs for level in config.levels] == [1, 2, 3]
    assert [level.model_type for level in config.levels] == ["MLP", "logistic", "MLP-9"]
    assert [level.lr for level in config.levels] == [0.1, 0.2, 0.3]


@pytest.mark.parametrize("changed, message", [
    ({"n_categories": []}, "one or more"),
    ({"n_categories": [3, 0]}, "one or more"),
    ({"epochs": [5, 5]}, "mixed"),
    ({"clustering_algorithms": ["scikit_kmeans"], "epochs": [1, 2, 3], "model_types": ["MLP"],
      "lrs": [0.1]}, "3 values for 2 levels"),
    ({"model_types": "MLP-10"}, "not supported"),
    ({"clustering_algorithms": "density"}, "unknown clustering"),
    ({"solver": "l-bfgs"}, "unknown solver"),
    ({"train_rows": 3}, "train_rows"),
    ({"train_rows": None, "clustering_algorithms": ClusteringAlgorithm(label=lambda x, k: None)},
     "clustering of all rows"),
])
def test_bad_configurations(changed, message):
    good = {"clustering_algorithms": "scikit_kmeans", "epochs": 5, "model_types": "MLP", "lrs": 0.1,
            "n_categories": [2, 2]}
    BuildConfig(**good)
    with pytest.raises(ValueError, match=message):
        BuildConfig(**{**good, **changed})


def test_presets_and_registration(monkeypatch):
    assert models.hidden_layers("MLP-5") == [256, 128]
    assert len([name for name in models.HIDDEN_LAYERS if name.startswith("MLP")]) == 9
    monkeypatch.setitem(models.HIDDEN_LAYERS, "mine", [5])
    monkeypatch.setitem(ALGORITHMS, "halves", ClusteringAlgorithm(lambda k: k_means(2)))
    config = BuildConfig("halves", 5, "mine", 0.1, [4])
    assert config.levels[0].model_type == "mine"


def test_registered_clustering_decides_the_classes(objects):
    halves = ClusteringAlgorithm(lambda k: k_means(2))
    index = build_index(objects, BuildConfig(halves, 20, "MLP-8", 0.1, [4]))
    assert index.nodes.first()["n_classes"] == 2


def test_cluster_numbers_for_small_nodes():
    assert [models.n_clusters_for(n, 10) for n in (0, 1, 2, 9, 10, 500)] == [1, 1, 2, 2, 10, 10]
    assert models.n_clusters_for(30, 40) == 6


@pytest.fixture(scope="module")
def two_clouds():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    return rng.normal(size=(400, 4)) + 0.4 * y[:, None], y


@pytest.mark.parametrize("model", ["logistic", "MLP-8"])
def test_class_weights(two_clouds, model):
    x, y = two_clouds
    parameters = BuildConfig("scikit_kmeans", 30, model, 0.02, [2]).levels[0]
    share = []
    for weights in (None, {1: 3.0}):
        node = models.fit_node((), x, y, 2, parameters, weights)
        share.append((forward(node.layers, np.array(node.weights), x).argmax(axis=1) == 1).mean())
    assert share[1] > share[0] + 0.1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    x, y, importance = rng.normal(size=(7, 3)), rng.integers(0, 4, 7), rng.random(7) + 0.5
    layers = [3, 5, 6, 4]
    weights = models.first_weights(layers, rng)

    def loss():
        p = forward(layers, models.flattened(weights), x)[np.arange(7), y]
        return -(np.log(p) * importance).sum() / importance.sum()

    for w, grad in zip(weights, models._gradients(weights, x, y, importance)):
        at = (0,) * w.ndim
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(grad[at], abs=1e-6)


@pytest.mark.parametrize("solver", ["adam", "gd"])
def test_more_epochs_fit_better(two_clouds, solver):
    x, y = two_clouds
    right = []
    for epochs in (1, 60):
        parameters = BuildConfig("scikit_kmeans", epochs, "logistic", 0.05, [2], solver=solver).levels[0]
        node = models.fit_node((), x, y, 2, parameters)
        right.append((forward(node.layers, np.array(node.weights), x).argmax(axis=1) == y).mean())
    assert right[1] >= right[0] and right[1] > 0.6


def test_rare_classes_are_predicted():
    """Where training forgets a class, the nearest centre decides."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    x[0] += 9
    y = np.append(1, np.zeros(599, np.int64))
    node = models.fit_node((), x, y, 2, BuildConfig("scikit_kmeans", 1, "MLP-8", 1e-6, [2]).levels[0])
    assert node.n_predicted == node.n_classes == 2


# --- experiments ---------------------------------------------------------------


def test_buckets_to_visit():
    assert buckets_to_visit([1, 5, 10, 10.2, 100], 30) == [1, 3, 30]
    assert buckets_to_visit([10], 5) == []
    assert buckets_to_visit([10], 100, [2, 3]) == [2, 3, 10]


def test_experiment_and_baseline(spark, objects, queries, truth):
    folder = work_dir(spark, "runs")
    build = BuildConfig("scikit_kmeans", 20, "MLP-7", 0.01, [4, 2])
    config = ExperimentConfig(build, n_buckets_perc=[50, 100], data="embeddings", size="tiny")
    runs = {r["n_buckets"]: r for r in run_experiment(objects, queries, config, folder).collect()}
    best = runs[max(runs)]
    assert best["recall"] == 1.0 and best["algo"] == "learned-index"
    assert best["query_s"] is None and best["sweep_s"] > 0
    assert (best["solver"], best["train_rows"], best["metric"], best["score"], best["seed"]) == (
        "adam", 50_000, "inner_product", "conditional", 2023)
    assert list(best["n_categories"]) == [4, 2] and best["build_s"] > 0
    base = ExperimentConfig(build, index_type="baseline")
    row = run_experiment(objects, queries, base, folder, truth=truth).first()
    assert row["recall"] == 1.0
    stored = read_runs(spark, folder)
    assert stored.count() == len(runs) + 1
    neighbors = read_neighbors(spark, folder)
    assert {r["run_id"] for r in neighbors.select("run_id").distinct().collect()} == {
        r["run_id"] for r in stored.collect()
    }
    # the vectors were scaled to unit length before, so the last digits differ
    for mine, right in zip(rows(neighbors.filter(F.col("run_id") == row["run_id"])), rows(truth)):
        assert mine[:3] == right[:3] and mine[3] == pytest.approx(right[3], abs=1e-12)
    with pytest.raises(ValueError):
        ExperimentConfig(build, index_type="other")
    with pytest.raises(ValueError):
        run_experiment(objects, queries, config, folder, objects_search=objects)


def test_a_registered_function_clusters_900_nodes_in_few_jobs(spark):
    """The number of jobs does not depend on the number of nodes."""
    rows = spark.range(9000).selectExpr(
        "id", "array(CAST(id % 10 AS DOUBLE), 1D) AS v", "concat('b', id % 900) AS path_key")
    parameters = BuildConfig(
        ClusteringAlgorithm(label=lambda x, k: (x[:, 0] >= 5).astype(int)), 1, "MLP-8", 0.1, [2]).levels[0]
    spark.sparkContext.setJobGroup("label", "label")
    labelled = cluster_level(rows, rows, {f"b{i}": 2 for i in range(900)}, parameters, 1)
    assert labelled.where("cluster != CAST(id % 10 >= 5 AS INT)").count() == 0
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("label"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 4


def test_a_function_must_give_numbers_below_k(spark, objects):
    config = BuildConfig(ClusteringAlgorithm(label=lambda x, k: np.full(len(x), k)), 1, "MLP-8", 0.1, [2])
    with pytest.raises(Exception, match="a number below 2"):
        build_index(objects, config)


def test_an_unknown_kind_is_an_error(spark, objects):
    nodes = spark.createDataFrame(
        [([], "b", 0, "mine", [64, 2], [0.0], 2, 2, 2)], NODE_SCHEMA)
    with pytest.raises(ValueError, match="MODEL_KINDS"):
        assign_paths(objects, nodes)
