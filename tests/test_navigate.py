"""The order of buckets against a walk with a queue, and scoring against Spark ML."""

import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from nearpath.functions.paths import key_of
from nearpath.operators import navigate as nav
from nearpath.operators import score
from nearpath.operators.kernel import forward
from nearpath.plans.models import Node

LEAVES = "query_id long, path array<int>, path_key string, probs array<double>"


def random_tree(rng, depth, width):
    """{path: probabilities of its children}, and the leaves, at any depth."""
    tree, open_paths, leaves = {}, [()], []
    for level in range(depth):
        grown = []
        for path in open_paths:
            if level and rng.random() < 0.25:
                leaves.append(path)
                continue
            p = rng.random(rng.integers(1, width + 1)) + 1e-3
            tree[path] = p / p.sum()
            grown += [path + (c,) for c in range(len(p))]
        open_paths = grown
    return tree, leaves + open_paths


def walk(tree, leaves):
    """Take the waiting node with the highest own probability until none waits."""
    waiting, order, known = [], [], set(leaves)
    for c, p in enumerate(tree[()]):
        heapq.heappush(waiting, (-p, (c,)))
    while waiting:
        _, path = heapq.heappop(waiting)
        if path in known:
            order.append(path)
        for c, p in enumerate(tree.get(path, ())):
            heapq.heappush(waiting, (-p, path + (c,)))
    return order


def leaf_rows(tree, leaves, query_id=0):
    return [
        (query_id, list(path), key_of(path),
         [float(tree[path[:i]][path[i]]) for i in range(len(path))])
        for path in leaves
    ]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 100_000), st.integers(1, 4))
def test_sort_key_equals_the_walk(seed, depth):
    tree, leaves = random_tree(np.random.default_rng(seed), depth, 4)

    def key(path):
        probs = [tree[path[:i]][path[i]] for i in range(len(path))]
        return [-min(probs[i:]) for i in range(len(probs))]

    assert sorted(leaves, key=lambda path: (key(path), path)) == walk(tree, leaves)


def test_rank_buckets_equals_the_walk(spark):
    rng = np.random.default_rng(5)
    rows, wanted = [], {}
    for query_id in range(60):
        tree, leaves = random_tree(rng, int(rng.integers(1, 5)), 4)
        rows += leaf_rows(tree, leaves, query_id)
        wanted[query_id] = [key_of(path) for path in walk(tree, leaves)]
    ranked = nav.rank_buckets(spark.createDataFrame(rows, LEAVES)).orderBy(
        "query_id", "bucket_rank"
    )
    got = {}
    for row in ranked.collect():
        got.setdefault(row["query_id"], []).append(row["path_key"])
        assert row["bucket_rank"] == len(got[row["query_id"]])
    assert got == wanted


def test_joint_order_differs_and_ties_fall_to_the_path(spark):
    rows = [
        (0, [0, 0], "b0_0", [0.6, 0.3]), (0, [0, 1], "b0_1", [0.6, 0.3]),
        (0, [1, 0], "b1_0", [0.4, 0.5]),
    ]
    leaves = spark.createDataFrame(rows, LEAVES)

    def keys(**options):
        ranked = nav.rank_buckets(leaves, **options).orderBy("bucket_rank").collect()
        return [r["path_key"] for r in ranked]

    assert keys() == ["b1_0", "b0_0", "b0_1"]
    assert keys(score="joint") == ["b1_0", "b0_0", "b0_1"]
    assert keys(n_buckets=1) == ["b1_0"]
    assert keys(n_buckets=99) == ["b1_0", "b0_0", "b0_1"]
    with pytest.raises(ValueError):
        nav.rank_buckets(leaves, score="other")


def random_nodes(spark, rng, dimension, fan):
    """Random nodes: perceptrons, logistic and constant ones; paths end at any level."""
    nodes, ended = [], []
    paths = [()]
    for level, width in enumerate(fan):
        grown = []
        for path in paths:
            if level and path[-1] == 0:
                nodes.append(Node(path, "constant", [dimension, 1], [], 1))
                grown.append(path + (0,))
                continue
            if level and path[-1] == 1:
                ended.append(path)
                continue
            hidden = [6] if len(nodes) % 2 else []
            layers = [dimension, *hidden, width]
            size = sum(a * b + b for a, b in zip(layers, layers[1:]))
            kind = "mlp" if hidden else "logistic"
            nodes.append(Node(path, kind, layers, rng.normal(size=size).tolist(), width))
            grown += [path + (c,) for c in range(width)]
        paths = grown
    paths = sorted(paths + ended)
    frame = spark.createDataFrame([n.row() for n in nodes], score.NODE_SCHEMA)
    buckets = spark.createDataFrame(
        [(list(p), key_of(p)) for p in paths], "path array<int>, path_key string"
    )
    return nodes, frame, paths, buckets


@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(8)
    nodes, frame, paths, buckets = random_nodes(spark, rng, 4, [4, 3, 2])
    matrix = rng.normal(size=(50, 4))
    queries = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(matrix)], "query_id long, v array<double>"
    ).repartition(3)
    return nodes, frame.persist(), paths, buckets.persist(), matrix, queries.persist()


def test_probabilities_sum_to_one_and_are_ranked(tree):
    _, frame, _, _, _, queries = tree
    rows = score.predict_proba(queries, frame)
    sums = rows.groupBy("query_id", "parent_key").agg(F.sum("prob").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    groups = {}
    for row in rows.collect():
        groups.setdefault((row["query_id"], row["parent_key"]), []).append(row)
    for group in groups.values():
        group.sort(key=lambda r: r["class_rank"])
        probs = [r["prob"] for r in group]
        assert probs == sorted(probs, reverse=True)
        assert [r["class_rank"] for r in group] == list(range(1, len(group) + 1))


def test_scoring_in_parts_equals_one_broadcast(tree):
    _, frame, _, _, _, queries = tree

    def rows(**options):
        scored = score.predict_proba(queries, frame, **options).collect()
        return sorted((r["query_id"], r["parent_key"], r["class"], r["prob"]) for r in scored)

    assert len(score.node_batches(frame, 2000)) > 1
    assert rows() == rows(broadcast_bytes=2000)
    best = {(q, k): c for q, k, c, p in sorted(rows(), key=lambda r: (r[3], -r[2]))}
    got = score.predict(queries, frame, broadcast_bytes=2000).collect()
    assert {(r["query_id"], r["parent_key"]): r["class"] for r in got} == best


def descend(nodes, x):
    models = {n.path: n for n in nodes}
    path = ()
    while path in models:
        node = models[path]
        probs = forward(node.layers, np.array(node.weights), x[None, :])[0]
        path += (int(probs.argmax()),)
    return path


def test_assignment_both_ways(tree):
    nodes, frame, _, _, matrix, queries = tree
    objects = queries.withColumnRenamed("query_id", "id")
    wanted = {i: descend(nodes, x) for i, x in enumerate(matrix)}
    for options in ({}, {"broadcast_bytes": 0}):
        rows = score.assign_paths(objects, frame, **options).collect()
        assert {r["id"]: tuple(r["path"]) for r in rows} == wanted
        assert all(r["path_key"] == key_of(r["path"]) for r in rows)
        assert len(rows) == len(matrix)
        assert {r["id"]: tuple(r["v"]) for r in rows} == {
            i: tuple(x) for i, x in enumerate(matrix.tolist())
        }


@pytest.mark.parametrize("order", ["conditional", "joint"])
@pytest.mark.parametrize("n", [1, 3, 100])
def test_pruned_scan_equals_the_joined_levels(tree, monkeypatch, order, n):
    nodes, frame, paths, buckets, matrix, queries = tree
    buckets = buckets.filter(F.col("path_key") != key_of(paths[5]))  # an empty class

    def rows(ranked):
        return sorted((r["query_id"], r["bucket_rank"], r["path_key"]) for r in ranked.collect())

    scanned = rows(nav.navigate(queries, frame, buckets, n, order))
    monkeypatch.setattr(nav, "share_tree", lambda *a, **k: None)
    assert rows(nav.navigate(queries, frame, buckets, n, order)) == scanned
    assert len(scanned) == 50 * min(n, len(paths) - 1)


@pytest.mark.parametrize("order", ["conditional", "joint"])
def test_only_reached_nodes_are_scored(order):
    """A wide tree: few pairs of query and node are scored, and the best leaves found."""
    rng = np.random.default_rng(12)
    models, children, paths = {}, {}, []
    n = 12
    for path in [()] + [(a,) for a in range(n)] + [(a, b) for a in range(n) for b in range(n)]:
        models[key_of(path)] = ([6, n], 3 * rng.normal(size=7 * n))
        ends = [len(paths) + c if len(path) == 2 else -1 for c in range(n)]
        if len(path) == 2:
            paths += [path + (c,) for c in range(n)]
        children[key_of(path)] = (np.arange(n), np.array(ends), [key_of(path + (c,)) for c in range(n)])
    x = rng.normal(size=(40, 6))
    rows, columns, probs, scored = score.reach_leaves(x, models, children, 3, order, 3)
    assert scored < 40 * len(models) / 4
    for q in range(40):
        steps = {path: [forward(*models[key_of(path[:i])], x[q : q + 1])[0][path[i]] for i in range(3)]
                 for path in paths}
        key = (lambda p: np.prod(p)) if order == "joint" else min
        wanted = sorted(paths, key=lambda path: -key(steps[path]))[:3]
        got = {paths[c]: p for r, c, p in zip(rows, columns, probs) if r == q}
        assert set(wanted) <= set(got)
        assert all(np.allclose(p, steps[path]) for path, p in got.items())


def test_step_down_equals_assignment(tree, monkeypatch):
    nodes, frame, _, _, matrix, queries = tree
    objects = queries.withColumnRenamed("query_id", "id")
    wanted = {r["id"]: r["path_key"] for r in score.assign_paths(objects, frame).collect()}
    for limit in (1 << 28, 2000):
        monkeypatch.setattr(score, "NODE_BYTES", limit)
        placed = objects.select("id", "v", F.expr("cast(array() as array<int>)").alias("path"),
                                F.lit("b").alias("path_key"))
        for level in range(3):
            placed = score.step_down(placed, frame.filter(F.col("level") == level))
        assert {r["id"]: r["path_key"] for r in placed.collect()} == wanted


def test_scan_hands_on_few_rows(tree):
    _, frame, _, buckets, _, queries = tree
    shared = score.share_tree(frame, buckets)
    assert score.score_leaves(queries, shared, 2).count() < 50 * 5


@pytest.mark.parametrize("order", ["conditional", "joint"])
@pytest.mark.parametrize("n", [1, 4, 1000])
def test_the_level_walk_equals_the_broadcast_tree(tree, monkeypatch, order, n):
    _, nodes, _, buckets, _, queries = tree
    key = lambda f: sorted(
        (r["query_id"], r["bucket_rank"], r["path_key"], round(r["probs"][-1], 9))
        for r in f.collect())
    wanted = key(nav.navigate(queries, nodes, buckets, n, order))
    monkeypatch.setattr(score, "NODE_BYTES", 10)  # several parts a level
    assert key(nav.navigate(queries, nodes, buckets, n, order)) == wanted


def test_the_level_walk_expands_few_nodes(spark, monkeypatch):
    """No row for each query and node: only for children of nodes that can lead to
    a wanted bucket."""
    rng = np.random.default_rng(9)
    paths = [()] + [(a,) for a in range(12)] + [(a, b) for a in range(12) for b in range(12)]
    rows = []
    for path in paths:
        weights = (6 * rng.normal(size=9 * 12)).tolist()
        rows.append((list(path), key_of(path), len(path), "logistic", [8, 12], weights, 12, 12, 12))
    nodes = spark.createDataFrame(rows, score.NODE_SCHEMA)
    buckets = spark.createDataFrame(
        [([a, b, c], key_of((a, b, c)), 1) for a in range(12) for b in range(12) for c in range(12)],
        "path array<int>, path_key string, n_objects long")
    queries = spark.createDataFrame(
        [(i, rng.normal(size=8).tolist()) for i in range(40)], "query_id long, v array<double>")
    expanded = []
    plain = nav.expand
    monkeypatch.setattr(nav, "expand", lambda *a: expanded.append(plain(*a)) or expanded[-1])
    leaves = nav.walk_levels(queries, nodes, buckets, 5)
    ranked = {(r["query_id"], r["bucket_rank"]): r["path_key"]
              for r in nav.rank_buckets(leaves, 5).collect()}
    wanted = {(r["query_id"], r["bucket_rank"]): r["path_key"]
              for r in nav.navigate(queries, nodes, buckets, 5).collect()}
    assert ranked == wanted and len(ranked) == 200
    handed_on = sum(frame.count() for frame in expanded)
    assert handed_on < 0.25 * 40 * len(paths) * 12


def test_many_wanted_buckets_go_with_few_queries(tree, monkeypatch):
    _, nodes, _, buckets, _, queries = tree
    wanted = [tuple(r) for r in nav.navigate(queries, nodes, buckets, 50).sort(
        "query_id", "bucket_rank").select("query_id", "path_key").collect()]
    monkeypatch.setattr(score, "BEST_CELLS", 60)
    assert [tuple(r) for r in nav.navigate(queries, nodes, buckets, 50).sort(
        "query_id", "bucket_rank").select("query_id", "path_key").collect()] == wanted


def test_too_large_trees_are_not_broadcast(tree, monkeypatch):
    _, frame, _, buckets, _, _ = tree
    monkeypatch.setattr(score, "NODE_BYTES", 10)
    assert score.share_tree(frame, buckets) is None
    monkeypatch.setattr(score, "NODE_BYTES", 1 << 30)
    monkeypatch.setattr(score, "LEAF_COLUMNS", 2)
    assert score.share_tree(frame, buckets) is None


def test_forward_equals_spark_models(spark):
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(80, 5))
    labels = rng.integers(0, 3, size=80)
    rows = spark.createDataFrame(
        [(float(y), x.tolist()) for x, y in zip(matrix, labels)], "label double, v array<double>"
    ).select("label", array_to_vector("v").alias("features"))
    layers = [5, 7, 4, 3]
    mlp = MultilayerPerceptronClassifier(layers=layers, maxIter=5, seed=1).fit(rows)
    logistic = LogisticRegression(family="multinomial", maxIter=5).fit(rows)
    flat = np.concatenate(
        [logistic.coefficientMatrix.toArray().ravel(order="F"), logistic.interceptVector.toArray()]
    )
    for model, shape, weights in ((mlp, layers, mlp.weights.toArray()), (logistic, [5, 3], flat)):
        out = model.transform(rows).select("features", vector_to_array("probability").alias("p"))
        out = out.collect()
        x = np.array([r["features"].toArray() for r in out])
        wanted = np.array([r["p"] for r in out])
        assert np.allclose(forward(shape, weights, x), wanted, atol=1e-12)
