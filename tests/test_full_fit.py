"""Classifiers trained on all rows of their nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpath.operators.kernel import forward
from nearpath.operators.score import assign_paths
from nearpath.plans import full_fit, models
from nearpath.plans.build import build_index
from nearpath.plans.config import BuildConfig
from nearpath import fixtures as fx


def parameters(epochs, model="logistic", **more):
    return BuildConfig("scikit_kmeans", epochs, model, 0.01, [3], train_rows=None, **more).levels[0]


def labelled_rows(spark, nodes, parts=7):
    """``nodes``: path_key to (matrix, clusters)."""
    rows = [(x.tolist(), key, int(c)) for key, (xs, y) in nodes.items() for x, c in zip(xs, y)]
    return spark.createDataFrame(
        rows, "v array<double>, path_key string, cluster int").repartition(parts).persist()


def clouds(n, classes, dimension, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return rng.normal(size=(classes, dimension))[y] + spread * rng.normal(size=(n, dimension)), y


def batch(**nodes):
    return [{"path_key": key, "path": path, "n_requested": n} for key, (path, n) in nodes.items()]


def test_descent_finds_the_minimum():
    rng = np.random.default_rng(1)
    stretch = np.diag(10.0 ** np.arange(-1, 3)) + 0.1
    target = rng.normal(size=4)
    net = full_fit.Descent(np.zeros(4))
    taken = []
    for _ in range(200):
        away = net.point - target
        if net.take(away @ stretch @ away / 2, stretch @ away):
            taken.append(net.loss)
        if net.done:
            break
    assert net.done and np.allclose(net.at, target, atol=1e-5)
    assert taken == sorted(taken, reverse=True)


def test_sums_are_those_of_all_rows(spark):
    """Of a net whose sums take several pieces, and of a second node."""
    nodes = {"a": clouds(700, 8, 40, 2), "b": clouds(90, 3, 40, 3)}
    shapes = {"a": [40, 128, 8], "b": [40, 3]}
    rng = np.random.default_rng(4)
    points = {key: (shape, models.flattened(models.first_weights(shape, rng)))
              for key, shape in shapes.items()}
    assert len(points["a"][1]) > full_fit.PIECE
    importance = np.array([1.0, 3.0, 1, 1, 2, 1, 1, 1])
    got = full_fit.evaluate(labelled_rows(spark, nodes), points, importance)
    for key, (x, y) in nodes.items():
        own = importance[y]
        loss, gradients, predicted = models.loss_and_gradients(
            models.shaped(*points[key]), x, y, own / own.sum())
        assert got[key][0] == pytest.approx(loss)
        assert np.allclose(got[key][1], models.flattened(gradients))
        assert got[key][2] == len(set(predicted))


def test_shapes_round_trip():
    layers = [3, 5, 4]
    weights = models.first_weights(layers, np.random.default_rng(1))
    again = models.shaped(layers, models.flattened(weights))
    assert all(np.array_equal(a, b) for a, b in zip(weights, again)) and len(again) == len(weights)


def test_the_optimum_of_all_rows_is_reached(spark):
    """Overlapping clouds have one best logistic model; a gradient of zero shows it."""
    x, y = clouds(600, 3, 5, 5, spread=1.5)
    rows = labelled_rows(spark, {"b": (x, y)})
    node = full_fit.fit_on_all_rows(rows, batch(b=([], 3)), parameters(60), 5).first()
    _, gradients, predicted = models.loss_and_gradients(
        models.shaped(node["layers"], np.array(node["weights"])), x, y, np.full(600, 1 / 600))
    assert np.abs(models.flattened(gradients)).max() < 1e-4
    assert (predicted == y).mean() > 0.5 and node["n_predicted"] == 3


def test_class_weights_shift_the_model(spark):
    x, y = clouds(400, 2, 4, 7, spread=2.0)
    rows = labelled_rows(spark, {"b": (x, y)})
    share = []
    for weights in (None, {1: 4.0}):
        node = full_fit.fit_on_all_rows(
            rows, batch(b=([], 2)), parameters(25, class_weights=weights), 4).first()
        share.append((forward(node["layers"], np.array(node["weights"]), x).argmax(axis=1) == 1).mean())
    assert share[1] > share[0] + 0.1


def test_odd_nodes(spark):
    """A class that training misses, gaps in the numbers, one class, no rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    x[0] += 9
    rare = np.append(1, np.zeros(299, np.int64))
    apart = rng.normal(size=(60, 3)) + 6 * np.arange(60)[:, None] % 18
    nodes = {"b0": (x, rare), "b1": (apart, np.arange(60) % 3 * 2), "b2": (x[:5], np.zeros(5, int))}
    given = batch(b0=([0], 2), b1=([1], 6), b2=([2], 1), b3=([3], 1))
    got = {r["path_key"]: r for r in full_fit.fit_on_all_rows(
        labelled_rows(spark, nodes), given, parameters(1), 3).collect()}
    assert got["b0"]["n_predicted"] == got["b0"]["n_classes"] == 2
    assert got["b1"]["n_classes"] == 3 and got["b1"]["n_requested"] == 6
    assert got["b1"]["n_predicted"] == 3
    assert [(got[k]["kind"], got[k]["n_classes"]) for k in ("b2", "b3")] == [("constant", 1)] * 2


def test_build_on_all_rows(spark, sf_dir, monkeypatch):
    """Same index whether its nodes go in one batch or in several."""
    from nearpath.plans import build
    objects = fx.objects(spark, sf_dir)
    config = BuildConfig("scikit_kmeans", 12, "MLP-8", 0.01, [3, 2], train_rows=None)
    index = build_index(objects, config)
    assert index.nodes.filter(F.col("n_predicted") != F.col("n_classes")).count() == 0
    again = assign_paths(objects, index.nodes).select("id", F.col("path_key").alias("again"))
    moved = index.assignments.join(again, "id").filter(F.col("path_key") != F.col("again"))
    assert index.assignments.count() == objects.count() and moved.count() == 0
    monkeypatch.setattr(build, "BATCH_BYTES", 1)
    apart = build_index(objects, config)
    sizes = [sorted(r["n_objects"] for r in i.buckets.collect()) for i in (index, apart)]
    assert sum(sizes[0]) == sum(sizes[1]) and len(sizes[0]) == len(sizes[1])
