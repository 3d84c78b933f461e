"""Node classifiers trained on all rows of their nodes.

One job is one evaluation of the loss and its gradient for every node of a
batch: tasks hand on partial sums, Spark adds them up, and the driver, which
holds the weights of the batch only, takes one step of limited-memory BFGS a
node. So no node's rows ever meet in one task, and a root with all rows is as
many tasks as its rows need. Nodes that are done leave the next jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.functions.vectors import as_doubles
from nearpath.operators.kernel import rows_by_key, to_matrix
from nearpath.operators.score import NODE_SCHEMA
from nearpath.plans.config import ModelParameters
from nearpath.plans.kmeans import SEED
from nearpath.plans.models import (
    COVERAGE_ROUNDS, Node, constant_node, first_weights, flattened, hidden_layers,
    loss_and_gradients, nearest_centre_weights, node_rows, shaped,
)

#: Steps remembered by the descent, and the vectors as long as a node's weights
#: that the driver holds with them.
MEMORY = 5
HELD = 2 * MEMORY + 6
SUFFICIENT = 1e-4
SMALLEST_STEP = 1e-10
FLAT = 1e-8
#: Sums of a node travel in pieces, so that one node's sums are added up by
#: several tasks.
PIECE = 4096

SUMS = "path_key string, piece int, total array<double>"


class Descent:
    """Limited-memory BFGS with halved steps. ``point`` is where it wants the
    loss and the gradient next; :meth:`take` receives them."""

    def __init__(self, start: np.ndarray):
        self.point = self.at = start
        self.loss = np.inf
        self.gradient = np.zeros_like(start)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.length = 1.0
        self.done = False

    def take(self, loss: float, gradient: np.ndarray) -> bool:
        """Whether ``point`` is the best so far and was accepted."""
        moved = self.point - self.at
        enough = self.loss + SUFFICIENT * (self.gradient @ moved)
        if np.isfinite(self.loss) and not loss <= enough:
            self.length /= 2
            if self.length < SMALLEST_STEP:
                self.done = not self.steps  # else once more, straight down
                self.steps, self.length = [], 1.0
            self._aim()
            return False
        if np.isfinite(self.loss):
            change = gradient - self.gradient
            if moved @ change > 1e-12 * (change @ change):
                self.steps = [*self.steps, (moved, change)][-MEMORY:]
        self.at, self.loss, self.gradient, self.length = self.point, loss, gradient, 1.0
        self.done = bool(np.abs(gradient).max() < FLAT)
        self._aim()
        return True

    def _aim(self) -> None:
        direction = -self.gradient
        shares = []
        for moved, change in reversed(self.steps):
            shares.append((moved @ direction) / (moved @ change))
            direction = direction - shares[-1] * change
        if self.steps:
            moved, change = self.steps[-1]
            direction = direction * ((moved @ change) / (change @ change))
        else:
            direction = direction * min(1.0, 1 / max(np.abs(self.gradient).sum(), FLAT))
        for (moved, change), share in zip(self.steps, reversed(shares)):
            direction = direction + (share - (change @ direction) / (moved @ change)) * moved
        self.point = self.at + self.length * direction


def evaluate(
    rows: DataFrame, points: dict[str, tuple[list[int], np.ndarray]], class_weights: np.ndarray
) -> dict[str, tuple[float, np.ndarray, int]]:
    """Weighted mean loss, its gradient and the number of classes predicted for some
    row, of each node of ``points``: one job. ``rows`` has ``v, path_key, cluster``."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((points, class_weights))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, importances = shared.value
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, members in rows_by_key(batch.column("path_key")).items():
                if key not in wanted:
                    continue
                layers, weights = wanted[key]
                x = to_matrix(batch.column("v").take(pa.array(members)))
                y = batch.column("cluster").to_numpy()[members]
                importance = importances[y]
                loss, gradients, predicted = loss_and_gradients(
                    shaped(layers, weights), x, y, importance)
                own = np.concatenate([
                    [loss, importance.sum()], np.bincount(predicted, minlength=layers[-1]),
                    flattened(gradients)])
                sums[key] = sums[key] + own if key in sums else own
        for key, total in sums.items():
            pieces = [total[at:at + PIECE] for at in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_pydict({
                "path_key": [key] * len(pieces),
                "piece": pa.array(range(len(pieces)), pa.int32()),
                "total": pieces,
            })

    added = (
        rows.where(F.col("path_key").isin(list(points))).select("v", "path_key", "cluster")
        .mapInArrow(add_up, SUMS)
        .groupBy("path_key", "piece")
        .agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
        .toArrow().sort_by([("path_key", "ascending"), ("piece", "ascending")])
    )
    shared.destroy()
    out = {}
    for key, members in rows_by_key(added.column("path_key")).items():
        total = np.concatenate([added.column("total")[int(i)].values.to_numpy() for i in members])
        n = points[key][0][-1]
        out[key] = (total[0] / total[1], total[2 + n:] / total[1], int((total[2:2 + n] > 0).sum()))
    return out


def with_dense_classes(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """``cluster`` numbered without gaps inside each node; ``sizes`` has the clusters
    with rows of each node, ``path_key, cluster``, and is small."""
    places: dict[str, list[int]] = {}
    for row in sizes.orderBy("path_key", "cluster").collect():
        places.setdefault(row["path_key"], []).append(row["cluster"])
    if all(own == list(range(len(own))) for own in places.values()):
        return labelled
    numbers = labelled.sparkSession.createDataFrame(
        [(key, c, i) for key, own in places.items() for i, c in enumerate(own)],
        "path_key string, cluster int, number int")
    return labelled.join(F.broadcast(numbers), ["path_key", "cluster"]).select(
        "v", "path_key", F.col("number").alias("cluster"))


def fit_on_all_rows(
    labelled: DataFrame, batch: list, parameters: ModelParameters, dimension: int
) -> DataFrame:
    """The node rows of a batch, fitted on all of ``labelled`` (v, path_key, cluster).

    ``batch`` has ``path_key, path, n_requested`` of each node; the caller bounds
    its weights. A node stops where its gradient is flat, or after ``epochs``
    evaluations if every class is predicted by then; after as many again in each
    further round the nearest centre decides. ``labelled`` is read once an
    evaluation and should be a written table.
    """
    spark = labelled.sparkSession
    sizes = labelled.groupBy("path_key", "cluster").count()
    classes = {r["path_key"]: r["n"] for r in sizes.groupBy("path_key").agg(
        F.count("*").alias("n")).collect()}
    rows = with_dense_classes(labelled, sizes.select("path_key", "cluster"))
    given = dict(parameters.class_weights)
    importances = np.array([given.get(c, 1.0) for c in range(max(classes.values(), default=1))])

    done: list[Node] = []
    nets, layers, covered = {}, {}, {}
    known = {row["path_key"]: row for row in batch}
    for key, row in known.items():
        path = tuple(row["path"])
        if classes.get(key, 1) < 2:
            done.append(constant_node(path, dimension, row["n_requested"]))
            continue
        layers[key] = [dimension, *hidden_layers(parameters.model_type), classes[key]]
        start = first_weights(layers[key], np.random.default_rng([SEED, *path]))
        nets[key], covered[key] = Descent(flattened(start)), 0

    def finish(key: str, kind: str, shape: list[int], weights: np.ndarray, predicted: int) -> None:
        row = known[key]
        done.append(Node(
            tuple(row["path"]), kind, shape, weights.tolist(), predicted, row["n_requested"]))

    for round_ in range(COVERAGE_ROUNDS):
        for _ in range(parameters.epochs):
            going = {key: (layers[key], net.point) for key, net in nets.items() if not net.done}
            if not going:
                break
            for key, (loss, gradient, predicted) in evaluate(rows, going, importances).items():
                if nets[key].take(loss, gradient):
                    covered[key] = predicted
        for key in [key for key in nets if covered[key] == classes[key]]:
            kind = "mlp" if len(layers[key]) > 2 else "logistic"
            finish(key, kind, layers[key], nets.pop(key).at, covered[key])
        if not nets or all(net.done for net in nets.values()):
            break
    if nets:
        own = rows.where(F.col("path_key").isin(list(nets)))
        means = own.groupBy("path_key", "cluster").agg(vector_to_array(
            Summarizer.mean(array_to_vector(as_doubles("v")))).alias("centre"))
        found = means.toArrow().sort_by([("path_key", "ascending"), ("cluster", "ascending")])
        centres = to_matrix(found.column("centre"))
        points = {key: ([dimension, classes[key]], nearest_centre_weights(centres[members]))
                  for key, members in rows_by_key(found.column("path_key")).items()}
        for key, (_, _, predicted) in evaluate(own, points, importances).items():
            finish(key, "logistic", *points[key], predicted)
    return spark.createDataFrame(node_rows(iter(done)), schema=NODE_SCHEMA)
