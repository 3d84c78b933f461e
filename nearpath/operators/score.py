"""Scoring vectors with the node models of an index.

A node is one row ``(path, path_key, level, kind, layers, weights, n_classes)``.
Node tables are broadcast when their checked size allows it; larger ones go in
parts, each with the rows that stand at its nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearpath.functions.paths import ROOT_KEY, key_of
from nearpath.operators.kernel import forward, rows_by_key, to_matrix, to_vector_column
from nearpath.operators.knn import broadcast_catalog
from nearpath.sources.workdir import settle

NODE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("path_key", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("layers", T.ArrayType(T.IntegerType())),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("n_classes", T.IntegerType()),
        # Classes asked of the clustering, and those the fitted model predicts.
        T.StructField("n_requested", T.IntegerType()),
        T.StructField("n_predicted", T.IntegerType()),
    ]
)

# Node weights that may be broadcast, in bytes.
NODE_BYTES = 256 << 20

# Queries that may be broadcast to the nodes they wait at, in bytes.
QUERY_BYTES = 128 << 20

# Buckets whose probabilities one task may hold for a slice of queries.
LEAF_COLUMNS = 100_000

# Doubles that a task may hold for the best leaves of a slice of queries.
BEST_CELLS = 4_000_000

# Vectors scored at once inside a task.
SLICE_ROWS = 1024

SCORES = "query_id long, parent_key string, class int, prob double, class_rank long"
LEAVES = "query_id long, path array<int>, path_key string, probs array<double>"


# Kinds of nodes that ``forward`` scores.
BUILT_IN = ("constant", "logistic", "mlp")


@dataclass(frozen=True)
class ModelKind:
    """A classifier of the user's own.

    ``fit(x, y, n_classes, parameters, importance, rng)`` gives its weights as a
    flat array, from rows, their classes and what each row weighs; it is called
    again, with the same ``rng``, while a class is not predicted.
    ``score(layers, weights, x)`` gives the probability of every class for every
    row; ``layers`` is ``[dimension, n_classes]``.
    """

    fit: Callable
    score: Callable


# The user's kinds by the name under which a configuration asks for them and the
# node table keeps them. They travel to the tasks by value.
MODEL_KINDS: dict[str, ModelKind] = {}


def node_bytes(nodes: DataFrame) -> int:
    """An upper bound of what the node table takes when broadcast."""
    return nodes.agg(F.sum(F.size("weights") * 8 + 256)).first()[0] or 0


def class_probabilities(model: tuple, x: np.ndarray) -> np.ndarray:
    """Of the rows of a matrix, by a node's layers and weights and, for a kind that
    the user registered, its pickled scoring function."""
    layers, weights, *code = model
    score = _scoring(code[0]) if code and code[0] else forward
    return score(layers, weights, x)


@lru_cache(maxsize=64)
def _scoring(code: bytes) -> Callable:
    return cloudpickle.loads(code)


def _codes(kinds) -> dict[str, bytes | None]:
    """The pickled scoring function of each kind; none for the built-in ones."""
    out: dict[str, bytes | None] = {}
    for kind in set(kinds):
        if kind in BUILT_IN:
            out[kind] = None
        elif kind in MODEL_KINDS:
            out[kind] = cloudpickle.dumps(MODEL_KINDS[kind].score)
        else:
            raise ValueError(f"nodes of kind {kind!r}: register it in MODEL_KINDS first")
    return out


def _share_nodes(nodes: DataFrame):
    """The (size-checked) nodes as a broadcast dict path key -> model."""
    rows = nodes.select("path_key", "layers", "weights", "kind").toArrow()
    kinds = rows.column("kind").to_pylist()
    codes = _codes(kinds)
    models = {
        key: (layers, np.asarray(weights, dtype=np.float64), codes[kind])
        for key, layers, weights, kind in zip(
            rows.column("path_key").to_pylist(),
            rows.column("layers").to_pylist(),
            (w.values.to_numpy(zero_copy_only=False) for w in rows.column("weights")),
            kinds,
        )
    }
    return nodes.sparkSession.sparkContext.broadcast(models)


def _score_rows(ids: np.ndarray, key: str, probs: np.ndarray) -> dict:
    n, classes = probs.shape
    order = np.argsort(-probs, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(1, classes + 1)[None, :], axis=1)
    return {
        "query_id": np.repeat(ids, classes),
        "parent_key": np.repeat(np.array([key], dtype=object), n * classes),
        "class": np.tile(np.arange(classes, dtype=np.int32), n),
        "prob": probs.ravel(),
        "class_rank": rank.ravel().astype(np.int64),
    }


def node_batches(nodes: DataFrame, limit: int) -> list[DataFrame]:
    """The nodes in parts of which each may be broadcast, by hash of their keys."""
    size = node_bytes(nodes)
    n = 1 if size <= limit else min(-(-2 * size // max(limit, 1)), max(1, nodes.count()))
    if n == 1:
        return [nodes]
    place = F.pmod(F.xxhash64("path_key"), F.lit(n))
    return [nodes.filter(place == number) for number in range(n)]


def _score_nodes(queries: DataFrame, nodes: DataFrame, rows_of, schema: str, limit) -> DataFrame:
    """Every node on every query. A node table too large for one broadcast goes
    part by part, each a scan of the queries; nothing is shuffled."""

    def scan(part: DataFrame) -> DataFrame:
        shared = _share_nodes(part)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("query_id").to_numpy()
                vectors = to_matrix(batch.column("v"))
                for start in range(0, len(ids), SLICE_ROWS):
                    own = slice(start, start + SLICE_ROWS)
                    for key, model in shared.value.items():
                        probs = class_probabilities(model, vectors[own])
                        yield pa.RecordBatch.from_pydict(rows_of(ids[own], key, probs))

        return queries.select("query_id", "v").mapInArrow(score, schema)

    parts = node_batches(nodes, NODE_BYTES if limit is None else limit)
    return reduce(DataFrame.unionByName, map(scan, parts))


def predict_proba(
    queries: DataFrame, nodes: DataFrame, broadcast_bytes: int | None = None
) -> DataFrame:
    """Every class probability of every node for every query, best class first.

    Rows are ``(query_id, parent_key, class, prob, class_rank)``.
    """
    return _score_nodes(queries, nodes, _score_rows, SCORES, broadcast_bytes)


def predict(
    queries: DataFrame, nodes: DataFrame, broadcast_bytes: int | None = None
) -> DataFrame:
    """The most probable class of every node: ``(query_id, parent_key, class)``."""

    def best(ids: np.ndarray, key: str, probs: np.ndarray) -> dict:
        return {
            "query_id": ids,
            "parent_key": np.repeat(np.array([key], dtype=object), len(ids)),
            "class": probs.argmax(axis=1).astype(np.int32),
        }

    return _score_nodes(
        queries, nodes, best, "query_id long, parent_key string, class int", broadcast_bytes)


def assign_paths(
    objects: DataFrame, nodes: DataFrame, broadcast_bytes: int | None = None
) -> DataFrame:
    """Send every object down the tree: ``(id, v, path, path_key)``.

    At each level the object follows the most probable class of its node. An
    object stops where no node continues its path.
    """
    if node_bytes(nodes) <= (NODE_BYTES if broadcast_bytes is None else broadcast_bytes):
        shared = _share_nodes(nodes)

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = to_matrix(batch.column("v"))
                paths: list[tuple[int, ...]] = [()] * len(vectors)
                open_rows = {(): np.arange(len(vectors))} if len(vectors) else {}
                while open_rows:
                    path, rows = open_rows.popitem()
                    model = shared.value.get(key_of(path))
                    if model is None:
                        for row in rows:
                            paths[row] = path
                        continue
                    classes = class_probabilities(model, vectors[rows]).argmax(axis=1)
                    for c in np.unique(classes):
                        open_rows[path + (int(c),)] = rows[classes == c]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("v"),
                        pa.array(paths, pa.list_(pa.int32())),
                        pa.array([key_of(path) for path in paths], pa.string()),
                    ],
                    names=["id", "v", "path", "path_key"],
                )

        kind = objects.schema["v"].dataType.simpleString()
        return objects.select("id", "v").mapInArrow(
            descend, f"id long, v {kind}, path array<int>, path_key string"
        )

    placed = objects.select(
        "id", "v", F.expr("cast(array() as array<int>)").alias("path"),
        F.lit(ROOT_KEY).alias("path_key"),
    )
    for row in nodes.select("level").distinct().orderBy("level").collect():
        # each part of a level reads the rows once more
        placed = settle(
            step_down(placed, nodes.filter(F.col("level") == row["level"]), broadcast_bytes), "placed")
    return placed


def step_down(
    placed: DataFrame, nodes: DataFrame, broadcast_bytes: int | None = None
) -> DataFrame:
    """Send each row of ``placed`` (id, v, path, path_key) one level down: its path
    gets the most probable class of its node. Rows without a node stay.

    Nothing is shuffled. Nodes too large for one broadcast go part by part, each
    with the rows of its nodes.
    """
    kind = placed.schema["v"].dataType.simpleString()
    schema = f"id long, v {kind}, path array<int>, path_key string"
    parts = node_batches(nodes, NODE_BYTES if broadcast_bytes is None else broadcast_bytes)

    def step(number: int, part: DataFrame) -> DataFrame:
        shared = _share_nodes(part)
        own = placed.select("id", "v", "path", "path_key")
        if len(parts) > 1:
            own = own.filter(F.pmod(F.xxhash64("path_key"), F.lit(len(parts))) == number)

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = to_matrix(batch.column("v"))
                paths, keys = batch.column("path").to_pylist(), batch.column("path_key").to_pylist()
                for key, rows in rows_by_key(batch.column("path_key")).items():
                    if key not in shared.value:
                        continue
                    classes = class_probabilities(shared.value[key], vectors[rows]).argmax(axis=1)
                    for row, c in zip(rows.tolist(), classes.tolist()):
                        paths[row] = [*paths[row], c]
                        keys[row] = key_of(paths[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"),
                     pa.array(paths, pa.list_(pa.int32())), pa.array(keys, pa.string())],
                    names=["id", "v", "path", "path_key"],
                )

        return own.mapInArrow(follow, schema)

    return reduce(DataFrame.unionByName, [step(i, part) for i, part in enumerate(parts)])


@dataclass
class SharedTree:
    """Nodes and buckets of an index, broadcast for scoring whole paths."""

    models: Broadcast
    leaves: Broadcast
    n_leaves: int


def share_tree(
    nodes: DataFrame, buckets: DataFrame, size: int | None = None, n_leaves: int | None = None
) -> SharedTree | None:
    """Broadcast a tree, or nothing if it is too large for that.

    ``size`` and ``n_leaves`` save counting where they are known.
    """
    if (node_bytes(nodes) if size is None else size) > NODE_BYTES:
        return None
    if (buckets.count() if n_leaves is None else n_leaves) > LEAF_COLUMNS:
        return None
    paths = sorted(tuple(row["path"]) for row in buckets.select("path").collect())
    columns = {path: column for column, path in enumerate(paths)}
    # For each node its classes that lead somewhere, and where: the column of a
    # bucket, or -1 and the key of the next node.
    below: dict[str, dict[int, tuple[int, str]]] = {}
    for path in paths:
        for level, step in enumerate(path):
            end = columns.get(path[: level + 1], -1)
            below.setdefault(key_of(path[:level]), {})[step] = (end, key_of(path[: level + 1]))
    children = {
        key: (
            np.array(sorted(steps), dtype=np.int64),
            np.array([steps[c][0] for c in sorted(steps)], dtype=np.int64),
            [steps[c][1] for c in sorted(steps)],
        )
        for key, steps in below.items()
    }
    leaves = nodes.sparkSession.sparkContext.broadcast((paths, children))
    return SharedTree(_share_nodes(nodes), leaves, len(paths))


def reach_leaves(
    vectors: np.ndarray, models: dict, children: dict, n_buckets: int, score: str, depth: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The leaves that can be among each query's best, by expanding only nodes
    that can lead to one.

    No leaf below a node has a larger first sort key than the smallest (or, for
    ``joint``, the product) of the probabilities down to the node. Each round
    expands the most promising waiting node of every query, and a node is
    dropped once ``n_buckets`` leaves with larger keys are known. Returns query
    rows, leaf columns, the probabilities along the paths (NaN beyond their
    ends), and how many pairs of query and node were scored.
    """
    n = len(vectors)
    # The product here and in the ranking may differ in the last bits.
    slack = 1 - 1e-9 if score == "joint" else 1.0
    keep = min(n_buckets, 1 << 20)
    best = np.full((n, keep), -np.inf)
    waiting = {
        "query": np.arange(n), "node": np.full(n, ROOT_KEY, dtype=object),
        "bound": np.ones(n), "trail": np.full((n, depth), np.nan), "level": np.zeros(n, np.int64),
    }
    found: list[tuple[np.ndarray, ...]] = []
    scored = 0
    while len(waiting["query"]):
        alive = waiting["bound"] >= best.min(axis=1)[waiting["query"]] * slack
        waiting = {name: column[alive] for name, column in waiting.items()}
        order = np.lexsort((-waiting["bound"], waiting["query"]))
        first = np.append(True, np.diff(waiting["query"][order]) != 0)[: len(order)]
        now, later = order[first], order[~first]
        parts = [{name: column[later] for name, column in waiting.items()}]
        nodes, group = np.unique(waiting["node"][now].astype(str), return_inverse=True)
        for number, key in enumerate(nodes):
            rows = now[group == number]
            query = waiting["query"][rows]
            classes, ends, keys = children[key]
            probs = class_probabilities(models[key], vectors[query])[:, classes]
            scored += len(rows)
            bound = waiting["bound"][rows][:, None]
            bounds = bound * probs if score == "joint" else np.minimum(bound, probs)
            trail = np.repeat(waiting["trail"][rows][:, None, :], len(classes), axis=1)
            level = waiting["level"][rows]
            trail[np.arange(len(rows)), :, level] = probs
            is_leaf = ends >= 0
            if is_leaf.any():
                keys_here = bounds[:, is_leaf]
                joined = np.concatenate([best[query], keys_here], axis=1)
                cut = joined.shape[1] - keep
                best[query] = np.partition(joined, cut, axis=1)[:, cut:]
                found.append((
                    np.repeat(query, is_leaf.sum()), np.tile(ends[is_leaf], len(rows)),
                    keys_here.ravel(), trail[:, is_leaf].reshape(-1, depth),
                ))
            inner = np.flatnonzero([k in children for k in keys])
            if len(inner):
                parts.append({
                    "query": np.repeat(query, len(inner)),
                    "node": np.tile(np.array([keys[i] for i in inner], dtype=object), len(rows)),
                    "bound": bounds[:, inner].ravel(),
                    "trail": trail[:, inner].reshape(-1, depth),
                    "level": np.repeat(level + 1, len(inner)),
                })
        waiting = {name: np.concatenate([part[name] for part in parts]) for name in waiting}
    query, column, key, trail = (np.concatenate(part) for part in zip(*found))
    stay = key >= best.min(axis=1)[query] * slack
    return query[stay], column[stay], trail[stay], scored


def score_leaves(
    queries: DataFrame, tree: SharedTree, n_buckets: int, score: str = "conditional"
) -> DataFrame:
    """Probabilities along the path of every bucket that can be among the best.

    Rows are ``(query_id, path, path_key, probs)``. A bucket whose first sort
    key is below that of the ``n_buckets``-th best is not handed on: it cannot
    rank among them. Nodes that lead to no such bucket are not scored.
    """
    shared, leaves = tree.models, tree.leaves
    wanted = min(n_buckets, tree.n_leaves)

    def score_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, (paths, children) = shared.value, leaves.value
        depth = max(map(len, paths))
        path_column = pa.array(paths, pa.list_(pa.int32()))
        key_column = pa.array([key_of(path) for path in paths], pa.string())
        for batch in batches:
            ids = batch.column("query_id").to_numpy()
            vectors = to_matrix(batch.column("v"))
            # many wanted buckets go with few queries at once
            step = max(1, min(SLICE_ROWS, BEST_CELLS // wanted))
            for start in range(0, len(ids), step):
                part = slice(start, start + step)
                rows, columns, probs, _ = reach_leaves(
                    vectors[part], models, children, wanted, score, depth)
                valid = ~np.isnan(probs)
                offsets = np.concatenate([[0], np.cumsum(valid.sum(axis=1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[part][rows]),
                        path_column.take(pa.array(columns)),
                        key_column.take(pa.array(columns)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(probs[valid])),
                    ],
                    names=["query_id", "path", "path_key", "probs"],
                )

    return queries.select("query_id", "v").mapInArrow(score_batch, LEAVES)


FRONTIER = (
    "query_id long, path array<int>, path_key string, probs array<double>, bound double"
)


def expand(frontier: DataFrame, queries: DataFrame, nodes: DataFrame, score: str) -> DataFrame:
    """The children of every waiting node, each under its probability.

    ``frontier`` is ``(query_id, path, path_key, probs, bound)``; the result has the
    same columns, one row a class of the node; ``queries`` may carry a broadcast
    hint (:func:`broadcast_queries`). Nodes too large for one broadcast
    go part by part, each with the rows that wait at its nodes.
    """
    parts = node_batches(nodes, NODE_BYTES)
    waiting = frontier.join(queries, "query_id")

    def step(number: int, part: DataFrame) -> DataFrame:
        shared = _share_nodes(part)
        own = waiting
        if len(parts) > 1:
            own = own.filter(F.pmod(F.xxhash64("path_key"), F.lit(len(parts))) == number)

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    rows = batch.slice(start, SLICE_ROWS)
                    for key, at in rows_by_key(rows.column("path_key")).items():
                        if key in shared.value:
                            yield _children(rows.take(pa.array(at)), shared.value[key], score)

        return own.mapInArrow(follow, FRONTIER)

    return reduce(DataFrame.unionByName, [step(i, part) for i, part in enumerate(parts)])


def broadcast_queries(queries: DataFrame) -> DataFrame:
    """Queries, to be broadcast if their checked size allows it."""
    size = queries.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    return F.broadcast(queries) if size <= QUERY_BYTES else queries


def _children(rows: pa.RecordBatch, model, score: str) -> pa.RecordBatch:
    """All classes of one node, for the rows that wait there."""
    probs = class_probabilities(model, to_matrix(rows.column("v")))
    n, classes = probs.shape
    bound = rows.column("bound").to_numpy()[:, None]
    bound = bound * probs if score == "joint" else np.minimum(bound, probs)

    parent = tuple(rows.column("path")[0].as_py())  # all rows wait at one node

    def appended(column: pa.Array, last: np.ndarray) -> pa.Array:
        """Each list ``classes`` times, with one more value."""
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(n, len(parent))
        grown = np.concatenate([np.repeat(values, classes, axis=0), last.reshape(-1, 1)], axis=1)
        return to_vector_column(grown.astype(last.dtype), column.type.value_type)

    step = np.tile(np.arange(classes, dtype=np.int32), n)
    path = appended(rows.column("path"), step)
    keys = pa.array([key_of((*parent, c)) for c in range(classes)], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(rows.column("query_id").to_numpy(), classes)),
            path, keys.take(pa.array(step)),
            appended(rows.column("probs"), probs.ravel()), pa.array(bound.ravel()),
        ],
        names=["query_id", "path", "path_key", "probs", "bound"],
    )
