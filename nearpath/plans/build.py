"""Building an index: one model per node, level by level.

Each level clusters all rows of all its nodes together, fits all classifiers in
one grouped job whose tasks hand on finished nodes (or, on all rows, by one job
an evaluation), and places every row once; the next level goes on from that placement. Nodes go in batches whose centres
and weights may be broadcast. So the number of jobs depends on the number of
levels and batches, not on the number of nodes, and the driver holds one batch
of centres and a row of counts a node.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.functions.paths import ROOT_KEY
from nearpath.functions.vectors import as_doubles
from nearpath.operators.kernel import to_matrix
from nearpath.operators.knn import broadcast_catalog
from nearpath.operators.score import MODEL_KINDS, NODE_SCHEMA, step_down
from nearpath.plans.clustering import LABEL
from nearpath.plans.config import BuildConfig, ModelParameters
from nearpath.plans.full_fit import HELD, fit_on_all_rows
from nearpath.plans.index import (
    BUCKET_SCHEMA,
    BUCKETS,
    META,
    META_SCHEMA,
    NODES,
    Index,
    bucket_catalog,
    load_index,
    store_objects,
    write_clustered,
)
from nearpath.plans.kmeans import fit_centres, with_clusters
from nearpath.plans.models import fit_node, hidden_layers, node_rows
from nearpath.sources.workdir import discard, settle, settle_in, work_dir

# Centres, or weights, of the nodes that are worked on together, in bytes.
BATCH_BYTES = 64 << 20


def node_sizes(placed: DataFrame, n_categories: int) -> DataFrame:
    """The nodes of a level: ``(path_key, path, n_rows, n_requested)``."""
    n = F.col("n_rows")
    asked = (
        F.when(n < 2, 1)
        .when(n < n_categories, F.greatest(F.lit(2), F.floor(n / 5)))
        .otherwise(n_categories)
    )
    return placed.groupBy("path_key", "path").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_requested", asked.cast("int"))


def cluster_level(
    rows: DataFrame, labelled: DataFrame, asked: dict[str, int], parameters: ModelParameters,
    seed: int,
) -> DataFrame:
    """Cluster all ``rows`` (id, v, path_key) of the nodes in ``asked``, and give
    the rows of ``labelled``, of the same nodes, their ``cluster``."""
    algorithm = parameters.clustering_algorithm
    if algorithm.label is not None:
        return _label_nodes(labelled, asked, algorithm.label)
    if algorithm.make is None:
        return with_clusters(labelled, fit_centres(rows, asked, algorithm.iterations, seed))
    features = F.col("features")
    parts = []
    for key, k in asked.items():
        own, wanted = (
            part.filter(F.col("path_key") == key)
            .withColumn("features", array_to_vector(as_doubles("v")))
            for part in (rows, labelled)
        )
        if k < 2:
            wanted = wanted.withColumn(LABEL, F.lit(0))
        else:
            wanted = algorithm.make(k).fit(own.select(features)).transform(wanted)
        parts.append(wanted.select(*labelled.columns, F.col(LABEL).cast("int").alias(LABEL)))
    return reduce(DataFrame.unionByName, parts)


def _label_nodes(labelled: DataFrame, asked: dict[str, int], label) -> DataFrame:
    """The user's function on the training rows of every node, one grouped job."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        k = asked[group.column("path_key")[0].as_py()]
        found = np.zeros(group.num_rows, np.int64)
        if k > 1:
            found = np.asarray(label(to_matrix(group.column("v")), k))
            if found.shape != (group.num_rows,) or found.min() < 0 or found.max() >= k:
                raise ValueError(f"a clustering function must give each row a number below {k}")
        return group.append_column(LABEL, pa.array(found.astype(np.int32)))

    kind = labelled.schema["v"].dataType.simpleString()
    return labelled.select("id", "v", "path_key").groupBy("path_key").applyInArrow(
        run, f"id long, v {kind}, path_key string, {LABEL} int")


def _training_rows(rows: DataFrame, sizes: DataFrame, train_rows: int) -> DataFrame:
    """About ``train_rows`` rows of each larger node, by hash of the id, and all
    rows of the others."""
    scale = 1 << 30
    share = F.least(F.lit(1.0), F.lit(float(train_rows)) / F.col("n_rows"))
    known = broadcast_catalog(sizes.select(F.col("path_key"), share.alias("_share")))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(scale))
    return rows.join(known, "path_key").filter(place < F.col("_share") * scale).select("id", "v", "path_key")


def _fit_nodes(labelled: DataFrame, sizes: DataFrame, parameters: ModelParameters) -> DataFrame:
    """One grouped fit a node."""
    rows = labelled.join(broadcast_catalog(sizes.select("path_key", "path", "n_requested")), "path_key")
    weights = dict(parameters.class_weights)
    own = MODEL_KINDS.get(parameters.model_type)

    def fit(group: pa.Table) -> pa.Table:
        # One order, so that a node does not depend on how its rows arrived.
        group = group.sort_by("id")
        return node_rows([fit_node(
            tuple(group.column("path")[0].as_py()), to_matrix(group.column("v")),
            group.column("cluster").to_numpy(), group.column("n_requested")[0].as_py(),
            parameters, weights, own,
        )])

    return rows.select("id", "v", "path_key", "path", "n_requested", "cluster").groupBy(
        "path_key").applyInArrow(fit, NODE_SCHEMA)


def _batches(sizes: list, bytes_per_class: int, fixed: int) -> list[list]:
    """Nodes in batches of at most ``BATCH_BYTES``."""
    out, room = [[]], BATCH_BYTES
    for row in sizes:
        need = row["n_requested"] * bytes_per_class + fixed
        if out[-1] and need > room:
            out.append([])
            room = BATCH_BYTES
        out[-1].append(row)
        room -= need
    return out


def _fit_level(
    spark: SparkSession, placed: DataFrame, parameters: ModelParameters, config: BuildConfig,
    dimension: int, target: str, clustered: str,
) -> float:
    """Write the nodes of a level to ``target``; the seconds spent on clusters."""
    sizes = settle(node_sizes(placed, parameters.n_categories), "node-sizes")
    hidden = hidden_layers(parameters.model_type)
    wide = (hidden or [dimension])[-1] + 1
    fixed = 8 * sum((a + 1) * b for a, b in zip([dimension, *hidden], hidden)) + 256
    held = HELD if config.train_rows is None else 1
    batches = _batches(
        sizes.orderBy("path_key").collect(), 8 * held * (dimension + wide), held * fixed)
    rows = placed.select("id", "v", "path_key")
    if len(batches) > 1:
        # By node, so that a batch skips what lies between others.
        write_clustered(rows, sizes.select(
            F.col("path_key").alias("path"), "path_key", F.col("n_rows").alias("n_objects")),
            clustered, dimension)
        rows = spark.read.schema(rows.schema).parquet(clustered)
    cluster_s = 0.0
    for batch in batches:
        asked = {row["path_key"]: row["n_requested"] for row in batch}
        own = rows
        if len(batches) > 1:
            own = rows.filter(F.col("path_key").isin(list(asked)))
        started = time.time()
        if config.train_rows is None:
            labelled, folder = settle_in(cluster_level(own, own, asked, parameters, config.seed).select(
                "v", "path_key", "cluster"), "labelled")
            cluster_s += time.time() - started
            fitted = fit_on_all_rows(labelled, batch, parameters, dimension)
            fitted.write.mode("append").parquet(target)
            discard(spark, folder)
            continue
        sample = _training_rows(own, sizes, config.train_rows)
        labelled = cluster_level(own, sample, asked, parameters, config.seed)
        cluster_s += time.time() - started
        _fit_nodes(labelled, sizes, parameters).write.mode("append").parquet(target)
    return cluster_s


def both_spaces(
    search_objects: DataFrame, placed: DataFrame, allow_unmatched: bool, folder: str
) -> DataFrame:
    """The vectors to compare with the paths of their ids, joined once and audited."""
    spark = placed.sparkSession
    placements = placed.select("id", "path", "path_key", F.lit(True).alias("placed"))
    vectors = search_objects.select("id", "v", F.lit(True).alias("given"))
    joined = vectors.join(placements, "id", "full")
    joined.write.parquet(folder)
    joined = spark.read.schema(joined.schema).parquet(folder)
    matched = F.col("placed").isNotNull() & F.col("given").isNotNull()
    if not allow_unmatched:
        lost = joined.agg(
            F.count_if(F.col("given").isNull()).alias("navigation"),
            F.count_if(F.col("placed").isNull()).alias("search"),
            F.min(F.when(~matched, F.col("id"))).alias("id")).first()
        if lost["navigation"] or lost["search"]:
            raise ValueError(
                f"{lost['navigation']} ids are only in objects and {lost['search']} only in "
                f"search_objects, the smallest is {lost['id']}; allow_unmatched leaves them out")
    return joined.filter(matched).select("id", "v", "path", "path_key")


def build_index(
    objects: DataFrame,
    config: BuildConfig,
    folder: str | None = None,
    search_objects: DataFrame | None = None,
    allow_unmatched: bool = False,
) -> Index:
    """Cluster, train and store an index over ``objects`` (id, v).

    ``search_objects`` is a second representation of the same ids that the
    search compares, while ``objects`` decides the buckets. An id that only one of
    them has is an error, or with ``allow_unmatched`` left out. The tables go to
    ``folder``, or to a new one in the shared working folder.
    """
    spark = objects.sparkSession
    started = time.time()
    folder = folder or work_dir(spark, "index")
    first = objects.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    if not first["n"]:
        raise ValueError("there are no objects to index")
    dimension, scratch = first["d"], work_dir(spark, "build")

    cluster_s = 0.0
    placed = objects.select(
        "id", "v", F.expr("cast(array() as array<int>)").alias("path"),
        F.lit(ROOT_KEY).alias("path_key"),
    )
    for level, parameters in enumerate(config.levels):
        target = f"{folder}/{NODES}/fit_level={level}"
        cluster_s += _fit_level(
            spark, placed, parameters, config, dimension, target, f"{scratch}/by-node-{level}")
        nodes = spark.read.schema(NODE_SCHEMA).parquet(target)
        if not config.allow_missing:
            missing = nodes.filter("n_predicted < n_classes").count()
            if missing:
                raise RuntimeError(f"{missing} nodes of level {level} do not predict all their classes")
        # Placed once, and read from there by everything that follows.
        where = f"{scratch}/placed-{level}"
        step_down(placed, nodes).write.parquet(where)
        placed = spark.read.schema(placed.schema).parquet(where)

    stored = placed
    if search_objects is not None:
        stored = both_spaces(search_objects, placed, allow_unmatched, f"{scratch}/both")
        first = {"n": stored.count()}
    bucket_catalog(stored.select("path", "path_key")).coalesce(1).write.parquet(f"{folder}/{BUCKETS}")
    buckets = spark.read.schema(BUCKET_SCHEMA).parquet(f"{folder}/{BUCKETS}")
    written = store_objects(stored, buckets, folder)
    if written != first["n"]:
        raise RuntimeError(f"{written} of {first['n']} objects were written")
    discard(spark, scratch)
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/{NODES}")
    size = nodes.agg(F.sum(F.size("weights") * 8 + 256)).first()[0]
    meta = (
        config.n_levels, written, buckets.count(), size,
        stored.schema["v"].dataType.elementType.simpleString(), time.time() - started, cluster_s,
    )
    spark.createDataFrame([meta], META_SCHEMA).coalesce(1).write.parquet(f"{folder}/{META}")
    return load_index(spark, folder)
