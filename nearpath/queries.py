"""The registered queries, each with the SQL that must give the same rows.

Every query reads the whole ``embeddings`` table: each vector is an object and
a query. Neighbours rank by exact distance; distances and probabilities are
reported to six decimals, for the comparison only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath import fixtures as fx
from nearpath.functions import paths, vectors
from nearpath.operators.knn import (
    bucket_candidates, candidate_counts, knn_brute_force, knn_in_buckets, knn_sweep,
)
from nearpath.operators.navigate import leaf_probabilities, navigate, rank_buckets
from nearpath.operators.recall import recall_at_k, recall_sweep
from nearpath.operators.score import (
    MODEL_KINDS, ModelKind, assign_paths, predict, predict_proba,
)
from nearpath.operators.topk import merge_top_k
from nearpath.plans.build import _fit_nodes, _training_rows, build_index, node_sizes
from nearpath.plans.clustering import ClusteringAlgorithm, k_means
from nearpath.plans.config import BuildConfig
from nearpath.plans.experiment import ExperimentConfig, buckets_to_visit, run_experiment
from nearpath.plans.index import Index, attach_paths, bucket_catalog, load_index, node_catalog
from nearpath.plans.kmeans import fit_centres, with_clusters
from nearpath.plans.models import HIDDEN_LAYERS
from nearpath.sources.results import write_neighbors
from nearpath.sources.vectors import align_vectors, read_ground_truth, read_vectors, with_row_ids
from nearpath.sources.workdir import settle, work_dir

K = 10
N_BUCKETS = 4
PERCENTAGES = (4, 10, 20, 50, 100)

LEARNED = BuildConfig("scikit_kmeans", 40, "MLP-6", 0.01, [5, 3])


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def _register(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(run, " ".join(sql.split()) if sql else None)
        return run

    return add


def _zero(expression: str) -> str:
    """Six decimals in SQL, without a negative zero."""
    return f"(CASE WHEN round({expression}, 6) = 0 THEN 0.0 ELSE round({expression}, 6) END)"


def _six(column) -> Column:
    rounded = F.round(column, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


# --- SQL shared by the oracles -------------------------------------------------

E = """
e AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS c1,
         vec_id % 3 AS c2, (vec_id // 3) % 2 AS c3, (vec_id // 6) % 2 AS c4
  FROM embeddings)"""

# The reduced representation, under the same columns.
FOLDED = """
e0 AS (
  SELECT vec_id AS id, label, vec_id % 3 AS c2, (vec_id // 3) % 2 AS c3,
         list_transform(generate_series(0, len(embedding) // 4 - 1),
           lambda j: CAST(embedding[4*j+1] AS DOUBLE) + CAST(embedding[4*j+2] AS DOUBLE)
              + CAST(embedding[4*j+3] AS DOUBLE) + CAST(embedding[4*j+4] AS DOUBLE)) AS w
  FROM embeddings),
e AS (
  SELECT id, label AS c1, c2, c3,
         list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v
  FROM e0)"""

SCALED = """
s AS (
  SELECT vec_id AS id,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + label / 4.0)) AS v
  FROM embeddings)"""


def _level(level: int) -> str:
    """Means of the classes of one level and their probabilities per query."""
    keys = ", ".join(f"c{i}" for i in range(1, level + 1))
    return f"""
m{level} AS (
  SELECT {keys}, list(x ORDER BY i) AS m FROM (
    SELECT {keys}, i, avg(x) AS x FROM (
      SELECT {keys}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) AS u
    GROUP BY {keys}, i) AS a
  GROUP BY {keys}),
x{level} AS (
  SELECT e.id AS query_id, {", ".join(f"m.c{i}" for i in range(1, level + 1))},
         exp(10 * list_inner_product(e.v, m.m)) AS w
  FROM e, m{level} AS m),
p{level} AS (
  SELECT query_id, {keys},
         w / sum(w) OVER (PARTITION BY query_id{"".join(f", c{i}" for i in range(1, level))})
           AS p{level}
  FROM x{level})"""


def _visits(n_levels: int, order: str, n_buckets: int | None, vectors_sql: str = E) -> str:
    joins = "".join(
        f" JOIN p{level} USING (query_id, {', '.join(f'c{i}' for i in range(1, level))})"
        for level in range(2, n_levels + 1)
    )
    key = " || '_' || ".join(f"c{i}" for i in range(1, n_levels + 1))
    probs = ", ".join(f"p{i}" for i in range(1, n_levels + 1))
    limit = "" if n_buckets is None else f"WHERE bucket_rank <= {n_buckets}"
    path = ", ".join(f"c{i}" for i in range(1, n_levels + 1))
    return f"""{vectors_sql},{",".join(_level(i) for i in range(1, n_levels + 1))},
r AS (
  SELECT query_id, 'b' || {key} AS path_key, {probs},
         row_number() OVER (PARTITION BY query_id ORDER BY {order}, {path}) AS bucket_rank
  FROM p1{joins}),
visits AS (SELECT * FROM r {limit})"""


FLAT = "p1 DESC"
TWO_LEVEL = "least(p1, p2) DESC, p2 DESC"
THREE_LEVEL = "least(p1, p2, p3) DESC, least(p2, p3) DESC, p3 DESC"
FOUR_LEVEL = (
    "least(p1, p2, p3, p4) DESC, least(p2, p3, p4) DESC, least(p3, p4) DESC, p4 DESC"
)
JOINT = "p1 * p2 DESC"

PLACED = "o AS (SELECT id, v, 'b' || c1 || '_' || c2 AS path_key FROM e)"

COSINE = (
    "1 - list_inner_product(q.v, o.v)"
    " / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(o.v, o.v)))"
)
INNER = "1 - list_inner_product(q.v, o.v)"

NEIGHBORS = "query_id, rank, neighbor_id, distance"


def _brute(name: str, table: str, distance: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, neighbor_id, rank, {_zero("exact")} AS distance FROM (
    SELECT query_id, neighbor_id, exact,
           row_number() OVER (PARTITION BY query_id ORDER BY exact, neighbor_id) AS rank
    FROM (SELECT q.id AS query_id, o.id AS neighbor_id, {distance} AS exact
          FROM {table} AS q, {table} AS o) AS d) AS t
  WHERE rank <= {K})"""


def _bucketed(name: str, distance: str, queries: str = "e", objects: str = "o",
              condition: str = "TRUE", by: str = "") -> str:
    return f"""
{name} AS (
  SELECT {by}query_id, neighbor_id, rank, {_zero("exact")} AS distance FROM (
    SELECT {by}query_id, neighbor_id, exact,
           row_number() OVER (PARTITION BY {by}query_id ORDER BY exact, neighbor_id) AS rank
    FROM (SELECT {by}visits.query_id, o.id AS neighbor_id, {distance} AS exact
          FROM visits JOIN {objects} AS o USING (path_key)
               JOIN {queries} AS q ON q.id = visits.query_id
               {"JOIN n ON visits.bucket_rank <= n.n_buckets" if by else ""}) AS d) AS t
  WHERE rank <= {K})"""


BRUTE_COSINE = f"WITH {E},{_brute('t', 'e', COSINE)} SELECT {NEIGHBORS} FROM t"
VISITS_TWO = _visits(2, TWO_LEVEL, N_BUCKETS)


def _reported(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", _six("distance"))


# --- sources and sinks ---------------------------------------------------------


def _described(rows: DataFrame) -> DataFrame:
    """Id, dimension and the sum of the values of each vector."""
    total = F.aggregate(vectors.as_doubles("v"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("v").alias("dimension"), _six(total).alias("total"))


@_register("scan_vectors", f"""
SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dimension,
       {_zero("list_sum(CAST(embedding AS DOUBLE[]))")} AS total
FROM embeddings""")
def scan_vectors(spark, sf_dir):
    return _described(read_vectors(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding"))


@_register("scan_second_representation", f"""
WITH {SCALED}
SELECT e.vec_id AS id, CAST(len(s.v) AS INTEGER) AS dimension,
       {_zero("list_inner_product(CAST(e.embedding AS DOUBLE[]), s.v)")} AS agreement
FROM embeddings AS e JOIN s ON s.id = e.vec_id""")
def scan_second_representation(spark, sf_dir):
    both = align_vectors(fx.objects(spark, sf_dir), fx.scaled_objects(spark, sf_dir))
    return both.select(
        "id",
        F.size("v_search").alias("dimension"),
        _six(vectors.dot("v", "v_search")).alias("agreement"),
    )


@_register("ground_truth", f"""
WITH {E},{_brute('t', 'e', COSINE)} SELECT query_id, rank, neighbor_id FROM t""")
def ground_truth(spark, sf_dir):
    """True neighbours stored as one array per query, then read as rows."""
    objects = fx.objects(spark, sf_dir)
    found = knn_brute_force(fx.as_queries(objects), objects, K)
    arrays = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))).alias("best")
    )
    folder = work_dir(spark, "truth")
    arrays.select("query_id", F.col("best.neighbor_id").alias("knns")).write.parquet(folder)
    return read_ground_truth(spark, folder)


@_register("store_results", BRUTE_COSINE)
def store_results(spark, sf_dir):
    objects = fx.objects(spark, sf_dir)
    found = knn_brute_force(fx.as_queries(objects), objects, K)
    return _reported(write_neighbors(found, work_dir(spark, "results"), "brute").select(
        "query_id", "rank", "neighbor_id", "distance"
    ))


@_register("row_ids", """
SELECT row_number() OVER (ORDER BY label, vec_id) AS id, vec_id, label FROM embeddings""")
def row_ids(spark, sf_dir):
    rows = fx.embeddings(spark, sf_dir).select("vec_id", "label")
    return with_row_ids(rows, "label", "vec_id")


# --- vector and path functions -------------------------------------------------


@_register("l2_normalize", f"""
WITH {SCALED},
u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v,
             sqrt(list_inner_product(v, v)) AS norm FROM s)
SELECT id, {_zero("norm")} AS norm, {_zero("list_sum(v)")} AS total,
       {_zero("sqrt(list_inner_product(v, v))")} AS unit
FROM u""")
def l2_normalize(spark, sf_dir):
    scaled = fx.scaled_objects(spark, sf_dir)
    unit = scaled.select(
        "id", vectors.norm("v").alias("norm"), vectors.l2_normalize("v").alias("v")
    )
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return unit.select(
        "id", _six("norm").alias("norm"), _six(total).alias("total"),
        _six(vectors.norm("v")).alias("unit"),
    )


@_register("vector_distances", f"""
WITH {E}, {SCALED}, {_level(1)}
SELECT s.id, {_zero(COSINE.replace("q.v", "s.v").replace("o.v", "m1.m"))} AS cosine,
       {_zero(INNER.replace("q.v", "s.v").replace("o.v", "m1.m"))} AS inner_product
FROM s JOIN e ON e.id = s.id JOIN m1 ON m1.c1 = e.c1""")
def vector_distances(spark, sf_dir):
    """Distances of every vector to the mean of its label, as column functions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    table = fx.embeddings(spark, sf_dir)
    means = (
        table.groupBy("label")
        .agg(Summarizer.mean(array_to_vector(vectors.as_doubles("embedding"))).alias("m"))
        .select("label", vector_to_array("m").alias("m"))
    )
    labels = table.select(F.col("vec_id").alias("id"), "label")
    rows = fx.scaled_objects(spark, sf_dir).join(labels, "id").join(means, "label")
    return rows.select(
        "id",
        _six(vectors.cosine_distance("v", "m")).alias("cosine"),
        _six(vectors.inner_product_distance("v", "m")).alias("inner_product"),
    )


@_register("path_match", """
SELECT vec_id AS id, label = 3 AND vec_id % 3 = 1 AS is_path, label = 3 AS has_prefix
FROM embeddings""")
def path_match(spark, sf_dir):
    return fx.assignments(spark, sf_dir, 2).select(
        "id",
        paths.path_equals("path", [3, 1]).alias("is_path"),
        paths.path_starts_with("path", [3]).alias("has_prefix"),
    )


@_register("path_roundtrip", """
SELECT vec_id AS id, label || '.' || (vec_id % 3) AS dotted,
       'b' || label || '_' || (vec_id % 3) AS path_key,
       label || ',' || (vec_id % 3) || ',-1,-1' AS padded, TRUE AS same
FROM embeddings""")
def path_roundtrip(spark, sf_dir):
    rows = fx.assignments(spark, sf_dir, 2).withColumn("wide", paths.pad("path", 4))
    rows = rows.withColumn("dotted", paths.serialize_path("wide"))
    back = paths.deserialize_path("dotted", 4)
    return rows.select(
        "id",
        "dotted",
        "path_key",
        F.concat_ws(",", back.cast("array<string>")).alias("padded"),
        (paths.unpad(back) == F.col("path")).alias("same"),
    )


# --- catalogues ----------------------------------------------------------------


@_register("bucket_catalog", """
SELECT 'b' || label || '_' || (vec_id % 3) AS path_key, count(*) AS n_objects
FROM embeddings GROUP BY ALL""")
def buckets(spark, sf_dir):
    return bucket_catalog(fx.assignments(spark, sf_dir, 2)).select("path_key", "n_objects")


@_register("node_catalog", """
SELECT 'b' || label AS path_key, count(*) AS n_objects FROM embeddings GROUP BY ALL""")
def nodes(spark, sf_dir):
    return node_catalog(fx.assignments(spark, sf_dir, 2), 1).select("path_key", "n_objects")


@_register("class_count", """
SELECT label AS parent, count(DISTINCT vec_id % 3) AS n_classes FROM embeddings GROUP BY label""")
def class_count(spark, sf_dir):
    placed = fx.assignments(spark, sf_dir, 2)
    return placed.groupBy(F.col("path")[0].alias("parent")).agg(
        F.countDistinct(F.col("path")[1]).alias("n_classes")
    )


# --- scoring and navigation ----------------------------------------------------


@_register("predict_proba", f"""
WITH {E},{_level(1)}
SELECT query_id, CAST(c1 AS INTEGER) AS class, {_zero("p1")} AS prob,
       row_number() OVER (PARTITION BY query_id ORDER BY p1 DESC, c1) AS class_rank
FROM p1""")
def proba(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 1)
    return predict_proba(tree.queries, tree.nodes).select(
        "query_id", "class", _six("prob").alias("prob"), "class_rank"
    )


@_register("predict", f"""
WITH {E},{_level(1)}
SELECT query_id, CAST(arg_max(c1, p1) AS INTEGER) AS class FROM p1 GROUP BY query_id""")
def predicted(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 1)
    return predict(tree.queries, tree.nodes).select("query_id", "class")


@_register("assign_paths", f"""
WITH {E},{_level(1)},{_level(2)},
top1 AS (SELECT query_id, arg_max(c1, p1) AS c1 FROM p1 GROUP BY query_id)
SELECT query_id AS id, 'b' || c1 || '_' || arg_max(c2, p2) AS path_key
FROM p2 JOIN top1 USING (query_id, c1) GROUP BY query_id, c1""")
def assigned(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 2)
    return assign_paths(tree.vectors, tree.nodes).select("id", "path_key")


def _order(visits: DataFrame, n_levels: int) -> DataFrame:
    probs = [_six(F.get("probs", F.lit(i))).alias(f"p{i + 1}") for i in range(n_levels)]
    return visits.select("query_id", "bucket_rank", "path_key", *probs)


def _order_sql(n_levels: int, order: str, n_buckets: int | None) -> str:
    probs = ", ".join(f"{_zero(f'p{i}')} AS p{i}" for i in range(1, n_levels + 1))
    return f"""WITH {_visits(n_levels, order, n_buckets)}
SELECT query_id, bucket_rank, path_key, {probs} FROM visits"""


def _relational_order(spark, sf_dir, n_levels, n_buckets, score="conditional"):
    """Scores as rows, joined level by level and ranked."""
    tree = fx.FixtureTree(spark, sf_dir, n_levels)
    scores = predict_proba(tree.queries, tree.nodes)
    leaves = leaf_probabilities(scores, tree.buckets, n_levels)
    return _order(rank_buckets(leaves, n_buckets, score), n_levels)


@_register("nav_order_flat", _order_sql(1, FLAT, N_BUCKETS))
def nav_order_flat(spark, sf_dir):
    return _relational_order(spark, sf_dir, 1, N_BUCKETS)


@_register("nav_order_two_level", _order_sql(2, TWO_LEVEL, 6))
def nav_order_two_level(spark, sf_dir):
    return _relational_order(spark, sf_dir, 2, 6)


@_register("nav_order_all_buckets", _order_sql(2, TWO_LEVEL, None))
def nav_order_all_buckets(spark, sf_dir):
    return _relational_order(spark, sf_dir, 2, None)


@_register("nav_order_three_level", _order_sql(3, THREE_LEVEL, 6))
def nav_order_three_level(spark, sf_dir):
    """The same order from the scan that scores whole paths inside its tasks."""
    tree = fx.FixtureTree(spark, sf_dir, 3)
    return _order(navigate(tree.queries, tree.nodes, tree.buckets, 6), 3)


@_register("nav_order_four_level", _order_sql(4, FOUR_LEVEL, 6))
def nav_order_four_level(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 4)
    return _order(navigate(tree.queries, tree.nodes, tree.buckets, 6), 4)


# Even labels are buckets, odd ones go on.
RAGGED = f"""
WITH {E},{_level(1)},{_level(2)},
leaves AS (
  SELECT query_id, 'b' || c1 AS path_key, c1, NULL AS c2, p1, NULL AS p2 FROM p1 WHERE c1 % 2 = 0
  UNION ALL
  SELECT query_id, 'b' || c1 || '_' || c2, c1, c2, p1, p2
  FROM p1 JOIN p2 USING (query_id, c1) WHERE c1 % 2 = 1),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY least(p1, coalesce(p2, p1)) DESC, p2 DESC NULLS LAST, c1, c2) AS bucket_rank
  FROM leaves)
SELECT query_id, bucket_rank, path_key, {_zero("p1")} AS p1, {_zero("p2")} AS p2
FROM r WHERE bucket_rank <= 8"""


@_register("nav_order_ragged", RAGGED)
def nav_order_ragged(spark, sf_dir):
    """Buckets that end at different levels, from the scan of whole paths."""
    tree = fx.FixtureTree(spark, sf_dir, 2, ragged=True)
    return _order(navigate(tree.queries, tree.nodes, tree.buckets, 8), 2)


@_register("nav_order_ragged_joined", RAGGED)
def nav_order_ragged_joined(spark, sf_dir):
    """The same from the form for trees too large to broadcast."""
    tree = fx.FixtureTree(spark, sf_dir, 2, ragged=True)
    scores = predict_proba(tree.queries, tree.nodes, broadcast_bytes=2_000)
    return _order(rank_buckets(leaf_probabilities(scores, tree.buckets, 2), 8), 2)


@_register("nav_order_joint", _order_sql(2, JOINT, 6))
def nav_order_joint(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 2)
    return _order(navigate(tree.queries, tree.nodes, tree.buckets, 6, score="joint"), 2)


# --- search --------------------------------------------------------------------


@_register("knn_brute_cosine", BRUTE_COSINE)
def knn_brute_cosine(spark, sf_dir):
    objects = fx.objects(spark, sf_dir)
    return _reported(knn_brute_force(fx.as_queries(objects), objects, K))


@_register("knn_brute_inner_product",
           f"WITH {SCALED},{_brute('t', 's', INNER)} SELECT {NEIGHBORS} FROM t")
def knn_brute_inner_product(spark, sf_dir):
    objects = fx.scaled_objects(spark, sf_dir)
    return _reported(knn_brute_force(fx.as_queries(objects), objects, K, metric="inner_product"))


@_register("knn_brute_grid", BRUTE_COSINE)
def knn_brute_grid(spark, sf_dir):
    """The form for query sets too large for one broadcast, over small blocks."""
    objects = fx.objects(spark, sf_dir)
    return _reported(
        knn_brute_force(fx.as_queries(objects), objects, K, broadcast_bytes=100_000))


TINY = """
s AS (
  SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 5e-4) AS v
  FROM embeddings)"""

NEAR = """
f AS (SELECT CAST(embedding AS DOUBLE[]) AS f FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (
  SELECT vec_id AS id,
         list_transform(list_zip(f.f, CAST(embedding AS DOUBLE[])), lambda x: x[1] + x[2] * 3e-4) AS v
  FROM embeddings, f)"""


@_register("knn_brute_tiny_norms",
           f"WITH {TINY},{_brute('t', 's', INNER)} SELECT {NEIGHBORS} FROM t")
def knn_brute_tiny_norms(spark, sf_dir):
    """All distances are 1 to six decimals; the order is still the exact one."""
    objects = fx.tiny_objects(spark, sf_dir)
    return _reported(knn_brute_force(fx.as_queries(objects), objects, K, metric="inner_product"))


@_register("knn_brute_near_copies",
           f"WITH {NEAR},{_brute('t', 's', COSINE)} SELECT {NEIGHBORS} FROM t")
def knn_brute_near_copies(spark, sf_dir):
    """All distances are 0 to six decimals; the order is still the exact one."""
    objects = fx.near_copies(spark, sf_dir)
    return _reported(knn_brute_force(fx.as_queries(objects), objects, K))


@_register("objects_in_buckets", f"""
WITH {E}, {PLACED}
SELECT id, path_key, CAST(len(v) AS INTEGER) AS dimension FROM o""")
def objects_in_buckets(spark, sf_dir):
    placed = attach_paths(fx.objects(spark, sf_dir), fx.assignments(spark, sf_dir, 2))
    return placed.select("id", "path_key", F.size("v").alias("dimension"))


@_register("bucket_candidates", f"""
WITH {VISITS_TWO}, {PLACED}
SELECT query_id, CAST(count(*) AS BIGINT) AS n_candidates
FROM visits JOIN o USING (path_key) GROUP BY query_id""")
def candidates(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 2)
    visits = navigate(tree.queries, tree.nodes, tree.buckets, N_BUCKETS)
    return candidate_counts(visits, tree.buckets)


def _fixture_search(tree: fx.FixtureTree, **options) -> DataFrame:
    visits = navigate(tree.queries, tree.nodes, tree.buckets, N_BUCKETS)
    placed = attach_paths(tree.vectors, tree.assignments)
    return _reported(knn_in_buckets(visits, tree.queries, placed, K, **options))


BUCKETED = f"WITH {VISITS_TWO}, {PLACED},{_bucketed('t', COSINE)} SELECT {NEIGHBORS} FROM t"


@_register("knn_bucketed", BUCKETED)
def knn_bucketed(spark, sf_dir):
    return _fixture_search(fx.FixtureTree(spark, sf_dir, 2))


@_register("knn_bucketed_grid", BUCKETED)
def knn_bucketed_grid(spark, sf_dir):
    """The form for query sets too large for one broadcast."""
    return _fixture_search(fx.FixtureTree(spark, sf_dir, 2), broadcast_bytes=100_000)


def _partial(spark, sf_dir, **options) -> DataFrame:
    """More visits than queries: each visit once more, for a query that is not there."""
    tree = fx.FixtureTree(spark, sf_dir, 2)
    visits = navigate(tree.queries, tree.nodes, tree.buckets, N_BUCKETS).select(
        "query_id", "bucket_rank", "path_key")
    absent = [visits.withColumn("query_id", F.col("query_id") * sign + 1_000_003 * sign)
              for sign in (1, -1)]
    visits = visits.unionByName(absent[0]).unionByName(absent[1])
    placed = attach_paths(tree.vectors, tree.assignments)
    return _reported(knn_in_buckets(visits, tree.queries, placed, K, **options))


@_register("knn_partial_queries", BUCKETED)
def knn_partial_queries(spark, sf_dir):
    return _partial(spark, sf_dir)


@_register("knn_partial_queries_blocks", BUCKETED)
def knn_partial_queries_blocks(spark, sf_dir):
    return _partial(spark, sf_dir, broadcast_bytes=100_000)


@_register("knn_single_bucket", f"""
WITH {VISITS_TWO}, {PLACED},
t AS (
  SELECT query_id, bucket_rank, rank, neighbor_id, {_zero("exact")} AS distance FROM (
    SELECT query_id, bucket_rank, neighbor_id, exact,
           row_number() OVER (PARTITION BY query_id, bucket_rank
                              ORDER BY exact, neighbor_id) AS rank
    FROM (SELECT visits.query_id, visits.bucket_rank, o.id AS neighbor_id,
                 {COSINE} AS exact
          FROM visits JOIN o USING (path_key) JOIN e AS q ON q.id = visits.query_id) AS d) AS w
  WHERE rank <= {K})
SELECT query_id, bucket_rank, rank, neighbor_id, distance FROM t""")
def knn_single_bucket(spark, sf_dir):
    """The k best of every visited bucket, before the merge over buckets."""
    tree = fx.FixtureTree(spark, sf_dir, 2)
    visits = navigate(tree.queries, tree.nodes, tree.buckets, N_BUCKETS)
    placed = attach_paths(tree.vectors, tree.assignments)
    found = bucket_candidates(visits, tree.queries, placed, K, per_bucket=True)
    return _reported(merge_top_k(found, K, "query_id", "bucket_rank"))


@_register("knn_two_space", f"""
WITH {_visits(2, TWO_LEVEL, N_BUCKETS, FOLDED)}, {SCALED},
o AS (SELECT s.id, s.v, 'b' || c1 || '_' || c2 AS path_key FROM s JOIN e ON e.id = s.id),
{_bucketed('t', INNER, queries='s')}
SELECT {NEIGHBORS} FROM t""")
def knn_two_space(spark, sf_dir):
    """Navigate with the reduced vectors, compare the full ones as they are."""
    tree = fx.FixtureTree(spark, sf_dir, 2, reduced=True)
    compared = fx.scaled_objects(spark, sf_dir)
    visits = navigate(tree.queries, tree.nodes, tree.buckets, N_BUCKETS)
    placed = attach_paths(compared, tree.assignments)
    return _reported(
        knn_in_buckets(visits, fx.as_queries(compared), placed, K, metric="inner_product"))


# --- recall --------------------------------------------------------------------


@_register("recall_at_k", f"""
WITH {VISITS_TWO}, {PLACED},{_bucketed('f', COSINE)},{_brute('t', 'e', COSINE)}
SELECT count(DISTINCT t.query_id) AS n_queries, count(f.neighbor_id) AS hits,
       count(f.neighbor_id) / (count(DISTINCT t.query_id) * {K}.0) AS recall
FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.neighbor_id = t.neighbor_id""")
def recall(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 2)
    truth = knn_brute_force(tree.queries, tree.vectors, K)
    return recall_at_k(_fixture_search(tree), truth, K)


@_register("recall_sweep", f"""
WITH {_visits(2, TWO_LEVEL, None)}, {PLACED},
n AS (SELECT DISTINCT CAST(floor(p / 100.0 * (SELECT count(DISTINCT path_key) FROM o)) AS BIGINT)
             AS n_buckets
      FROM (SELECT unnest([{", ".join(map(str, PERCENTAGES))}]) AS p) AS u),
{_bucketed('f', COSINE, by='n_buckets, ')},{_brute('t', 'e', COSINE)}
SELECT n_buckets, count(DISTINCT t.query_id) AS n_queries, count(f.neighbor_id) AS hits,
       count(f.neighbor_id) / (count(DISTINCT t.query_id) * {K}.0) AS recall
FROM (SELECT n_buckets, t.query_id, t.neighbor_id FROM t, n WHERE n_buckets > 0) AS t
     LEFT JOIN f USING (n_buckets, query_id, neighbor_id)
GROUP BY n_buckets""")
def sweep(spark, sf_dir):
    tree = fx.FixtureTree(spark, sf_dir, 2)
    numbers = buckets_to_visit(PERCENTAGES, tree.buckets.count())
    visits = navigate(tree.queries, tree.nodes, tree.buckets, max(numbers))
    placed = attach_paths(tree.vectors, tree.assignments)
    found = knn_sweep(visits, tree.queries, placed, numbers, K)
    truth = knn_brute_force(tree.queries, tree.vectors, K)
    return recall_sweep(found, truth, numbers, K)


# --- trained indexes -----------------------------------------------------------

_BUILT: dict[tuple[str, str], Index] = {}


def learned_index(spark: SparkSession, sf_dir: str) -> Index:
    """A trained two-level index over all embeddings, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = build_index(fx.objects(spark, sf_dir), LEARNED)
    return _BUILT[key]


def _kmeans(spark, sf_dir, name: str) -> DataFrame:
    """Each row with its cluster, and whether no other centre is nearer."""
    rows = fx.objects(spark, sf_dir).withColumn("path_key", F.lit("b"))
    config = BuildConfig(name, 1, "logistic", 0.01, [5])
    algorithm = config.levels[0].clustering_algorithm
    centres = fit_centres(rows, {"b": 5}, algorithm.iterations)
    v = vectors.as_doubles("v")
    distances = F.array(*(
        F.aggregate(F.zip_with(v, F.array(*map(F.lit, centre)), lambda a, b: (a - b) * (a - b)),
                    F.lit(0.0), lambda total, x: total + x)
        for centre in centres["b"].tolist()
    ))
    own = F.element_at(distances, F.col("cluster") + 1)
    return with_clusters(rows, centres).select(
        "id", (own <= F.array_min(distances) + 1e-9).alias("nearest"))


NEAREST = "SELECT vec_id AS id, TRUE AS nearest FROM embeddings"


@_register("kmeans_partition", NEAREST)
def kmeans_partition(spark, sf_dir):
    return _kmeans(spark, sf_dir, "scikit_kmeans")


@_register("kmeans_partition_first", NEAREST)
def kmeans_partition_first(spark, sf_dir):
    return _kmeans(spark, sf_dir, "faiss_kmeans")


@_register("kmeans_fixed_point", """
SELECT count(*) AS n_rows, TRUE AS centres_are_means, CAST(0 AS BIGINT) AS n_moved FROM embeddings""")
def kmeans_fixed_point(spark, sf_dir):
    """Centres that no longer move: each is the mean of the rows nearest to it, by
    an average of their components that shares nothing with the fit."""
    rows = fx.embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), vectors.as_doubles("embedding").alias("v"),
        F.lit("b").alias("path_key"))
    centres = fit_centres(rows, {"b": K}, iterations=500)
    held = spark.createDataFrame(
        [(c, i, float(x)) for c, row in enumerate(centres["b"]) for i, x in enumerate(row)],
        "cluster int, i int, x double")
    labelled = with_clusters(rows, centres)
    means = labelled.select("cluster", F.posexplode("v").alias("i", "y")).groupBy(
        "cluster", "i").agg(F.avg("y").alias("mean"))
    off = held.join(means, ["cluster", "i"], "full").agg(
        F.bool_and(F.coalesce(F.abs(F.col("x") - F.col("mean")) < 1e-9, F.lit(False))).alias("m"))
    centre = F.collect_list(F.struct("i", "x"))
    as_vectors = held.groupBy("cluster").agg(F.array_sort(centre)["x"].alias("c"))  # K rows
    squared = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                          lambda total, d: total + d)
    moved = (
        labelled.join(F.broadcast(as_vectors.withColumnRenamed("cluster", "other")))
        .groupBy("id", "cluster").agg(F.min_by("other", squared).alias("nearest"))
        .agg(F.count_if(F.col("nearest") != F.col("cluster")).alias("n_moved"),
             F.count(F.lit(1)).alias("n_rows"))
    )
    return moved.join(F.broadcast(off)).select(
        "n_rows", F.col("m").alias("centres_are_means"), "n_moved")


@_register("node_requests", """
SELECT 'b' || label AS path_key, count(*) AS n_rows,
       CAST(CASE WHEN count(*) < 2 THEN 1
                 WHEN count(*) < 60 THEN greatest(2, count(*) // 5) ELSE 60 END AS INTEGER)
         AS n_requested
FROM embeddings GROUP BY label""")
def node_requests(spark, sf_dir):
    """How many classes each node is asked for: fewer where it holds few rows."""
    return node_sizes(fx.assignments(spark, sf_dir, 1), 60).drop("path")


def _labelled(spark, sf_dir):
    """All embeddings as one node whose clusters are their labels."""
    rows = fx.embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"),
        F.expr("cast(array() as array<int>)").alias("path"), F.lit("b").alias("path_key"),
        F.col("label").cast("int").alias("cluster"))
    sizes = node_sizes(rows, 10)
    sample = _training_rows(rows, sizes, 50_000).join(rows.select("id", "cluster"), "id")
    return rows, sizes, sample


@_register("model_presets", f"""
SELECT p.preset, p.hidden || (SELECT count(DISTINCT label) FROM embeddings) AS layers, TRUE AS covered
FROM (VALUES {", ".join(
    f"('{name}', '" + "".join(f"{n}," for n in hidden) + "')" for name, hidden in HIDDEN_LAYERS.items())})
  AS p(preset, hidden)""")
def model_presets(spark, sf_dir):
    """Every preset fitted on all embeddings; each predicts every class."""
    _, sizes, sample = _labelled(spark, sf_dir)
    out = None
    for name in HIDDEN_LAYERS:
        parameters = BuildConfig("scikit_kmeans", 80, name, 0.03, [10]).levels[0]
        nodes = _fit_nodes(sample, sizes, parameters).select(
            F.lit(name).alias("preset"),
            F.concat_ws(",", F.slice("layers", 2, F.size("layers") - 1).cast("array<string>"))
            .alias("layers"),
            (F.col("n_predicted") == F.col("n_classes")).alias("covered"))
        out = nodes if out is None else out.unionByName(nodes)
    return out


@_register("class_weights", "SELECT TRUE AS more_rows, count(*) AS n FROM embeddings")
def class_weights(spark, sf_dir):
    """A class with a large weight is predicted for more rows."""
    rows, sizes, sample = _labelled(spark, sf_dir)
    counts = []
    for weights in (None, {0: 200.0}):
        config = BuildConfig("scikit_kmeans", 20, "logistic", 0.01, [10], class_weights=weights)
        nodes = _fit_nodes(sample, sizes, config.levels[0])
        found = predict(rows.select(F.col("id").alias("query_id"), "v"), nodes)
        counts.append(found.agg(
            F.count_if(F.col("class") == 0).alias(f"n{len(counts)}"), F.count("*").alias(f"all{len(counts)}")))
    return counts[0].join(F.broadcast(counts[1])).select(
        (F.col("n1") > F.col("n0")).alias("more_rows"), F.col("all0").alias("n"))


@_register("index_single_level", """
SELECT count(*) AS n_objects, CAST(1 AS INTEGER) AS n_levels, TRUE AS two_classes FROM embeddings""")
def index_single_level(spark, sf_dir):
    """One level, with a registered clustering that knows two clusters only."""
    halves = ClusteringAlgorithm(lambda k: k_means(2))
    index = build_index(fx.objects(spark, sf_dir), BuildConfig(halves, 5, "logistic", 0.01, [4]))
    return index.buckets.agg(
        F.sum("n_objects").alias("n_objects"), F.max(F.size("path")).alias("n_levels"),
        (F.count("*") == 2).alias("two_classes"))


@_register("index_per_level", """
SELECT level, n_nodes, asked, covered FROM (VALUES
  (CAST(0 AS INTEGER), TRUE, CAST(3 AS INTEGER), TRUE), (1, TRUE, 2, TRUE)) AS t(level, n_nodes, asked, covered)""")
def index_per_level(spark, sf_dir):
    """Parameters of their own at each level; every node predicts what it was trained with."""
    config = BuildConfig(
        ["scikit_kmeans", "faiss_kmeans"], [10, 5], ["MLP-8", "logistic"], [0.01, 0.02], [3, 2])
    nodes = build_index(fx.objects(spark, sf_dir), config).nodes
    return nodes.groupBy("level").agg(
        (F.count("*") <= F.when(F.col("level") == 0, 1).otherwise(3)).alias("n_nodes"),
        F.max("n_requested").alias("asked"),
        F.every(F.col("n_predicted") == F.col("n_classes")).alias("covered"))


@_register("index_all_rows", """
SELECT vec_id AS id, CAST(2 AS INTEGER) AS depth, TRUE AS covered, TRUE AS has_path FROM embeddings""")
def index_all_rows(spark, sf_dir):
    """Classifiers trained on all rows of their nodes predict every class, and place
    every object where they predict it."""
    objects = fx.objects(spark, sf_dir)
    index = build_index(objects, BuildConfig(
        "scikit_kmeans", 15, "MLP-8", 0.01, [4, 3], train_rows=None))
    again = assign_paths(objects, index.nodes).select("id", F.col("path_key").alias("again"))
    covered = index.nodes.agg(F.every(F.col("n_predicted") == F.col("n_classes"))).first()[0]
    return index.assignments.join(again, "id").select(
        "id", F.size("path").alias("depth"), F.lit(covered).alias("covered"),
        (F.col("path_key") == F.col("again")).alias("has_path"))


@_register("index_build", """
SELECT vec_id AS id, CAST(1 AS BIGINT) AS n_paths, CAST(2 AS INTEGER) AS depth,
       TRUE AS in_catalog
FROM embeddings""")
def index_build(spark, sf_dir):
    """Every object has one path of full depth that ends in a listed bucket."""
    index = learned_index(spark, sf_dir)
    known = index.buckets.select("path_key", F.lit(True).alias("listed"))
    return (
        index.assignments.join(F.broadcast(known), "path_key", "left")
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("n_paths"),
            F.max(F.size("path")).alias("depth"),
            F.every(F.coalesce("listed", F.lit(False))).alias("in_catalog"),
        )
    )


@_register("learned_assignment", """
SELECT vec_id AS id, TRUE AS same FROM embeddings""")
def learned_assignment(spark, sf_dir):
    """The stored bucket is where the node models send the object."""
    index = learned_index(spark, sf_dir)
    again = assign_paths(fx.objects(spark, sf_dir), index.nodes).select(
        "id", F.col("path_key").alias("again")
    )
    return index.assignments.join(again, "id").select(
        "id", (F.col("path_key") == F.col("again")).alias("same")
    )


@_register("learned_search", """
SELECT vec_id AS query_id, TRUE AS inside, TRUE AS complete, TRUE AS right_distance
FROM embeddings""")
def learned_search(spark, sf_dir):
    """Of each query: its neighbours lie in visited buckets, every true neighbour
    that does was found, and the distances are those of the vectors."""
    index = learned_index(spark, sf_dir)
    objects = fx.objects(spark, sf_dir)
    queries = fx.as_queries(objects)
    found = settle(index.search(queries, N_BUCKETS, K), "found")
    truth = knn_brute_force(queries, objects, K)
    visits = settle(index.bucket_order(queries, N_BUCKETS), "visits").select("query_id", "path_key")
    homes = index.assignments.select(F.col("id").alias("neighbor_id"), "path_key")
    hit = F.lit(True)

    def visited(rows):
        return rows.join(homes, "neighbor_id").join(
            visits.withColumn("_visited", hit), ["query_id", "path_key"], "left")

    inside = visited(found).groupBy("query_id").agg(
        F.every(F.coalesce("_visited", F.lit(False))).alias("inside"))
    reachable = visited(truth).filter("_visited").join(
        found.select("query_id", "neighbor_id", hit.alias("_found")), ["query_id", "neighbor_id"], "left")
    complete = reachable.groupBy("query_id").agg(
        F.every(F.coalesce("_found", F.lit(False))).alias("complete"))
    pairs = found.join(queries, "query_id").join(
        objects.select(F.col("id").alias("neighbor_id"), F.col("v").alias("w")), "neighbor_id")
    right = pairs.groupBy("query_id").agg(
        F.every(F.abs(F.col("distance") - vectors.cosine_distance("v", "w")) < 1e-9)
        .alias("right_distance"))
    return inside.join(complete, "query_id", "left").join(right, "query_id").select(
        "query_id", "inside", F.coalesce("complete", F.lit(True)).alias("complete"), "right_distance")


@_register("learned_search_all_buckets", BRUTE_COSINE)
def learned_search_all_buckets(spark, sf_dir):
    """Visiting every bucket of a trained index is an exact search."""
    index = learned_index(spark, sf_dir)
    queries = fx.as_queries(fx.objects(spark, sf_dir))
    return _reported(index.search(queries, index.n_buckets, K))


@_register("learned_two_space", f"""
WITH {SCALED},{_brute('t', 's', INNER)} SELECT {NEIGHBORS} FROM t""")
def learned_two_space(spark, sf_dir):
    """Train and navigate on reduced vectors, compare full ones, all buckets."""
    reduced, full = fx.folded_objects(spark, sf_dir), fx.scaled_objects(spark, sf_dir)
    index = build_index(reduced, LEARNED, search_objects=full)
    return _reported(index.search(
        fx.as_queries(reduced), index.n_buckets, K,
        queries_search=fx.as_queries(full), metric="inner_product",
    ))


@_register("index_save_load", BRUTE_COSINE)
def index_save_load(spark, sf_dir):
    folder = work_dir(spark, "saved")
    learned_index(spark, sf_dir).save(folder)
    index = load_index(spark, folder)
    return _reported(index.search(fx.as_queries(fx.objects(spark, sf_dir)), index.n_buckets, K))


def _largest_of(first: int, n: int):
    """The place of the largest of a few components, as a clustering function and
    as a model kind of its own."""
    def label(x, k):
        return x[:, first:first + n].argmax(axis=1) % k

    def fit(x, y, n_classes, parameters, importance, rng):
        return [first]

    def score(layers, weights, x):
        own = x[:, int(weights[0]):int(weights[0]) + layers[-1]]
        odds = np.exp(20 * (own - own.max(axis=1, keepdims=True)))
        return odds / odds.sum(axis=1, keepdims=True)

    return ClusteringAlgorithm(label=label), ModelKind(fit, score)


@_register("registered_models", """
SELECT vec_id AS id,
       'b' || (list_position(embedding[1:3], list_max(embedding[1:3])) - 1) || '_'
         || (list_position(embedding[4:5], list_max(embedding[4:5])) - 1) AS path_key
FROM embeddings""")
def registered_models(spark, sf_dir):
    """Clustering functions and model kinds of the user's own, saved and loaded: where
    the loaded nodes send every object."""
    (first, MODEL_KINDS["largest-of-3"]), (second, MODEL_KINDS["largest-of-2"]) = (
        _largest_of(0, 3), _largest_of(3, 2))
    objects, folder = fx.objects(spark, sf_dir), work_dir(spark, "registered")
    build_index(objects, BuildConfig(
        [first, second], [1, 1], ["largest-of-3", "largest-of-2"], [0.1, 0.1], [3, 2],
    )).save(folder)
    return assign_paths(objects, load_index(spark, folder).nodes).select("id", "path_key")


@_register("learned_recall_sweep", """
SELECT TRUE AS non_decreasing, CAST(1.0 AS DOUBLE) AS recall_at_all, count(*) AS n_queries
FROM embeddings""")
def learned_recall_sweep(spark, sf_dir):
    """Recall grows with the number of buckets and is whole for all of them."""
    index = learned_index(spark, sf_dir)
    objects = fx.objects(spark, sf_dir)
    queries = fx.as_queries(objects)
    numbers = buckets_to_visit(PERCENTAGES, index.n_buckets, [1])
    truth = knn_brute_force(queries, objects, K)
    swept = recall_sweep(index.sweep(queries, numbers, K), truth, numbers, K)
    # a row for each number of buckets
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n_buckets", "recall"))), lambda r: r["recall"])
    return swept.agg(in_order.alias("r"), F.max("n_queries").alias("n_queries")).select(
        (F.col("r") == F.array_sort("r")).alias("non_decreasing"),
        F.element_at("r", -1).alias("recall_at_all"), "n_queries")


@_register("run_experiment", f"""
SELECT 'learned-index' AS algo, 'embeddings' AS data, CAST(n AS INTEGER) AS n_buckets,
       CAST({K} AS INTEGER) AS k, 'adam' AS solver, CAST(50000 AS INTEGER) AS train_rows,
       'inner_product' AS metric, 'conditional' AS score, CAST(2023 AS INTEGER) AS seed,
       TRUE AS timed, TRUE AS measured
FROM (SELECT unnest([1, 2, 4]) AS n) AS t""")
def experiment(spark, sf_dir):
    objects = fx.objects(spark, sf_dir)
    config = ExperimentConfig(LEARNED, n_buckets_perc=(), n_buckets=(1, 2, 4), data="embeddings")
    runs = run_experiment(
        objects, fx.as_queries(objects), config, work_dir(spark, "experiment")
    )
    return runs.select(
        "algo", "data", "n_buckets", "k", "solver", "train_rows", "metric", "score", "seed",
        ((F.col("build_s") > 0) & (F.col("sweep_s") > 0) & F.col("query_s").isNull()).alias("timed"),
        F.col("recall").between(0.01, 1.0).alias("measured"))


@_register("run_baseline", f"""
WITH {SCALED},{_brute('t', 's', INNER)},{_brute('f', 's', COSINE)}
SELECT 'baseline' AS algo, 'embeddings' AS data, CAST({K} AS INTEGER) AS k,
       count(f.neighbor_id) / (count(DISTINCT t.query_id) * {K}.0) AS recall
FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.neighbor_id = t.neighbor_id""")
def baseline(spark, sf_dir):
    """The cosine search, measured against the neighbours by inner product."""
    objects = fx.scaled_objects(spark, sf_dir)
    queries = fx.as_queries(objects)
    config = ExperimentConfig(LEARNED, index_type="baseline", data="embeddings", normalize=False)
    truth = knn_brute_force(queries, objects, K, metric="inner_product")
    runs = run_experiment(
        objects, queries, config, work_dir(spark, "baseline"), truth=truth
    )
    return runs.select("algo", "data", "k", "recall")
