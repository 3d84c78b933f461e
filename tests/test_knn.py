"""Search kernels against a plain enumeration of all pairs."""

import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from nearpath.operators import kernel, knn
from nearpath.operators.kernel import RunningTopK, nearest
from nearpath.operators.knn import (
    bucket_candidates, candidate_counts, knn_brute_force, knn_in_buckets, knn_sweep, scan_tasks,
    without_self,
)
from nearpath.operators.recall import recall_at_k, recall_sweep
from nearpath.operators.topk import merge_top_k

BLOCKS = {"broadcast_bytes": 300}


def vectors(spark, matrix, name, first=0):
    rows = [(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, v array<double>")


def enumerate_pairs(queries, objects, k, metric, reach=None):
    """{query: [(distance, id)]} by looking at every pair."""
    def unit(x):
        length = np.sqrt((x * x).sum())
        return x / length if length and metric == "cosine" else x

    found = {}
    for q, x in enumerate(queries):
        pairs = []
        for i, y in enumerate(objects):
            if reach is not None and i not in reach[q]:
                continue
            pairs.append((float(1 - (unit(x) * unit(y)).sum()), i))
        found[q] = sorted(pairs)[:k]
    return {q: rows for q, rows in found.items() if rows}


def as_dict(result):
    found = {}
    for row in result.orderBy("query_id", "rank").collect():
        rows = found.setdefault(row["query_id"], [])
        rows.append((row["distance"], row["neighbor_id"]))
        assert row["rank"] == len(rows)
    return found


def assert_same(got, wanted):
    assert got.keys() == wanted.keys()
    for query, rows in wanted.items():
        assert [i for _, i in got[query]] == [i for _, i in rows]
        assert [d for d, _ in got[query]] == pytest.approx([d for d, _ in rows], abs=1e-12)


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(1)
    objects = rng.integers(-2, 3, size=(60, 5)).astype(float)
    objects[10] = 0
    objects[20:45] = objects[3]  # many exact copies
    queries = rng.integers(-2, 3, size=(23, 5)).astype(float)
    queries[4] = 0
    return queries, objects


@pytest.mark.parametrize("metric", ["cosine", "inner_product"])
@pytest.mark.parametrize("options", [{}, BLOCKS])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_brute_force(spark, small, metric, options, k):
    queries, objects = small
    got = knn_brute_force(
        vectors(spark, queries, "query_id"), vectors(spark, objects, "id"), k, metric, **options
    )
    assert as_dict(got) == enumerate_pairs(queries, objects, k, metric)


def bucketed(spark, small, n_visits=3):
    """Bucket 0 holds most objects; bucket 9 one; bucket 8 is visited but empty."""
    queries, objects = small
    bucket = [9 if i == 5 else (0 if i % 3 else i % 4) for i in range(len(objects))]
    order = [[0, 8, 9, 1, 2, 3][(q % 2):] for q in range(len(queries))]
    visits = [
        (q, r + 1, f"b{b}") for q in range(len(queries)) for r, b in enumerate(order[q][:n_visits])
    ]
    placed = spark.createDataFrame(
        [(i, [float(x) for x in objects[i]], f"b{bucket[i]}") for i in range(len(objects))],
        "id long, v array<double>, path_key string",
    )
    visits = spark.createDataFrame(visits, "query_id long, bucket_rank long, path_key string")

    def reach(n):
        return {
            q: {i for i in range(len(objects)) if bucket[i] in order[q][:n]}
            for q in range(len(queries))
        }

    return vectors(spark, queries, "query_id"), placed, visits, reach


@pytest.mark.parametrize("options", [{}, BLOCKS, {"broadcast_bytes": 3000}])
@pytest.mark.parametrize("k", [1, 4, 30])
def test_bucketed(spark, small, options, k):
    queries, placed, visits, reach = bucketed(spark, small)
    got = knn_in_buckets(visits, queries, placed, k, metric="inner_product", **options)
    assert as_dict(got) == enumerate_pairs(*small, k, "inner_product", reach(3))


@pytest.mark.parametrize("options", [{}, BLOCKS])
def test_sweep_equals_single_searches(spark, small, options):
    queries, placed, visits, reach = bucketed(spark, small, 6)
    found = knn_sweep(visits, queries, placed, [1, 2, 4, 6], 5, **options).collect()
    for n in (1, 2, 4, 6):
        rows = {}
        for row in sorted((r for r in found if r["n_buckets"] == n), key=lambda r: r["rank"]):
            rows.setdefault(row["query_id"], []).append((row["distance"], row["neighbor_id"]))
        assert rows == enumerate_pairs(*small, 5, "cosine", reach(n))


def test_many_visited_buckets_use_a_join(spark, small, monkeypatch):
    monkeypatch.setattr("nearpath.operators.knn.LISTED_KEYS", 0)
    queries, placed, visits, reach = bucketed(spark, small)
    got = knn_in_buckets(visits, queries, placed, 4)
    assert as_dict(got) == enumerate_pairs(*small, 4, "cosine", reach(3))


@pytest.fixture()
def many_tasks(spark, tmp_path):
    """3,000 objects in 100 files, so that a scan has 100 tasks, and 30 queries."""
    rng = np.random.default_rng(5)
    objects, queries = rng.normal(size=(3000, 8)), rng.normal(size=(30, 8))
    objects[700:900] = objects[3]
    folder = str(tmp_path / "objects")
    (vectors(spark, objects, "id").withColumn("path_key", F.concat(F.lit("b"), F.col("id") % 7))
     .repartition(100).write.parquet(folder))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                             "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    spark.conf.set("spark.sql.files.openCostInBytes", "10k")
    yield queries, objects, spark.read.parquet(folder)
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 4000}])
def test_bounds_from_a_few_tasks_change_nothing(spark, many_tasks, options):
    queries, matrix, objects = many_tasks
    assert scan_tasks(objects) >= 64
    frame = vectors(spark, queries, "query_id")
    got = as_dict(knn_brute_force(frame, objects.drop("path_key"), 10, **options))
    assert_same(got, enumerate_pairs(queries, matrix, 10, "cosine"))
    reach = {q: {i for i in range(3000) if i % 7 in (q % 7, (q + 1) % 7)} for q in range(30)}
    visits = spark.createDataFrame(
        [(q, r + 1, f"b{(q + r) % 7}") for q in range(30) for r in range(2)],
        "query_id long, bucket_rank long, path_key string")
    got = as_dict(knn_in_buckets(visits, frame, objects, 10, **options))
    assert_same(got, enumerate_pairs(queries, matrix, 10, "cosine", reach))
    swept = knn_sweep(visits, frame, objects, [1, 2], 10, **options)
    assert_same(as_dict(swept.where("n_buckets = 2").drop("n_buckets")), got)
    one = {q: {i for i in range(3000) if i % 7 == q % 7} for q in range(30)}
    assert_same(as_dict(swept.where("n_buckets = 1").drop("n_buckets")),
                enumerate_pairs(queries, matrix, 10, "cosine", one))


def test_bounds_from_a_few_tasks_keep_the_merge_small(spark, many_tasks, monkeypatch):
    queries, _, objects = many_tasks
    frame = vectors(spark, queries, "query_id")
    everything = objects.withColumn("path_key", F.lit("b"))
    tasks = scan_tasks(everything)
    seeded = bucket_candidates(None, frame, everything, 10).count()
    monkeypatch.setattr(knn, "SEEDED_TASKS", 10**9)
    unseeded = bucket_candidates(None, frame, everything, 10).count()
    assert unseeded > 0.9 * tasks * len(queries) * 10
    assert seeded < 0.25 * unseeded


def test_a_shuffled_frame_is_not_run_twice(spark, many_tasks):
    _, _, objects = many_tasks
    assert scan_tasks(objects.repartition(200)) == 0


def test_hot_bucket_of_equal_vectors(spark):
    """Nine tenths of the objects share one bucket and one vector."""
    rng = np.random.default_rng(2)
    objects = rng.normal(size=(400, 4))
    objects[:360] = objects[0]
    queries = objects[::10]
    placed = spark.createDataFrame(
        [(i, objects[i].tolist(), "b0" if i < 360 else "b1") for i in range(400)],
        "id long, v array<double>, path_key string",
    ).repartition(7)
    visits = spark.createDataFrame(
        [(q, r, f"b{r - 1}") for q in range(len(queries)) for r in (1, 2)],
        "query_id long, bucket_rank long, path_key string",
    )
    for options in ({}, {"broadcast_bytes": 500}):
        got = knn_in_buckets(visits, vectors(spark, queries, "query_id"), placed, 10, **options)
        assert as_dict(got) == enumerate_pairs(queries, objects, 10, "cosine")


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 600}])
def test_distances_that_differ_behind_the_sixth_decimal(spark, options):
    rng = np.random.default_rng(6)
    tiny = rng.normal(size=(200, 8))
    tiny *= 5e-4 / np.linalg.norm(tiny, axis=1, keepdims=True)
    near = rng.normal(size=8) + 3e-4 * rng.normal(size=(200, 8))
    for matrix, metric in ((tiny, "inner_product"), (near, "cosine")):
        got = knn_brute_force(
            vectors(spark, matrix, "query_id"), vectors(spark, matrix, "id").repartition(5), 5,
            metric, **options)
        got = {q: [i for _, i in rows] for q, rows in as_dict(got).items()}
        wanted = enumerate_pairs(matrix, matrix, 5, metric)
        assert got == {q: [i for _, i in rows] for q, rows in wanted.items()}
        if metric == "cosine":
            assert all(q in found for q, found in got.items())


def jobs_of(spark, run) -> int:
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_more_queries_take_no_more_jobs(spark):
    """Beyond a broadcast the queries are dealt once, not searched block by block."""
    matrix = np.random.default_rng(8).normal(size=(60, 4))
    objects = vectors(spark, matrix, "id").withColumn("path_key", F.lit("b0"))

    def search(n):
        queries = vectors(spark, matrix[:n], "query_id")
        visits = queries.selectExpr("query_id", "1L AS bucket_rank", "'b0' AS path_key")
        brute = knn_brute_force(queries, objects.drop("path_key"), 3, **BLOCKS)
        inside = knn_in_buckets(visits, queries, objects, 3, **BLOCKS)
        wanted = enumerate_pairs(matrix[:n], matrix, 3, "cosine")
        assert_same(as_dict(brute), wanted)
        assert_same(as_dict(inside), wanted)

    few, many = (jobs_of(spark, lambda n=n: search(n)) for n in (12, 60))
    assert 0 < many <= few + 4


def test_cells_hold_a_bounded_part_of_the_queries(spark, small, monkeypatch):
    monkeypatch.setattr(knn, "CELL_BYTES", 2_000)
    monkeypatch.setattr(knn, "LEAST_CELL_BYTES", 500)
    queries, placed, visits, reach = bucketed(spark, small, 6)
    got = knn_in_buckets(visits, queries, placed, 4, **BLOCKS)
    assert as_dict(got) == enumerate_pairs(*small, 4, "cosine", reach(6))
    each = bucket_candidates(visits, queries, placed, 4, per_bucket=True, **BLOCKS)
    whole = bucket_candidates(visits, queries, placed, 4, per_bucket=True)
    by = ("query_id", "bucket_rank")
    assert (sorted(merge_top_k(each, 4, *by).collect())
            == sorted(merge_top_k(whole, 4, *by).collect()))
    swept = knn_sweep(visits, queries, placed, [1, 4, 6], 5, **BLOCKS)
    assert (sorted(swept.collect())
            == sorted(knn_sweep(visits, queries, placed, [1, 4, 6], 5).collect()))


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 600}])
def test_visits_without_their_query_find_nothing(spark, small, options):
    queries, placed, visits, reach = bucketed(spark, small)
    some = queries.filter("query_id % 3 = 1")
    got = as_dict(knn_in_buckets(visits, some, placed, 4, **options))
    assert got == {q: rows for q, rows in enumerate_pairs(*small, 4, "cosine", reach(3)).items()
                   if q % 3 == 1}
    assert knn_in_buckets(visits, queries.filter("query_id > 99"), placed, 4, **options).count() == 0


def test_objects_are_not_shuffled(spark, small, capsys):
    queries, placed, visits, _ = bucketed(spark, small)
    knn_in_buckets(visits, queries, placed, 4).explain()
    plan = capsys.readouterr().out
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "Join" not in below


def test_without_self(spark, small):
    queries, objects = small
    found = knn_brute_force(vectors(spark, objects, "query_id"), vectors(spark, objects, "id"), 4)
    got = as_dict(without_self(found, 3))
    for q, rows in enumerate_pairs(objects, objects, 4, "cosine").items():
        assert got[q] == [r for r in rows if r[1] != q][:3]


def test_candidate_counts(spark, small):
    queries, placed, visits, reach = bucketed(spark, small)
    sizes = placed.groupBy("path_key").count().withColumnRenamed("count", "n_objects")
    got = {r["query_id"]: r["n_candidates"] for r in candidate_counts(visits, sizes).collect()}
    assert got == {q: len(ids) for q, ids in reach(3).items() if ids}


def test_bad_arguments(spark, small):
    queries, objects = (vectors(spark, m, n) for m, n in zip(small, ("query_id", "id")))
    with pytest.raises(ValueError):
        knn_brute_force(queries, objects, 10, "euclidean")
    with pytest.raises(ValueError):
        knn_brute_force(queries, objects, 0)


def test_vectors_of_different_length_fail(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, v array<double>")
    with pytest.raises(Exception, match="differ in length"):
        knn_brute_force(queries, rows.coalesce(1), 1).collect()


def test_no_queries(spark):
    queries = spark.createDataFrame([], "query_id long, v array<double>")
    objects = spark.createDataFrame([(0, [1.0])], "id long, v array<double>")
    assert knn_brute_force(queries, objects).count() == 0


def test_recall(spark):
    schema = "query_id long, rank long, neighbor_id long"
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 3), (1, 2, 4)], schema)
    found = spark.createDataFrame([(0, 1, 2), (0, 2, 9), (0, 3, 1)], schema)
    row = recall_at_k(found, truth, 2).first()
    assert (row["n_queries"], row["hits"], row["recall"]) == (2, 1, 0.25)
    swept = spark.createDataFrame([(2, 0, 1, 1), (2, 1, 1, 4)], "n_buckets long, " + schema)
    got = {r["n_buckets"]: r["recall"] for r in recall_sweep(swept, truth, [1, 2], 2).collect()}
    assert got == {1: 0.0, 2: 0.5}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 9), st.integers(0, 10_000))
def test_nearest_does_not_depend_on_the_split(n, k, pieces, seed):
    rng = np.random.default_rng(seed)
    objects = rng.integers(-1, 2, size=(n, 3)) / 3.0
    queries = rng.integers(-1, 2, size=(5, 3)) / 7.0
    ids = rng.permutation(n)
    whole = RunningTopK(5, k)
    rows, found, distance = nearest(queries, ids, objects, k)
    whole.add(rows, found, distance)
    split = RunningTopK(5, k, limit=20)
    parts = []
    for part in np.array_split(np.arange(n), pieces):
        split.add(*nearest(queries, ids[part], objects[part], k, split.bounds))
        parts += list(split.settle())
    parts += list(split.finish())
    merged = RunningTopK(5, k)
    for part in parts:
        merged.add(*part)
    for a, b in zip(whole.compact(), merged.compact()):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("scale", [1.0, 1e-6, 3e-19, 1e9, 1e20])
@pytest.mark.parametrize("copies", [False, True])
def test_single_precision_shortlists_lose_nothing(scale, copies):
    """Near copies and very short or long vectors: the same as all pairs in double."""
    rng = np.random.default_rng(3)
    objects = rng.normal(size=(900, 16))
    if copies:
        objects = objects[0] + 1e-5 * objects
    objects, queries = objects * scale, rng.normal(size=(20, 16)) * scale
    ids = rng.permutation(900)
    rows, found, distance = nearest(queries, ids, objects, 7)
    everything = kernel.pair_distances(
        queries, objects, np.repeat(np.arange(20), 900), np.tile(np.arange(900), 20)).reshape(20, 900)
    for q in range(20):
        best = sorted(zip(everything[q], ids))[:7]
        assert [(d, i) for d, i in zip(distance[rows == q], found[rows == q])] == best


@pytest.mark.parametrize("kind", ["near", "tiny"])
def test_close_distances_need_no_double_precision(monkeypatch, kind):
    """Almost equal and very short vectors are told apart by the narrow shortlist."""
    rng = np.random.default_rng(9)
    matrix = rng.normal(size=(2000, 32))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = kernel.unit_rows(matrix[0] + 3e-4 * matrix) if kind == "near" else 5e-4 * matrix
    types, compared, shortlist, pairs = [], [], kernel._shortlist, kernel.pair_distances

    def spied(part, *rest):
        types.append(part.dtype)
        return shortlist(part, *rest)

    def counted(queries, objects, rows, cols):
        compared.append(len(rows))
        return pairs(queries, objects, rows, cols)

    monkeypatch.setattr(kernel, "_shortlist", spied)
    monkeypatch.setattr(kernel, "pair_distances", counted)
    rows, found, _ = nearest(matrix[:50], np.arange(2000), matrix, 10)
    assert set(types) == {np.dtype(np.float32)}
    assert sum(compared) < 50 * 100
    everything = pairs(
        matrix[:50], matrix, np.repeat(np.arange(50), 2000), np.tile(np.arange(2000), 50))
    order = np.argsort(everything.reshape(50, 2000), axis=1, kind="stable")[:, :10]
    assert found.reshape(50, 10).tolist() == order.tolist()


def test_candidates_of_one_batch_are_compacted():
    rng = np.random.default_rng(10)
    best, every = RunningTopK(3, 2, limit=40), []
    for first in range(0, 900, 9):
        distance = rng.random(9)
        every += [(g, d, first + i) for i, (g, d) in enumerate(zip([0, 1, 2] * 3, distance))]
        best.add(np.array([0, 1, 2] * 3), first + np.arange(9), distance)
        assert sum(len(part[0]) for part in best.parts) <= 40
    group, ids, distance = best.compact()
    wanted = [row for g in range(3) for row in sorted(r for r in every if r[0] == g)[:2]]
    assert list(zip(group, distance, ids)) == wanted


def test_small_tiles_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    objects, queries = rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    wanted = nearest(queries, np.arange(50), objects, 5)
    monkeypatch.setattr(kernel, "TILE_CELLS", 60)
    for a, b in zip(wanted, nearest(queries, np.arange(50), objects, 5)):
        assert a.tolist() == b.tolist()
