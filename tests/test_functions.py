"""Vector and path functions, ids, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from nearpath.functions import paths, vectors
from nearpath.sources.results import append_runs, read_neighbors, read_runs, write_neighbors
from nearpath.sources.vectors import read_ground_truth, read_vectors, with_row_ids
from nearpath.sources.workdir import discard, work_dir


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_normalize_and_zero_vector(spark):
    assert one(spark, vectors.l2_normalize(array([3, 4]))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(array([0, 0]))) == [0.0, 0.0]


def test_normalize_computes_the_norm_once(spark, capsys):
    rows = spark.range(1).select(F.array(F.col("id").cast("double"), F.rand()).alias("v"))
    rows.select(vectors.l2_normalize("v").alias("x")).explain()
    assert capsys.readouterr().out.lower().count("sqrt") == 1


def test_distances(spark):
    assert one(spark, vectors.inner_product_distance(array([1, 2]), array([3, 4]))) == -10
    assert one(spark, vectors.cosine_distance(array([1, 0]), array([5, 0]))) == 0
    assert one(spark, vectors.cosine_distance(array([1, 0]), array([0, 2]))) == 1
    assert one(spark, vectors.cosine_distance(array([0, 0]), array([0, 2]))) == 1
    assert one(spark, vectors.dot(array([1, 0]), array([1]))) is None


@pytest.mark.parametrize("path", [[], [0], [1, 2], [4, 10, 0, 7]])
def test_path_forms(spark, path):
    column = paths.pad(paths.path_literal(path), 4)
    assert one(spark, column) == path + [-1] * (4 - len(path))
    dotted = paths.serialize_path(column)
    assert one(spark, dotted) == ".".join(map(str, path))
    assert one(spark, paths.path_key(paths.unpad(column))) == paths.key_of(path)
    if path:
        assert one(spark, paths.deserialize_path(dotted, 4)) == one(spark, column)


def test_path_matching(spark):
    path = paths.path_literal([4, 1, 2])
    assert one(spark, paths.path_equals(path, [4, 1, 2]))
    assert not one(spark, paths.path_equals(path, [4, 1]))
    assert one(spark, paths.path_starts_with(path, [4, 1]))
    assert one(spark, paths.path_starts_with(path, []))
    assert not one(spark, paths.path_starts_with(path, [1]))


def test_path_key_survives_partition_folders(spark):
    rows = spark.createDataFrame([(1, "b4_1"), (2, "b4_10"), (3, "b4")], "id long, path_key string")
    folder = work_dir(spark, "keys")
    rows.write.partitionBy("path_key").parquet(folder)
    back = spark.read.parquet(folder)
    assert sorted(r["path_key"] for r in back.collect()) == ["b4", "b4_1", "b4_10"]


def test_row_ids_count_on(spark):
    rows = spark.range(1000).select((999 - F.col("id")).alias("key"), F.lit("x").alias("payload"))
    got = with_row_ids(rows, "key").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 1001))
    assert [r["key"] for r in got] == list(range(1000))


def test_sources_and_sinks(spark):
    folder = work_dir(spark, "io")
    spark.createDataFrame([(7, [1.0, 2.0])], "key int, vec array<double>").write.parquet(f"{folder}/v")
    read = read_vectors(spark, f"{folder}/v", "key", "vec")
    assert dict(read.dtypes) == {"id": "bigint", "v": "array<float>"}
    spark.createDataFrame([(0, [5, 3])], "query_id int, knns array<int>").write.parquet(f"{folder}/t")
    truth = read_ground_truth(spark, f"{folder}/t").orderBy("rank").collect()
    assert [tuple(r) for r in truth] == [(0, 1, 5), (0, 2, 3)]
    found = spark.createDataFrame(
        [(0, 1, 5, 0.1)], "query_id long, rank long, neighbor_id long, distance double"
    )
    write_neighbors(found, folder, "a")
    assert read_neighbors(spark, folder).select("run_id", "neighbor_id").first() == ("a", 5)
    append_runs(spark, folder, [{"run_id": "a", "k": 10}])
    append_runs(spark, folder, [{"run_id": "b", "k": 10}])
    assert {r["run_id"] for r in read_runs(spark, folder).collect()} == {"a", "b"}


def test_work_dirs_are_new_and_follow_the_session(spark):
    first, second = work_dir(spark, "x"), work_dir(spark, "x")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_tables_can_be_discarded(spark):
    folder = work_dir(spark, "gone")
    spark.range(3).write.parquet(folder)
    discard(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
