import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from nearpath.llm.language_id import identify_documents
from nearpath.llm.quality_rules import QualityRules, judge
from nearpath.sources.workdir import settle
from test_jaccard_join import plain as plain_classes
from test_packing import check as check_packing
from test_substring_dedup import plain as plain_passages


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The input and every stage's output."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(settle(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def rows(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_stages(steps):
    assert [name for name, _ in cp.STAGES] == [
        "language_id", "quality_rules", "jaccard_join", "substring_dedup", "packing"]
    for frame in steps[1:5]:
        assert frame.dtypes == steps[0].dtypes


def test_languages(steps):
    kept = {r["doc_id"] for r in identify_documents(steps[0], "doc_id").where("kept").collect()}
    assert sorted(rows(steps[1])) == sorted(r for r in rows(steps[0]) if r[0] in kept)


def test_quality(steps):
    before = rows(steps[1])
    verdicts = judge([i for i, _ in before], [t for _, t in before], QualityRules())
    kept = [r for r, yes in zip(before, verdicts.column("kept").to_pylist()) if yes]
    assert sorted(rows(steps[2])) == sorted(kept) and 0 < len(kept) < len(before)


def test_one_of_each(steps):
    before = rows(steps[2])
    first = {class_id for _, class_id, _, _ in plain_classes(before)}
    assert sorted(rows(steps[3])) == sorted(r for r in before if r[0] in first)
    assert len(first) < len(before)


def test_passages(steps):
    before = dict(rows(steps[3]))
    after = dict(rows(steps[4]))
    for doc_id, _, gone, kept in plain_passages(sorted(before.items())):
        assert after[doc_id] == (kept if gone else before[doc_id])
    assert steps[4].where(F.col("n_chars") != F.length("text")).count() == 0
    others = ["doc_id", "lang", "source"]
    assert steps[4].select(others).exceptAll(steps[3].select(others)).count() == 0


def test_packing(steps):
    assert check_packing(rows(steps[4]), steps[5].collect()) < 0.02


def test_clean_documents_stay(spark, steps, sf_dir):
    """Clean documents leave the filters by the base rules only."""
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    own = [r for r in rows(steps[0]) if r[0] in clean]
    failed = judge([i for i, _ in own], [t for _, t in own], QualityRules()).column("base_failed")
    gone = {i for (i, _), bad in zip(own, failed.to_pylist()) if bad}
    assert clean - gone <= dict(rows(steps[2])).keys()
    assert len(gone) < 0.05 * len(clean)


def test_run(spark, sf_dir, steps):
    got = cp.run(spark, sf_dir)
    assert cp.ORACLE_SQL is None
    key = lambda f: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in f.collect())
    assert key(got) == key(steps[5])
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got.take(20))


@pytest.mark.parametrize("number", range(5))
def test_odd_input(spark, make_docs, odd_rows, number, sf_dir):
    stage = cp.STAGES[number][1]
    docs = settle(make_docs(odd_rows, extra="kept node_2 class _id _key own_id _row row").withColumn(
        "m", F.create_map(F.lit(1), F.col("lang"))).withColumn(
        "at", F.timestamp_micros(F.lit(1700000000123456))), "odd")
    out = stage(spark, docs, sf_dir)
    if number < 4:
        assert out.dtypes == docs.dtypes
        assert out.where("_id = 'x' AND _key = 'x' AND m[1] = 'en'"
                         " AND unix_micros(at) = 1700000000123456").count() == out.count()
    got = out.collect()
    assert len(got) > 0
    if number == 3:
        assert len(got) == len(odd_rows)
    if number == 2:
        assert sorted(r["doc_id"] for r in got if r["text"] and r["text"].startswith("same")) == [9]
    empty = settle(make_docs([]), "none")
    assert stage(spark, empty, sf_dir).count() == 0
