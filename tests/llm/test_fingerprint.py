import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpath.llm import fingerprint as fp


def text(n, seed):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i}" for i in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def shingles(t):
    return {t[i:i + fp.SHINGLE] for i in range(max(1, len(t) - fp.SHINGLE + 1))} if t else set()


def test_pieces_merge_to_the_same_sketch():
    codes = fp.codes_of(text(5000, 1))
    whole = fp.sketch(codes)
    assert np.array_equal(whole, fp.sketch(codes, piece=777))
    assert np.array_equal(whole, np.unique(fp.shingle_hashes(codes))[: fp.K])


def test_string_round_trip():
    sketch = fp.sketch(fp.codes_of(text(100, 2)))
    assert np.array_equal(sketch, fp.from_string(fp.to_string(sketch)))
    assert fp.to_string(fp.sketch(fp.codes_of(""))) == ""


@pytest.mark.parametrize("seed", range(5))
def test_estimates(seed):
    a, extra = text(3000, seed), text(1000, seed + 100)
    b = a[: len(a) * 2 // 3] + extra
    sa, sb = shingles(a), shingles(b)
    x, y = fp.sketch(fp.codes_of(a)), fp.sketch(fp.codes_of(b))
    assert fp.resemblance(x, y) == pytest.approx(len(sa & sb) / len(sa | sb), abs=0.2)
    assert fp.containment(x, y) == pytest.approx(len(sa & sb) / len(sa), abs=0.25)
    assert fp.distinct_shingles(x) == pytest.approx(len(sa), rel=0.35)


def test_small_texts_are_exact():
    a, b = "abcdefghijklmnop", "abcdefghijklmnoq"
    x, y = fp.sketch(fp.codes_of(a)), fp.sketch(fp.codes_of(b))
    assert fp.resemblance(x, y) == len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert fp.resemblance(fp.sketch(fp.codes_of("")), fp.sketch(fp.codes_of(""))) == 1
    assert fp.resemblance(x, fp.sketch(fp.codes_of(""))) == 0


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (doc_id, own) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        a, b, c = (fp.sketch(fp.codes_of(t)) for t in (own, edited, following))
        out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), fp.to_string(a),
                    fp.to_string(b), fp.resemblance(a, b), fp.resemblance(a, c)))
    return out


def result(frame):
    return [(r["doc_id"], r["n_chars"], hashlib.sha256(r["edited_text"].encode()).hexdigest(),
             r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
            for r in frame.collect()]


def test_successors(make_docs, odd_rows):
    rows = odd_rows + [(i * 7 % 1000 + 50, text(i % 60, i)) for i in range(300)]
    got = result(fp.edited_fingerprints(make_docs(rows, extra="range is_next as_double fingerprint")))
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table")], [(None, None)], [(3, "b"), (1, None)]])
def test_few_rows(make_docs, rows):
    got = result(fp.edited_fingerprints(make_docs(rows)))
    assert sorted(map(repr, got)) == sorted(map(repr, plain(rows)))


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op5_fingerprints

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op5_fingerprints(spark, sf_dir).collect()}
    for doc_id, n, sha, mine, edited, near, following in plain(rows):
        row = got[doc_id]
        assert (row["n_chars"], row["edited_sha256"], row["fingerprint"]) == (n, sha, mine)
        assert (row["edited_fingerprint"], row["near_edited"], row["near_next"]) == (edited, near, following)


def test_fingerprints(make_docs, odd_rows):
    rows = fp.fingerprints(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    same = [r["fingerprint"] for r in rows if r["doc_id"] in (9, 10)]
    assert same[0] == same[1] != ""


def test_ranges_do_not_collide(make_docs):
    """Each range has a task of its own."""
    rows = fp.with_successors(make_docs([(i, f"text {i}") for i in range(400)]))
    tasks = rows.select("range", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == len({r["range"] for r in tasks}) == len({r["task"] for r in tasks}) > 4
