import hashlib
import math
import random

import numpy as np
import pytest

from nearpath.llm.centroid_clusters import (
    CentroidLists, centroid_clusters, centroid_digests, whole_vectors,
)

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, v string"


@pytest.fixture()
def make_vectors(spark):
    return lambda rows: spark.createDataFrame(
        [(i, v, 7, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k, rounds, dimension, seed=3):
    kept = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == dimension
        and all(x is not None and math.isfinite(np.float32(x)) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((digest(i), v) for i, v in kept if i is not None)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(own) for x in zip(*own)] if (own := groups.get(n)) else c
                     for n, c in enumerate(centroids)]
    out = [(i, *nearest(v)) for i, v in kept] if centroids else []
    return [(i, n, d, sum(e for _, e, m in out if m == n), sum(e for _, e, _ in out),
             hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
            for i, d, n in out]


def result(frame, centroids):
    digests = centroid_digests(centroids)
    return sorted(repr((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"],
                        r["inertia"], digests[r["cluster"]])) for r in frame.collect())


@pytest.mark.parametrize("seed", range(2))
def test_random_vectors(make_vectors, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.4) for _ in range(6)]) for i in range(120)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (200, None), (201, []), (202, [1.0] * 5),
             (203, [1.0] * 5 + [None]), (204, [float("nan")] * 6), (205, [float("inf")] + [0.0] * 5)]
    got = centroid_clusters(make_vectors(rows), k=5, rounds=4, dimension=6)
    assert result(*got) == sorted(map(repr, plain(rows, 5, 4, 6)))


def test_ties_and_equal_vectors(make_vectors):
    rows = [(i, [float(i % 2), 0.0, -0.5]) for i in range(20)]
    got = centroid_clusters(make_vectors(rows), k=4, rounds=3, dimension=3)
    assert result(*got) == sorted(map(repr, plain(rows, 4, 3, 3)))


def test_fewer_vectors_than_centroids_and_none(make_vectors):
    rows = [(1, [0.1, 0.2]), (2, [0.3, -0.4])]
    got = centroid_clusters(make_vectors(rows), k=8, rounds=2, dimension=2)
    assert result(*got) == sorted(map(repr, plain(rows, 8, 2, 2)))
    for none in ([], [(1, [1.0])], [(None, [0.1, 0.2])]):
        assert centroid_clusters(make_vectors(none), dimension=2)[0].count() == 0


@pytest.mark.parametrize("k, dimension, spread, share", [
    (8, 64, 1000, 1), (40, 3, 100, 0.7), (200, 2, 5000, 0.4), (30, 1, 9, 0.4)])
def test_the_walk_finds_the_nearest(k, dimension, spread, share):
    rng = np.random.default_rng(k)
    centroids = rng.integers(-spread, spread, (k, dimension))
    vectors = rng.integers(-spread, spread, (500, dimension))
    all_of_them = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    cluster, distance, evaluated = CentroidLists(centroids).nearest(vectors)
    assert (cluster == all_of_them.argmin(axis=1)).all()  # the first of equal ones
    assert (distance == all_of_them.min(axis=1)).all()
    assert evaluated <= share * k * len(vectors)  # with few dimensions it stops early


def test_components_that_do_not_fit_are_an_error(spark):
    rows = spark.createDataFrame([(1, [2e5, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="131072"):
        whole_vectors(rows, 2, 1024, "vec_id", "embedding").collect()
