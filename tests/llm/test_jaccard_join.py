import random
import re

import numpy as np
import pytest

from nearpath.llm import jaccard_join as jj
from nearpath.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(text or "")
    width = min(5, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def plain(rows, threshold=0.8):
    """(doc_id, class id, links, class size) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or (x & y and len(x & y) >= threshold * len(x | y) - 1e-9):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    out = []
    for members in groups.values():
        ids = [rows[a][0] for a in members if rows[a][0] is not None]
        out += [(rows[a][0], min(ids, default=None), links[a], len(members)) for a in members]
    return out


def near_copies(seed, n_groups=12, most=14):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120, 300]))]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


def result(frame):
    return sorted(repr((r["doc_id"], r["class_id"], r["n_links"], r["class_size"]))
                  for r in frame.collect())


@pytest.mark.parametrize("chunk", [256, 4])
def test_against_all_pairs(make_docs, odd_rows, chunk, monkeypatch):
    monkeypatch.setattr(jj, "CHUNK", chunk)
    rows = near_copies(chunk) + [(10_000 + (i or 0) if i is not None else None, t) for i, t in odd_rows]
    docs = make_docs(rows, extra="node class signature copies")
    assert result(jj.jaccard_classes(docs)) == sorted(map(repr, plain(rows)))


def test_chains_are_one_class(make_docs):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):
        words[i * 15] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = jj.jaccard_classes(make_docs(rows))
    assert result(got) == sorted(map(repr, plain(rows)))
    assert got.select("class_id").distinct().count() == 1


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op9_jaccard_join

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op9_jaccard_join(spark, sf_dir)
    assert result(got) == sorted(map(repr, plain([tuple(r) for r in rows])))
    assert got.where("n_links > 0").count() > 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    limits = [jj.fewest_matches(n) for n in range(16, 129, 16)]
    values = np.zeros((20_000, jj.HASHES), np.uint16)
    other = (rng.random(values.shape) > 0.8).astype(np.uint16)
    both = np.concatenate([values, other])
    left, _ = jj.prune(both, np.arange(20_000), np.arange(20_000, 40_000), limits)
    assert len(left) == 20_000
    far = (rng.random(values.shape) > 0.4).astype(np.uint16)
    left, _ = jj.prune(np.concatenate([values, far]), np.arange(20_000), np.arange(20_000, 40_000), limits)
    assert len(left) < 200


def test_signature_estimates():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a = np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    b = np.concatenate([shared, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    assert (jj.signature(a) == jj.signature(b)).mean() == pytest.approx(900 / 1100, abs=0.12)


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(label[u], label[v])
            changed |= label[u] != low or label[v] != low
            label[u] = label[v] = low
    alone = {u for u, v in edges if u == v} - {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in label.items() if k not in alone}


def test_empty_table(make_docs):
    assert jj.jaccard_classes(make_docs([])).count() == 0
    assert jj.jaccard_classes(make_docs([(1, None), (2, "")])).where("class_id = 1").count() == 2
