import math
import random
import re

import numpy as np
import pytest

from nearpath.llm import lexical_search as search
from nearpath.llm.lexical_search import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    docs = [(i, terms(t)) for i, t in rows]
    n_docs, n_terms = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = {}
    for _, own in docs:
        for term in set(own):
            df[term] = df.get(term, 0) + 1
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, own in docs:
            if not own:
                continue
            m = 100 - 75 + (75 * len(own) * n_docs) // n_terms
            score = 0
            for term in terms(text):
                tf = own.count(term)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -score)
                for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture()
def make_items(spark):
    return lambda rows: spark.createDataFrame(
        [(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def result(frame):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in frame.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(make_docs, make_items, seed, monkeypatch):
    monkeypatch.setattr(search, "STEP", 3)
    monkeypatch.setattr(search, "CELLS", 200)
    monkeypatch.setattr(search, "BLOCK_BYTES", 2000)
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(30)] + ["é", "中", "don't"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(3, 33)]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in rng.sample(range(500), 80)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, None)]
    items = [(i, text(rng.randint(0, 20))) for i in range(12)] + [(3, "w1 w1 w2"), (None, "é w3")]
    assert result(lexical_search(make_docs(rows), make_items(items))) == sorted(
        map(repr, plain(rows, items)))


def test_ties_go_to_the_smaller_id(make_docs, make_items):
    rows = [(i, "some words alike") for i in range(40)] + [(99, "other words")]
    out = lexical_search(make_docs(rows), make_items([(1, "alike some")])).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in out) == [(i + 1, i) for i in range(10)]


def test_masks_that_cannot_win_are_left_out():
    """Only groups whose maximum reaches the k-th best score are scored."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 2)))) for i in range(500)]
    rows += [(1000 + i, "a b c d e") for i in range(10)]
    number = {c: i for i, c in enumerate([b"a", b"b", b"c", b"d", b"e"])}
    block = search.Postings.of([i for i, _ in rows], [t for _, t in rows], number)
    items = search.Items([np.arange(5)], [np.ones(5, np.int64)], np.full(5, 100), 510, 1000)
    places, _ = search.BlockSearch(block, items).search(0, 10, 0)
    assert sorted(block.ids[places].tolist()) == list(range(1000, 1010))


def test_a_known_bound_hands_on_less(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    docs = search.id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = {}
    codes = [[number.setdefault(t, len(number)) for p in search.terms_of(r["text"]) for t in p]
             for r in items]
    own = [np.unique(np.array(c), return_counts=True) for c in codes]
    postings, _ = search.write_postings(docs.repartition(8), number)
    n_docs, all_terms, weight = search.weights(postings, len(number))
    shared = spark.sparkContext.broadcast(search.Items(
        [t for t, _ in own], [n for _, n in own], np.array(weight), n_docs, all_terms))
    found = search.candidates(postings, shared, 10)
    best = search.ranked(found, 10).where("rank = 10").collect()
    least = np.zeros(len(items), np.int64)
    for row in best:
        least[row["item"]] = row["score"]
    bounded = search.candidates(postings, shared, 10, least).count()
    assert 10 * len(items) <= bounded < 0.3 * found.count()


def test_odd_rows_long_texts_and_other_columns(make_docs, make_items, odd_rows, odd_texts):
    items = [(i, t[:4000] if t else t) for i, t in enumerate(odd_texts)]
    docs = make_docs(odd_rows, extra="item_id score rank item seed")
    assert result(lexical_search(docs, make_items(items))) == sorted(
        map(repr, plain(odd_rows, items)))


def test_pieces_of_long_texts_cut_no_term(monkeypatch):
    monkeypatch.setattr(search, "PIECE_BYTES", 5)
    text = "abcdefghij  kl, mnopqrstuvw é x" * 3
    assert [t.decode() for piece in search.terms_of(text) for t in piece] == terms(text)


def test_items_in_blocks(make_docs, make_items):
    rows = [(i, f"one w{i % 7} w{i % 5} w{i % 3}") for i in range(60)]
    items = [(i, f"w{i % 7} w{i % 4}") for i in range(30)]
    out = lexical_search(make_docs(rows), make_items(items), item_bytes=500)
    assert result(out) == sorted(map(repr, plain(rows, items)))


def test_empty_tables(make_docs, make_items):
    assert lexical_search(make_docs([]), make_items([(1, "a")])).count() == 0
    assert lexical_search(make_docs([(1, "a")]), make_items([])).count() == 0
    assert lexical_search(make_docs([(1, None)]), make_items([(1, None)])).count() == 0
