import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nearpath.llm import packing
from nearpath.llm.packing import SHORT, WordEncoder, choose_cuts, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
EXACT = Tokenizer.from_file(PATH)


def ids_of(text):
    return EXACT.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(open(PATH, encoding="utf-8").read())


def test_words_encode_as_the_vocabulary_does(encoder, odd_texts):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCé'ßÄÿ0123!?.,<|>-_中́ΣİﬁΩ" + "thean" * 4
    texts = odd_texts + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        text = text or ""
        assert np.frombuffer(b"".join(encoder.words(text)[1]), "<u4").tolist() == ids_of(text)[:-1], text


def cheapest(places, penalties, length):
    """The same costs by looking at every earlier place."""
    @lru_cache(None)
    def cost(j):
        if j == 0:
            return 0
        best = []
        for i in range(j):
            n = places[j] - places[i]
            if n <= length:
                best.append(cost(i) + length - n)
                if n < length and n >= packing.SMALLEST_POWER and n & (n - 1) == 0:
                    best.append(cost(i) + SHORT)
        return min(best) + penalties[j]

    return cost(len(places) - 1)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_cheapest(seed):
    rng = random.Random(seed)
    length = rng.choice([128, 256, 512])
    places = [0]
    while len(places) < 60:
        places.append(places[-1] + rng.choice([1, 7, 16, 64, rng.randint(1, length)]))
    penalties = [rng.choice([0, 8, 64]) for _ in places]
    cuts = choose_cuts(places, penalties, length)
    total = 0
    for i, j in zip(cuts, cuts[1:]):
        n = places[j] - places[i]
        assert n <= length
        power = n < length and n >= packing.SMALLEST_POWER and n & (n - 1) == 0
        total += min(length - n, SHORT if power else length) + penalties[j]
    assert (cuts[0], cuts[-1]) == (0, len(places) - 1)
    assert total == cheapest(tuple(places), tuple(penalties), length)


def check(rows, got, length=2048):
    """Every id in one piece, sequences gapless and short enough; the padding."""
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    wanted = {}
    for doc_id, text in rows:
        wanted.setdefault(doc_id, []).append(ids_of(text))
    assert set(pieces) == set(wanted)
    for doc_id, all_ids in wanted.items():
        right = sorted((0 if ids is None else 0, len(ids)) for ids in all_ids)
        assert sum(r["length"] for r in pieces[doc_id]) == sum(n for _, n in right)
        if len(all_ids) == 1:
            ids, at = all_ids[0], 0
            for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                at += r["length"]
                part = np.array(ids[r["start"]:at], "<u4").tobytes()
                assert r["ids_crc32"] == zlib.crc32(part)
            assert at == len(ids)
    padding = total = 0
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= length
        total += at
        padding += length - at if at & (at - 1) else 0
    return padding / total


def test_odd_rows(make_docs, odd_rows):
    got = pack_documents(make_docs(odd_rows, extra="start ids sequence_id"), PATH).collect()
    check(odd_rows, got)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in got)


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op8_packing

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert check(rows, op8_packing(spark, sf_dir).collect()) < 0.02


def test_order_is_kept(make_docs):
    rows = [(i, f"document number {i}. It has sentences. " * (i % 9)) for i in range(200)]
    got = pack_documents(make_docs(rows).coalesce(1), PATH).collect()
    places = [(r["sequence_id"], r["offset"], r["doc_id"], r["start"]) for r in got]
    assert sorted(places) == sorted(places, key=lambda p: (p[2], p[3]))


def test_empty_table(make_docs):
    assert pack_documents(make_docs([]), PATH).count() == 0
