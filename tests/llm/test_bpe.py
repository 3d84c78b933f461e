import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from nearpath.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x0b\x1c\x85\xa0 aB1é½中́'.,!s💡\0"), max_size=20))
def test_words_never_cut_a_match(text):
    encoding = tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks={bytes([i]): i for i in range(256)} | {b"  ": 300, b" \n": 301, b"'s": 302},
        special_tokens={})
    words = bpe.words(text)
    assert "".join(words) == text
    assert [i for w in words for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text)


def test_ids_and_round_trip(spark, make_docs, odd_rows, plain):
    docs = make_docs(odd_rows, extra="ids decoded block payload")
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(repr((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]))) for r in got) == sorted(
        repr((i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()))
        for i, t in odd_rows)


def test_whole_table(spark, sf_dir, plain):
    from nearpath.llm.queries import op1_byte_bpe

    got = {r["doc_id"]: r for r in op1_byte_bpe(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows[::7]:
        ids = plain.encode_ordinary(text)
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(make_docs):
    assert bpe.encode(make_docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
