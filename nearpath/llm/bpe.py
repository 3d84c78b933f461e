"""Byte-level BPE over a global table of distinct words.

A word is a run of text without white space and the blank before it: one or
more whole matches of the pre-token pattern, whatever stands around it. Blocks
of documents explode their texts into words by position and ask for each
distinct one; a shard encodes each distinct word of all blocks once and
answers with its ids; the block puts the ids in their places again. Shuffled
are distinct words and packed texts, not occurrences with positions, which
would be several times the input. Decoding joins ids to the bytes of tokens;
that table is the vocabulary, so it goes to every task.

A null or empty text has no tokens. Rows are independent: repeated ids or equal
rows give a row each, other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from nearpath.llm import exchange
from nearpath.llm.rows import id_and_text, input_tasks, spark_schema

#: White space of the pre-token pattern.
SPACE = "\t-\r \x85\xa0  -     　"
#: Where cutting before each blank would part one run of white space.
WIDE = re.compile(f"[{SPACE}] [{SPACE}]|^ (?:[{SPACE}]|$)|[{SPACE}] $|\0")
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

ROWS_AT_ONCE = 512

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def words(text: str) -> list[str]:
    """The text cut where no match of the pattern can reach across."""
    if WIDE.search(text):
        return RUNS.findall(text)
    parts = text.replace(" ", "\0 ").split("\0")
    return parts if parts[0] else parts[1:]


def token_bytes(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    """The bytes of a document's tokens. An id without a token is an error."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    with_decoded: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id`` and ``ids``, little-endian unsigned 32-bit integers. With
    ``with_decoded`` the ids are decoded again where they are made."""
    docs = id_and_text(docs, id_col, text_col)
    schema = DECODED if with_decoded else ENCODED
    shards = input_tasks(docs)

    def distinct(texts: list[str]) -> dict[int, list[bytes]]:
        found: set[str] = set()
        for text in texts:
            found.update(words(text))
        return exchange.by_shard(map(str.encode, found), shards)

    def ask(rows: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        asked = distinct(rows.column("text").to_pylist())
        # a block without a word still needs an answer to meet
        for shard, own in (asked or {0: []}).items():
            yield shard, exchange.pack_bytes(own)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for block, shard, payload in zip(*(c.to_pylist() for c in batch.columns)):
                asked = exchange.unpack_bytes(payload)
                for word in asked:
                    if word not in known:
                        known[word] = np.array(
                            encoding.encode_ordinary(word.decode()), "<u4").tobytes()
                packed = exchange.pack_bytes([known[word] for word in asked])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.binary()), pa.array([shard], pa.int32()),
                     pa.array([packed], pa.binary())], names=["block", "shard", "payload"])

    def finish(rows: pa.Table, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        texts = rows.column("text").to_pylist()
        known: dict[str, bytes] = {}
        for shard, own in distinct(texts).items():
            known.update(zip(map(bytes.decode, own), exchange.unpack_bytes(got[shard])))
        tokens = {rank: token for token, rank in ranks.items()}
        doc_ids = rows.column("doc_id").combine_chunks()
        for start in range(0, len(texts), ROWS_AT_ONCE):
            part = slice(start, start + ROWS_AT_ONCE)
            ids = [b"".join(map(known.__getitem__, words(text))) for text in texts[part]]
            columns = [doc_ids[part], pa.array(ids, pa.binary())]
            if with_decoded:
                columns.append(pa.array([token_bytes(i, tokens) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    answers = (
        exchange.requests(docs, ask)
        .repartition(shards, "shard")
        .mapInArrow(answer, exchange.REQUESTS)
    )
    return exchange.with_answers(docs, answers, finish, schema, spark_schema(schema))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded``, the bytes of the tokens in a row. An id without a token
    fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in ranks.items()}
        for batch in batches:
            out = [token_bytes(ids, tokens) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], schema=DECODED)

    return encoded.select("doc_id", "ids").mapInArrow(run, spark_schema(DECODED))
