"""Blocks of documents that ask shards of keys, and get answers back.

Some operators need, for each distinct word (or hash) of all documents, one
value found globally. Shuffling every occurrence would move many times the
input. Here a block, up to ``BLOCK_BYTES`` of documents that one task reads
together, asks once for each of its distinct keys:

    requests   block -> shard of the key    distinct keys, packed
    answers    shard -> block               values in the order asked
    documents  to where their answers are   packed text

A key that every document has is asked for once a block, however often it
occurs, so frequent words make no hot task. A block is named by a hash of its
rows. Scanning the same files again gives the same blocks, also after a lost
executor; if a source should ever deal its rows otherwise the second time, the
block finds no answers and the job fails instead of giving a wrong result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from nearpath.llm.rows import input_tasks, slices

BLOCK_BYTES = 12 << 20

REQUESTS = "block binary, shard int, payload binary"
DOCUMENTS = "block binary, payload binary"

def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.RecordBatch]]:
    """Name and rows of each block in a task's rows (``doc_id``, ``text`` and others)."""
    for batch in batches:
        for rows in slices(batch, "text", BLOCK_BYTES):
            name = xxhash.xxh3_128(repr(rows.column("doc_id").to_pylist()).encode())
            for text in rows.column("text"):
                name.update(text.as_buffer())
                name.update(b"\0")
            yield name.digest(), rows


def pack_bytes(items: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.compress(
        np.uint32(len(items)).tobytes() + sizes.tobytes() + b"".join(items), 3
    )


def unpack_bytes(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    starts = np.append(4 + 4 * n, ends[:-1])[:n]
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def by_shard(words: Iterable[bytes], shards: int) -> dict[int, list[bytes]]:
    """The words of each shard, sorted."""
    out: dict[int, list[bytes]] = {}
    for word in words:
        out.setdefault(zlib.crc32(word) % shards, []).append(word)
    return {shard: sorted(own) for shard, own in sorted(out.items())}


def pack_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpack_rows(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def requests(
    docs: DataFrame, ask: Callable[[pa.RecordBatch], Iterable[tuple[int, bytes]]]
) -> DataFrame:
    """What each block asks: ``ask`` gives (shard, payload) for a block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in blocks(batches):
            asked = list(ask(rows))
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(asked), pa.binary()),
                pa.array([shard for shard, _ in asked], pa.int32()),
                pa.array([payload for _, payload in asked], pa.binary()),
            ], names=["block", "shard", "payload"])

    return docs.mapInArrow(run, REQUESTS)


def packed_blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in blocks(batches):
            yield pa.RecordBatch.from_arrays([
                pa.array([name], pa.binary()), pa.array([pack_rows(rows)], pa.binary()),
            ], names=["block", "payload"])

    return docs.mapInArrow(run, DOCUMENTS)


def with_answers(
    docs: DataFrame,
    answers: DataFrame,
    finish: Callable[[pa.Table, dict[int, bytes]], Iterator[pa.RecordBatch]],
    schema: pa.Schema | None,
    spark_schema: str | StructType,
) -> DataFrame:
    """``finish`` gets the rows of a block and the answers by shard. ``schema`` may
    be left out if it gives at least one batch a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("shard").to_pylist(), right.column("payload").to_pylist()))
        out = [
            batch
            for payload in left.column("payload").to_pylist()
            for batch in finish(unpack_rows(payload), got)
        ]
        return pa.Table.from_batches(out, schema)

    # as many tasks as the input has, whatever the session's setting
    tasks = input_tasks(docs)
    return (
        packed_blocks(docs).repartition(tasks, "block").groupBy("block")
        .cogroup(answers.repartition(tasks, "block").groupBy("block"))
        .applyInArrow(run, spark_schema)
    )


def by_shard_group(
    asked: DataFrame, shards: int, answer: Callable[[pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``answer`` gets all requests of a shard together."""
    return asked.repartition(shards, "shard").groupBy("shard").applyInArrow(answer, schema)
