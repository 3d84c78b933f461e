"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is ``SHINGLE`` consecutive code points (a shorter text is one
shingle). The k smallest distinct hashes of a text are its sketch. Sketches of
two parts merge to the k smallest of both, so a long text is hashed in pieces
and a sketch of a table can be built from those of its parts; of two sketches
one estimates resemblance, containment and the number of distinct shingles.
A sketch of fewer than k hashes holds all shingles and is exact.

An empty text has an empty fingerprint; two empty ones are alike (1), an empty
and another one are not (0).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.llm.rows import id_and_text, input_tasks, spark_schema, table

SHINGLE = 12
K = 128
PIECE = 1 << 20
BITS = 48
MAX_RANGES = 10_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, put together from doubled widths."""
    out, out_width = None, 0
    power, factor, have = values, _BASE, 1  # hashes of runs of ``have``
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                if out is None:
                    out, out_width = power, have
                else:
                    m = len(values) - out_width - have + 1
                    out = out[:m] * factor + power[out_width:out_width + m]
                    out_width += have
            if out_width == width:
                return out
            m = len(values) - 2 * have + 1
            power = power[:m] * factor + power[have:have + m]
            factor, have = factor * factor, have * 2


def shingle_hashes(codes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Mixed hashes of the shingles, ``BITS`` bits each."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    hashes = rolling(codes.astype(np.uint64) + np.uint64(1), min(width, len(codes)))
    with np.errstate(over="ignore"):
        return mix(hashes) >> np.uint64(64 - BITS)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    if len(hashes) > 16 * k:
        # hashes are even: nearly always this keeps 4 k or so, and enough of them
        low = np.unique(hashes[hashes < np.uint64((1 << BITS) * 4 * k // len(hashes))])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of all shingles of both."""
    return np.union1d(a, b)[:k]


def sketch(codes: np.ndarray, k: int = K, width: int = SHINGLE, piece: int = PIECE) -> np.ndarray:
    """The sketch of a text, hashed in pieces of bounded size."""
    out = bottom(shingle_hashes(codes[: piece + width - 1], width), k)
    for start in range(piece, len(codes) - width + 1, piece):
        out = merge(out, bottom(shingle_hashes(codes[start:start + piece + width - 1], width), k), k)
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared shingles as a share of all shingles of both texts."""
    both = np.union1d(a, b)[:k]
    if not len(both):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b), both)) / len(both)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    if len(a) < k:
        return float(len(a))
    return (k - 1) / (float(a[k - 1]) / (1 << BITS))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def to_string(a: np.ndarray) -> str:
    """The sketch as text: six bytes a hash."""
    six = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return base64.b64encode(six.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(six, ((0, 0), (0, 8 - BITS // 8))).copy().view("<u8").reshape(-1).astype(np.uint64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()),
                    ("n_shingles", pa.float64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every row, and its estimated number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(codes_of(t)) for t in batch.column("text").to_pylist()]
            yield table(SCHEMA, {
                "doc_id": batch.column("doc_id").to_pylist(),
                "fingerprint": [to_string(s) for s in made],
                "n_shingles": [distinct_shingles(s) for s in made],
            })

    return id_and_text(docs, id_col, text_col).mapInArrow(run, spark_schema(SCHEMA))


EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("edited_containment", pa.float64()), ("n_shingles", pa.float64()),
])


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of ``doc_id`` (``range``), in order inside a task.

    The first row of a range comes a second time (``is_next``) at the end of
    the range before it, the first of all at the end of the last, so that each
    row is followed by its successor. Ties of an id go by text; null ids are last.
    """
    docs = id_and_text(docs, id_col, text_col)
    n = min(input_tasks(docs), MAX_RANGES)
    cuts = docs.select(F.percentile_approx(
        "doc_id", [i / n for i in range(1, n)], 10_000).alias("cuts")).first()["cuts"] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    ranged = (
        Bucketizer(splits=splits, inputCol="as_double", outputCol="bucket", handleInvalid="keep")
        .transform(docs.withColumn("as_double", F.col("doc_id").cast("double")))
        .select("doc_id", "text",
                F.coalesce(F.col("bucket").cast("int"), F.lit(len(splits))).alias("range"))
    )
    # one row a range
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    held = sorted(row["range"] for row in firsts.select("range").collect())
    before = dict(zip(held, held[-1:] + held[:-1]))
    spark = docs.sparkSession
    earlier = spark.createDataFrame(list(before.items()), "range int, earlier int")
    firsts = F.broadcast(firsts.join(F.broadcast(earlier), "range"))
    copies = (
        ranged.join(firsts, "range")
        .where(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("earlier").alias("range"), "doc_id").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "range", F.lit(True).alias("is_next"))
    )
    return (
        ranged.withColumn("is_next", F.lit(False)).unionByName(copies)
        .repartitionById(n, F.pmod("range", F.lit(n)))
        .sortWithinPartitions("range", "is_next", F.asc_nulls_last("doc_id"), "text")
    )


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each text against an edited one and against the next document.

    The last quarter of the code points, rounded down, gives way to as many
    leading ones of the next document (all, if it has fewer). The next document
    is that with the next ``doc_id``; after the last comes the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = {name: [] for name in EDITED.names}
            for doc_id, text, is_next in zip(
                batch.column("doc_id").to_pylist(),
                batch.column("text").to_pylist(),
                batch.column("is_next").to_pylist(),
            ):
                here = sketch(codes_of(text))
                if held is not None:
                    add(out, *held, text, here)
                held = None if is_next else (doc_id, text, here)
            yield table(EDITED, out)

    def add(out, doc_id, text, own, following, next_sketch) -> None:
        cut = len(text) - len(text) // 4
        edited = text[:cut] + following[: len(text) // 4]
        changed = sketch(codes_of(edited))
        for name, value in (
            ("doc_id", doc_id), ("n_chars", len(text)), ("edited_text", edited),
            ("fingerprint", to_string(own)), ("edited_fingerprint", to_string(changed)),
            ("near_edited", resemblance(own, changed)),
            ("near_next", resemblance(own, next_sketch)),
            ("edited_containment", containment(own, changed)),
            ("n_shingles", distinct_shingles(own)),
        ):
            out[name].append(value)

    return with_successors(docs, id_col, text_col).mapInArrow(run, spark_schema(EDITED))
