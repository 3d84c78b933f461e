"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Documents are sets of five-word shingles (a text of fewer words is one
shingle). Equal sets become one node. Nodes that agree in one of 32 bands of
four MinHash values are candidates: a pair at the threshold 0.8 escapes with a
probability of 5e-8. Inside a band's bucket the MinHash values of each pair are
compared 16 at a time; with m of n equal and a flat prior the similarity
follows Beta(m + 1, n - m + 1), and once the chance of reaching the threshold
is below ``TOLERANCE`` the pair is dropped. The others tie their nodes together,
and inside each tied group all pairs are verified on the whole sets.

No pair becomes a row. A bucket or group of more than ``CHUNK`` nodes is dealt
into chunks, each two chunks meet in a task of their own, and a task hands on
one row a node: how many documents it is linked with, and one of them.

A text without words has an empty set; such texts are copies of each other and
linked with no other. Rows of one id are separate documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpath.llm.components import connected_components
from nearpath.llm.fingerprint import mix, rolling
from nearpath.llm.rows import id_and_text, input_tasks, spark_schema
from nearpath.sources.workdir import settle

WIDTH = 5
THRESHOLD = 0.8
HASHES, BANDS = 128, 32
STEP = 16
TOLERANCE = 1e-8
CHUNK = 256
PIECE = 4096

_RANDOM = np.random.default_rng(20230)
FACTORS = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)

SIGNED = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()),
    ("signature", pa.binary()),
])
SETS = pa.schema([("node", pa.binary()), ("shingles", pa.binary())])


class Shingler:
    """Shingle sets of texts; the words met so far keep their hashes."""

    def __init__(self, limit: int = 1 << 20):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def shingles(self, text: str) -> np.ndarray:
        """The distinct shingles as sorted 64-bit hashes."""
        words = text.encode().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            return np.unique(mix(rolling(hashes, min(WIDTH, len(words)))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values, 16 bits of each; empty without shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint16)
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), PIECE):
            part = shingles[None, start:start + PIECE] * FACTORS[:, None]
            part += SHIFTS[:, None]
            low = np.minimum(low, part.min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).astype(np.uint16)


def fewest_matches(
    n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> int:
    """Matches of n values below which the pair's chance is under the tolerance.

    The chance that Beta(m + 1, n - m + 1) exceeds t is that of at most m
    successes in n + 1 trials of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def prune(values: np.ndarray, left: np.ndarray, right: np.ndarray, limits: list[int]) -> tuple:
    """The pairs that no step drops. ``values``: one row of MinHash values a node."""
    matches = np.zeros(len(left), np.int64)
    for k, limit in enumerate(limits):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (values[left, part] == values[right, part]).sum(axis=1)
        stay = matches >= limit
        left, right, matches = left[stay], right[stay], matches[stay]
    return left, right


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one it is tied to by the pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def tiles(rows: DataFrame, group: list[str], size: Column, parts: int) -> DataFrame:
    """Deal the rows of each group to chunks, and each pair of chunks to a tile.

    Adds ``chunk``, ``a``, ``b`` (the tile) and ``task``: many tiles, chosen by
    hash, share a task. Without more than ``CHUNK`` rows a group is one tile.
    """
    chunks = F.ceil(size / CHUNK).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return (
        rows.withColumn("other", other)
        .withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
        .withColumn("task", F.pmod(F.xxhash64(*group, "a", "b"), F.lit(parts)).cast("int"))
        .drop("chunks", "other")
    )


def each_tile(rows: pa.Table, group: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Columns, and the pairs (left, right) to look at, of each tile of a task."""
    rows = rows.sort_by([(name, "ascending") for name in (*group, "a", "b", "chunk", "node")])
    columns = {name: rows.column(name).to_pylist() for name in rows.column_names}
    keys = list(zip(*(columns[name] for name in (*group, "a", "b"))))
    start = 0
    for stop in range(1, len(keys) + 1):
        if stop < len(keys) and keys[stop] == keys[start]:
            continue
        own = {name: column[start:stop] for name, column in columns.items()}
        n, first = stop - start, own["chunk"].count(own["a"][0])
        if own["a"][0] == own["b"][0]:
            yield own, *np.triu_indices(n, 1)
        else:
            yield own, np.repeat(np.arange(first), n - first), np.tile(np.arange(first, n), first)
        start = stop


def shared_shingles(sets: list[np.ndarray], block: int = 8192) -> np.ndarray:
    """How many shingles each two sets share."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    distinct, place, counts = np.unique(
        np.concatenate(sets), return_inverse=True, return_counts=True)
    again = counts[place] > 1
    owner, place = owner[again], place[again]
    _, place = np.unique(place, return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    n_places = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, n_places, block):
        a, b = np.searchsorted(place, [start, start + block])
        holds = np.zeros((n, block), np.float32)
        holds[owner[a:b], place[a:b] - start] = 1
        out += holds @ holds.T
    return out


def jaccard_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: its class, and how many documents it is linked with.

    ``n_links`` counts the other documents at the threshold or above, copies
    included. A class holds what links connect; ``class_id`` is its smallest
    ``doc_id``, ``class_size`` its number of documents; ``class`` names it too, if
    no document of it has an id. ``node`` is a hash of the shingle set, equal for
    copies, ``text_key`` one of the text.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    parts = 4 * input_tasks(docs)
    limits = [fewest_matches(n, threshold, tolerance) for n in range(STEP, HASHES + 1, STEP)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([signature(s).tobytes() for s in sets], pa.binary()),
            ], schema=SIGNED)

    signed = settle(docs.mapInArrow(sign, spark_schema(SIGNED)), "signed")
    nodes = settle(signed.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
        F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
    ), "nodes")

    # buckets of two nodes and more
    band_bytes = 2 * HASHES // BANDS
    bands = nodes.where("n_shingles > 0").select("node", F.explode(F.array(*(
        F.concat(F.lit(bytes([i])), F.substring("signature", i * band_bytes + 1, band_bytes))
        for i in range(BANDS)
    ))).alias("bucket"))
    full = bands.groupBy(F.col("bucket").alias("full")).agg(F.count("*").alias("size")).where("size > 1")
    members = bands.join(full, F.col("bucket") == F.col("full")).select("node", "bucket", "size")
    members = members.join(nodes.select("node", "signature"), "node")

    def tie(rows: pa.Table) -> pa.Table:
        out = {"u": [], "v": []}
        for own, left, right in each_tile(rows, ["bucket"]):
            values = np.frombuffer(b"".join(own["signature"]), np.uint16).reshape(-1, HASHES)
            label = roots(len(values), *prune(values, left, right, limits))
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                out["u"].append(own["node"][i])
                out["v"].append(own["node"][label[i]])
        return pa.table({name: pa.array(column, pa.binary()) for name, column in out.items()})

    ties = (
        tiles(members, ["bucket"], F.col("size"), parts)
        .groupBy("task").applyInArrow(tie, "u binary, v binary")
    )
    tied = settle(connected_components(ties), "tied")

    # whole sets of the tied nodes, from one document each
    wanted = tied.join(nodes, "node").select(
        "node", "component", "copies", "n_shingles", F.col("first_id").alias("wanted_id"))

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                pa.array(sets, pa.binary()),
            ], schema=SETS)

    sets = (
        docs.join(wanted.select("wanted_id").distinct(),
                  F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        .select("text").mapInArrow(read_sets, spark_schema(SETS))
        .groupBy("node").agg(F.first("shingles").alias("shingles"))
    )
    sizes = tied.groupBy(F.col("component").alias("sized")).agg(F.count("*").alias("size"))
    verified = wanted.join(sets, "node").join(sizes, F.col("component") == F.col("sized"))

    def verify(rows: pa.Table) -> pa.Table:
        out = {"u": [], "v": [], "links": []}
        for own, left, right in each_tile(rows, ["component"]):
            n = np.array(own["n_shingles"])
            shared = shared_shingles([np.frombuffer(s, np.uint64) for s in own["shingles"]])
            both = shared[left, right]
            linked = both >= threshold * (n[left] + n[right] - both) - 1e-9
            left, right = left[linked], right[linked]
            copies = np.array(own["copies"])
            links = np.bincount(left, copies[right], len(n)) + np.bincount(right, copies[left], len(n))
            label = roots(len(n), left, right)
            out["u"] += own["node"]
            out["v"] += [own["node"][i] for i in label.tolist()]
            out["links"] += links.astype(np.int64).tolist()
        return pa.table({"u": pa.array(out["u"], pa.binary()), "v": pa.array(out["v"], pa.binary()),
                         "links": pa.array(out["links"], pa.int64())})

    links = settle(
        tiles(verified.select("node", "component", "copies", "n_shingles", "shingles", "size"),
              ["component"], F.col("size"), parts)
        .groupBy("task").applyInArrow(verify, "u binary, v binary, links long"),
        "links",
    )
    classes = connected_components(links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    placed = (
        nodes.select("node", "first_id", "copies")
        .join(classes, "node", "left").join(counts, "node", "left")
        .withColumn("class", F.coalesce("component", "node"))
    )
    named = placed.groupBy("class").agg(
        F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    placed = placed.join(named, "class").select(
        "node", "class", "class_id", "class_size",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "text_key", "node", "n_shingles").join(placed, "node").select(
        "doc_id", "class_id", "n_links", "class_size", "n_shingles", "class", "node", "text_key")
