"""Ranked lexical search: documents grouped by the query terms they hold.

Documents are read once. Each block of them becomes the postings of the terms
that some item asks for: which document, how often, and how many terms the
document has. Postings are written, with the counts that the weights need, and
everything else reads only them.

For one item and one block, the documents' presence bitmaps over the item's
terms, turned sideways, give each document a mask of the terms it holds;
documents of equal masks are one group. No document of a group scores more than
the mask's terms could give it, each at the best that the block has for it. So
groups are taken by descending maximum, their documents scored exactly, and the
rest is left when the k-th best score is strictly above the next maximum.

The k-th best score is known before the scan: a few blocks, about
``SEED_BLOCKS`` whatever the input, are searched first. What an item finds there
is a lower bound of its k-th best score anywhere, so tasks hand on only what
reaches it, not k rows each.

A document without an id counts like any other and comes after those with equal
scores. Equal rows are documents, or items, of their own. Null and empty texts
have no terms. Items go in blocks of ``ITEM_BYTES``, each a search of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearpath.llm.rows import id_and_text, input_tasks, slices, spark_schema
from nearpath.sources.workdir import discard, settle, settle_in

TOP = 10
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
SEED_BLOCKS = 64
#: Items searched together: their texts are broadcast.
ITEM_BYTES = 16 << 20
#: Documents times terms whose bitmap a task holds at once.
CELLS = 1 << 23
#: Documents scored before the bound is looked at again.
STEP = 256

#: Bytes that belong to terms, in lower case; all others are blanks.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

POSTINGS = pa.schema([
    ("seed", pa.bool_()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ("terms", pa.binary()), ("dfs", pa.binary()),
    ("ids", pa.binary()), ("no_id", pa.binary()), ("sizes", pa.binary()),
    ("docs", pa.binary()), ("tfs", pa.binary()),
])
FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece of about ``PIECE_BYTES``."""
    data = text.encode().translate(LETTERS)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@dataclass
class Postings:
    """Of a block's documents: per document its id and number of terms, and per
    distinct term the documents that hold it, ascending, and how often."""

    terms: np.ndarray
    dfs: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray
    tfs: np.ndarray

    KINDS = {"terms": "<i4", "dfs": "<i8", "ids": "<i8", "no_id": "?", "sizes": "<i8",
             "docs": "<i4", "tfs": "<i8"}

    @classmethod
    def of(cls, ids: list, texts: list[str], number: dict[bytes, int]) -> Postings:
        sizes, keys, counts = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            for terms in terms_of(text):
                sizes[i] += len(terms)
                codes = np.fromiter(map(number.get, terms, repeat(-1)), np.int64, len(terms))
                own, n = np.unique(codes[codes >= 0], return_counts=True)
                keys.append(own * len(texts) + i)
                counts.append(n)
        # pieces of one text meet again here
        keys = np.concatenate(keys or [np.zeros(0, np.int64)])
        keys, at = np.unique(keys, return_inverse=True)
        tfs = np.bincount(at, np.concatenate(counts or [np.zeros(0)]), len(keys)).astype(np.int64)
        term, docs = np.divmod(keys, max(len(texts), 1))
        held, dfs = np.unique(term, return_counts=True)
        return cls(held, dfs, np.array([0 if i is None else i for i in ids], np.int64),
                   np.array([i is None for i in ids], bool), sizes, docs, tfs)

    def row(self, seed: bool) -> pa.RecordBatch:
        packed = [pa.array([getattr(self, name).astype(kind).tobytes()], pa.binary())
                  for name, kind in self.KINDS.items()]
        known = [pa.array([seed]), pa.array([int((self.sizes > 0).sum())], pa.int64()),
                 pa.array([int(self.sizes.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(known + packed, schema=POSTINGS)

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Postings]:
        for i in range(batch.num_rows):
            yield cls(**{name: np.frombuffer(batch.column(name)[i].as_py(), kind)
                         for name, kind in cls.KINDS.items()})


def write_postings(docs: DataFrame, number: dict[bytes, int]) -> tuple[DataFrame, str]:
    """One row a block, and the folder they are in."""
    shared = docs.sparkSession.sparkContext.broadcast(number)
    every = -(-input_tasks(docs) // SEED_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = TaskContext.get().partitionId() % every == 0
        for batch in batches:
            for rows in slices(batch, "text", BLOCK_BYTES):
                made = Postings.of(
                    rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), shared.value)
                yield made.row(seed)
                seed = False  # the first block of one task in so many

    return settle_in(docs.mapInArrow(run, spark_schema(POSTINGS)), "postings")


def weights(postings: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """N, L and the weight of each term: one row a term of the items comes here."""
    total = postings.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, all_terms = total[0] or 0, total[1] or 0

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dfs = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(),
                                     batch.column("dfs").to_pylist()):
                dfs[np.frombuffer(terms, "<i4")] += np.frombuffer(counts, "<i8")
        held = np.flatnonzero(dfs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(dfs[held])], names=["term", "df"])

    dfs = (
        postings.select("terms", "dfs").mapInArrow(spread, "term int, df long")
        .groupBy("term").agg(F.sum("df").alias("df"))
    )
    out = [0] * n_terms
    for row in dfs.collect():
        out[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    return n_docs, all_terms, out


@dataclass
class Items:
    """The items of one search: per item its distinct terms and how often it has
    each, the weight of each term, and what documents are measured by."""

    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    all_terms: int


class BlockSearch:
    """Items against the postings of one block."""

    def __init__(self, postings: Postings, items: Items):
        self.postings, self.items = postings, items
        # m of each length, in whole numbers of any size
        lengths, at = np.unique(postings.sizes, return_inverse=True)
        self.m = np.array([
            25 + 75 * n * items.n_docs // max(items.all_terms, 1) for n in lengths.tolist()
        ], np.int64)[at] if len(lengths) else np.zeros(0, np.int64)
        ends = np.cumsum(postings.dfs)
        self.starts = ends - postings.dfs
        impact = (1_000_000_000 * postings.tfs) // (
            1000 * postings.tfs + 8 * self.m[postings.docs])
        self.impact = impact * items.weights[np.repeat(postings.terms, postings.dfs)]
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(ends) else impact
        self.at = {term: i for i, term in enumerate(postings.terms.tolist())}

    def search(self, item: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that can be among the item's k best:
        all with at least ``least`` and not below the k-th best of the block."""
        held = [(self.at[t], n) for t, n in zip(
            self.items.terms[item].tolist(), self.items.repeats[item].tolist()) if t in self.at]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_docs = len(self.postings.sizes)
        step = max(1, CELLS // len(held))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first in range(0, n_docs, step):
            own, own_scores = self._slice(held, first, min(n_docs, first + step), k, least)
            places, scores = np.append(places, own), np.append(scores, own_scores)
            if len(scores) > k:
                stay = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                places, scores = places[stay], scores[stay]
                least = max(least, int(scores.min()))
        return places, scores

    def _slice(self, held, first: int, last: int, k: int, least: int):
        p = self.postings
        present = np.zeros((last - first, len(held)), bool)
        score_of = np.zeros((last - first, len(held)), np.int64)
        for j, (i, n) in enumerate(held):
            own = slice(self.starts[i], self.starts[i] + p.dfs[i])
            a, b = np.searchsorted(p.docs[own], (first, last))
            docs = p.docs[own][a:b] - first
            present[docs, j] = True
            score_of[docs, j] = n * self.impact[own][a:b]
        # documents of equal masks are neighbours, masks by descending maximum
        masks = np.packbits(present, axis=1)
        masks = np.ascontiguousarray(masks).view(f"V{masks.shape[1]}").ravel()
        _, some, group = np.unique(masks, return_index=True, return_inverse=True)
        most = present[some] @ np.array([n * self.most[i] for i, n in held], np.int64)
        order = np.argsort(-most[group], kind="stable")
        bounds = most[group][order]
        order = order[: np.searchsorted(-bounds, -max(least, 1), side="right")]
        scores, done = np.zeros(0, np.int64), 0
        while done < len(order):
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            if bounds[done] < least:
                break
            # whole groups: up to the end of the mask's maximum
            end = int(np.searchsorted(-bounds, -bounds[min(done + STEP, len(order)) - 1], "right"))
            scores = np.append(scores, score_of[order[done:end]].sum(axis=1))
            done = min(end, len(order))
        chosen = order[:done]
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        stay = scores >= max(least, 1)
        return chosen[stay] + first, scores[stay]


def candidates(
    postings: DataFrame, shared: Broadcast, k: int, least: np.ndarray | None = None
) -> DataFrame:
    """``(item, doc_id, score)`` of what can be among an item's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        bound = np.zeros(len(items.terms), np.int64) if least is None else least.copy()
        for batch in batches:
            for block in Postings.read(batch):
                yield from rows_of(BlockSearch(block, items), bound)

    def rows_of(search: BlockSearch, bound: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for item in range(len(bound)):
            places, scores = search.search(item, k, int(bound[item]))
            if not len(places):
                continue
            block = search.postings
            order = np.lexsort((block.ids[places], block.no_id[places], -scores))[:k]
            places, scores = places[order], scores[order]
            if len(scores) == k:
                bound[item] = max(bound[item], scores[-1])
            found.append((np.full(len(places), item), places, scores))
        if found:
            item, places, scores = (np.concatenate(part) for part in zip(*found))
            block = search.postings
            yield pa.RecordBatch.from_arrays([
                pa.array(item, pa.int32()),
                pa.array(block.ids[places], pa.int64(), mask=block.no_id[places]),
                pa.array(scores, pa.int64()),
            ], schema=FOUND)

    return postings.mapInArrow(run, spark_schema(FOUND))


def ranked(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _search_items(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    terms, repeats = [], []
    for row in items:
        codes = [number.setdefault(t, len(number)) for piece in terms_of(row["text"]) for t in piece]
        own, n = np.unique(np.array(codes, np.int64), return_counts=True)
        terms.append(own)
        repeats.append(n)
    postings, folder = write_postings(docs, number)
    n_docs, all_terms, by_term = weights(postings, len(number))
    shared = spark.sparkContext.broadcast(
        Items(terms, repeats, np.array(by_term, np.int64), n_docs, all_terms))
    seeds = (
        ranked(candidates(postings.where("seed"), shared, k), k).where(F.col("rank") == k)
        .select("item", "score").collect()  # a row an item
    )
    least = np.zeros(len(items), np.int64)
    for row in seeds:
        least[row["item"]] = row["score"]
    found = settle(candidates(postings, shared, k, least), "found")
    discard(spark, folder)
    best = ranked(found, k)
    names = spark.createDataFrame(
        [(i, row["item_id"]) for i, row in enumerate(items)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select(  # names of the items searched together
        F.col("item").alias("item_number"), "item_id", F.col("rank").cast("int").alias("rank"),
        "doc_id", "score")


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The k best documents of each item: ``(item_number, item_id, rank, doc_id, score)``.

    ``item_number`` tells items of one id apart, within a block of items.
    """
    docs = id_and_text(docs, id_col, text_col)
    items = items.select(
        F.col(f"`{item_id_col}`").cast("long").alias("item_id"),
        F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // item_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    parts = [
        _search_items(docs, items.where(place == i).orderBy("item_id", "text").collect(), k)
        for i in range(n)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
