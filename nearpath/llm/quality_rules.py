"""Quality rules over the repeated substrings of a document.

A suffix array of the words of each document gives its longest-common-prefix
intervals; the deepest interval of a place tells how long a passage from there
is found again. Their spans are joined, and a document fails when too many of
its characters lie in them or when one passage is too long. Each document is
judged alone, so nothing is shuffled; documents are sorted together, about a
million words at a time, only to spare numpy calls.

Null and empty texts have no words and fail the word count. Rows are judged one
by one: equal rows get equal results, other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearpath.llm.rows import id_and_text, slices, spark_schema
from nearpath.llm.suffixes import covered, longest_repeats, neighbour_prefixes, suffix_order

WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANK = " \t\n\v\f\r"
CHUNK_BYTES = 5 << 20

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("repeat_fraction", pa.float64()), ("longest_repeat", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()),
])


@dataclass(frozen=True)
class QualityRules:
    """Limits a document must keep.

    ``min_repeat``: words a repeated passage needs to count.
    ``max_fraction``: share of the word characters in repeated passages.
    ``max_longest``: words of the longest repeated passage.
    ``max_longest_share``: the same as a share of all words.
    ``max_symbols``: symbols per word character.

    The limits act beside the base rule, which counts words: repeated passages of
    long words fail by their characters, one long passage in a short text by its
    share, in a long one by its words.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    min_repeat: int = 5
    max_fraction: float = 0.18
    max_longest: int = 250
    max_longest_share: float = 0.1
    max_symbols: float = 0.1


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return len(lines) - len(set(lines))


def judge(ids: list, texts: list[str], rules: QualityRules) -> pa.RecordBatch:
    """One row per document, of documents that are sorted together."""
    number = defaultdict(count().__next__)
    codes, sizes, owners, rows = [], [], [], []
    for i, text in enumerate(texts):
        words = text.encode().split()  # at the white space of ASCII only
        codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        sizes.append(np.fromiter(map(len, map(bytes.decode, words)), np.int64, len(words)))
        owners.append(np.full(len(words), i))
        rows.append((len(words), len(SYMBOLS.findall(text)), duplicate_lines(text)))
    codes, sizes, owners = map(np.concatenate, (codes, sizes, owners))
    order, levels = suffix_order(codes, owners)
    repeat = longest_repeats(order, neighbour_prefixes(order, levels))

    n = len(codes)
    windows = np.flatnonzero(repeat >= WINDOW)
    in_window = covered(windows, np.full(len(windows), WINDOW), n)
    passages = np.flatnonzero(repeat >= rules.min_repeat)
    in_passage = covered(passages, repeat[passages], n)

    def per_document(values: np.ndarray) -> np.ndarray:
        return np.bincount(owners, values, len(texts))

    n_words, n_symbols, n_dup_lines = np.array(rows, np.int64).reshape(-1, 3).T
    chars = per_document(sizes).astype(np.int64)
    n_repeat = per_document(in_window).astype(np.int64)
    fraction = per_document(in_passage * sizes) / np.maximum(chars, 1)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owners, repeat)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    kept = (
        ~base_failed
        & (fraction <= rules.max_fraction)
        & (longest <= rules.max_longest)
        & (longest <= rules.max_longest_share * n_words)
        & (n_symbols <= rules.max_symbols * chars)
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64())]
        + [pa.array(a) for a in (
            n_words, chars, n_symbols, n_dup_lines, n_repeat, fraction, longest, base_failed, kept)],
        schema=SCHEMA,
    )


def quality_rules(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The measures and the verdict of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                yield judge(part.column(0).to_pylist(), part.column(1).to_pylist(), rules)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, spark_schema(SCHEMA))


def keep_good(
    docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text"
) -> DataFrame:
    """The rows the rules keep, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, CHUNK_BYTES):
                texts = [text or "" for text in part.column(text_col).to_pylist()]
                verdict = judge([None] * len(texts), texts, rules).column("kept")
                yield part.filter(verdict)

    return docs.mapInArrow(run, docs.schema)
