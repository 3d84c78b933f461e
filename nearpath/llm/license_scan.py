"""Fuzzy search for short licence notices.

A text becomes its words, lower-cased and joined by one blank. A notice of
which at most k characters may be wrong is cut into k + 2 pieces; two of them
must occur unchanged, near their places. An Aho-Corasick automaton finds the
pieces, two that agree name a place where the notice could stand, and only
there the ``regex`` library matches it with at most k errors and reports span
and edits.
The base phrases are notices with no error allowed. Documents are scanned
where they lie, without a shuffle.

Null and empty texts have no words and no labels. Equal rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nearpath.llm.rows import id_and_text, spark_schema, table

#: Bytes of UTF-8 to their lower case; whatever cannot be in a word to a blank.
FOLD = bytes(
    c + 32 if ord("A") <= c <= ord("Z")
    else c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else 0x20
    for c in range(0x100)
)

#: The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Words of well-known notices, their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this work is licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
    "without warranty of any kind": "no-warranty",
}

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
    ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string()),
])


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    errors: int

    @property
    def pieces(self) -> list[tuple[int, str]]:
        """``errors + 2`` pieces of nearly equal length, with their places."""
        n, k = len(self.words), self.errors + 2
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.words[a:b]) for a, b in zip(cuts, cuts[1:])]


def notices(table: dict[str, str], chars_per_error: int) -> list[Notice]:
    """One error for each ``chars_per_error`` characters."""
    return [Notice(words, label, len(words) // chars_per_error) for words, label in table.items()]


class Scanner:
    def __init__(self, phrases: dict[str, str], fuzzy: list[Notice]):
        self.phrases, self.fuzzy = phrases, fuzzy
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(fuzzy):
            for offset, piece in notice.pieces:
                at.setdefault(piece, []).append((i, offset))
        for phrase in phrases:
            at.setdefault(f" {phrase} ", []).append((-1, 0))
        for piece, uses in at.items():
            self.seeds.add_word(piece, (piece, uses))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(f"(?e)(?:{regex.escape(n.words)}){{e<={n.errors}}}") for n in fuzzy
        ]

    def scan(self, text: str) -> dict:
        words = text.encode().translate(FOLD).split()
        joined = f" {b' '.join(words).decode()} "
        base: list[tuple[int, str]] = []
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (piece, uses) in self.seeds.iter(joined):
            start = end - len(piece) + 1
            for i, offset in uses:
                if i < 0:
                    base.append((start, self.phrases[piece[1:-1]]))
                else:
                    hits.setdefault(i, []).append((start - offset, offset))
        spans = set()
        for i, found in hits.items():
            notice = self.fuzzy[i]
            for low, high in windows(sorted(found), notice):
                for match in self.patterns[i].finditer(joined, max(low, 0), min(high, len(joined))):
                    spans.add((match.start(), match.end(), notice.label,
                               1 - sum(match.fuzzy_counts) / len(notice.words)))
        blanks = np.zeros(0, np.int64)  # words are numbered once, by the blanks before them
        if base or spans:
            blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 0x20)
        starts = np.searchsorted(blanks, [at for at, _ in base]).tolist()
        base_labels = {label for _, label in base}
        labels = base_labels | {label for _, _, label, _ in spans}
        scores = [s for *_, s in spans] + [1.0] * bool(base)
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": max(scores, default=0.0),
            # words from and up to, label
            "spans": ";".join(
                f"{max(int(np.searchsorted(blanks, a + 1)) - 1, 0)}-{np.searchsorted(blanks, b)}:{label}"
                for a, b, label, _ in sorted(spans)
            ),
        }


def windows(hits: list[tuple[int, int]], notice: Notice) -> list[tuple[int, int]]:
    """Where the notice could stand: two different pieces that agree on its start
    up to its errors. ``hits`` are (start of the notice, offset of the piece)."""
    out: list[tuple[int, int]] = []
    for k, (start, offset) in enumerate(hits):
        near = k + 1
        while near < len(hits) and hits[near][0] - start <= 2 * notice.errors:
            if hits[near][1] != offset:
                low = start - notice.errors
                high = hits[near][0] + len(notice.words) + notice.errors
                if out and low <= out[-1][1]:
                    out[-1] = (out[-1][0], max(high, out[-1][1]))
                else:
                    out.append((low, high))
            near += 1
    return out


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    table_of_notices: dict[str, str] | None = None,
    chars_per_error: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Labels, spans and word places of the notices in every row.

    ``score`` is the share of right characters of the best notice found, 1 for
    a base phrase and 0 without any. ``spans`` lists ``from-to:label`` in words.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    fuzzy = notices(NOTICES if table_of_notices is None else table_of_notices, chars_per_error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, fuzzy)
        for batch in batches:
            rows = [scanner.scan(text) for text in batch.column("text").to_pylist()]
            columns = {name: [row[name] for row in rows] for name in SCHEMA.names[1:]}
            yield table(SCHEMA, {"doc_id": batch.column("doc_id").to_pylist()} | columns)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, spark_schema(SCHEMA))
