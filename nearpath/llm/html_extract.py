"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks. A bidirectional LSTM sees
each block's tag path (names of elements and their classes), all its words,
hashed and counted, and a few numbers, and with all blocks before and after it decides whether the block
is part of the article. The article's blocks are joined in page order.

The labeller is trained when the operator is built: on ``TRAIN_PAGES`` pages
laid out at random with known parts. Their words come from the first
``WORD_CHARS`` characters of about ``WORD_PAGES`` pages of the table: where a
page's marks tell that a block is article, menu, advert and so on, its words
train the same kind of part. What words cannot tell, the layout has to. The
bounds of the sample limit only what is learned, never what is extracted. Everything else
is done page by page in the tasks that read them, without a shuffle.

A null or empty html, or one without article blocks, gives an empty text.
Broken mark-up is read as far as it goes. Equal rows get equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.llm.bilstm import BiLSTM, padded
from nearpath.llm.html_blocks import SIZE, Leaf, leaves, vectors
from nearpath.llm.html_layouts import NO, YES, Maker, PartWords
from nearpath.llm.rows import spark_schema, table

TRAIN_PAGES = 2000
WORD_PAGES = 100
WORD_CHARS = 100_000
PAGES_AT_ONCE = 256
STEPS_AT_ONCE = 1 << 15
BLOCKS_AT_ONCE = 1 << 14

SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()),
    ("n_chars", pa.int64()), ("n_blocks", pa.int64()),
])


def made_example(page: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a made page."""
    blocks = leaves(page)
    labels = np.array([YES in block.text for block in blocks], np.float32)
    for block in blocks:
        block.text = block.text.replace(YES, "").replace(NO, "") or "-"
        block.link_chars = min(block.link_chars, len(block.text))
    return vectors(blocks, known), labels


def train(words: PartWords | list[str], pages: int = TRAIN_PAGES, seed: int = 3) -> BiLSTM:
    maker, known = Maker(words, seed), {}
    examples = [made_example(maker.page(), known) for _ in range(pages)]
    model = BiLSTM(SIZE)
    model.fit([x for x, _ in examples], [y for _, y in examples])
    return model


def label(model: BiLSTM, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence which blocks are article. Sequences of like length
    run together, no more than ``STEPS_AT_ONCE`` steps at a time."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
    while order:
        count = max(1, min(PAGES_AT_ONCE, len(order), STEPS_AT_ONCE // len(sequences[order[-1]])))
        now, order = order[-count:], order[:-count]
        odds = model.log_odds(*padded([sequences[i] for i in now]))
        for k, i in enumerate(now):
            out[i] = odds[: len(sequences[i]), k] > 0
    return out


def sample_words(pages: DataFrame, n: int = WORD_PAGES) -> PartWords:
    """Words of about ``n`` pages by part, chosen by the hash of their ids; at most
    twice as many rows come to the driver, each cut at ``WORD_CHARS`` characters."""
    place = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30))
    share = n / max(1, pages.count())
    rows = (
        pages.where(place < min(1.0, share) * (1 << 30))
        .select(F.substring("html", 1, WORD_CHARS).alias("html")).limit(2 * n).collect()
    )
    return PartWords(leaves(page) for page in sorted(row["html"] or "" for row in rows))


def parts_of(pages: list[str]) -> Iterator[tuple[int, list[list[Leaf]]]]:
    """The pages' blocks, some pages at a time: no more than ``PAGES_AT_ONCE``, and
    no more after ``BLOCKS_AT_ONCE`` blocks; with the first page's place."""
    start, found, n = 0, [], 0
    for i, page in enumerate(pages):
        found.append(leaves(page))
        n += len(found[-1])
        if len(found) == PAGES_AT_ONCE or n >= BLOCKS_AT_ONCE or i == len(pages) - 1:
            yield start, found
            start, found, n = i + 1, [], 0


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` and the number of article blocks."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                         F.coalesce("html", F.lit("")).alias("html"))
    model = train(sample_words(pages), train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for start, found in parts_of(batch.column("html").to_pylist()):
                part = batch.slice(start, len(found))
                chosen = label(model, [vectors(blocks, known) for blocks in found])
                texts = [
                    " ".join(b.text for b, yes in zip(blocks, picks.tolist()) if yes)
                    for blocks, picks in zip(found, chosen)
                ]
                yield table(SCHEMA, {
                    "page_id": part.column("page_id").to_pylist(),
                    "url": part.column("url").to_pylist(),
                    "text": texts,
                    "n_chars": [len(text) for text in texts],
                    "n_blocks": [int(picks.sum()) for picks in chosen],
                })

    return pages.mapInArrow(run, spark_schema(SCHEMA))
