"""Subword lattice likelihood.

A text's probability is the sum over all ways of cutting its words into pieces
of an existing vocabulary, each way the product of the pieces' unigram
probabilities. Pieces do not cross words, so a text's log probability is the
sum of its words', and each distinct word of the corpus needs one forward
recursion. The vocabulary is taken as it is; the probability of a piece is
learned from the training documents: how often the vocabulary's own cutting of
their words uses it, plus 0.1. A character outside the vocabulary is spelt in
bytes, which are pieces too, so every text has a probability.

Three shuffles of distinct words: blocks send words and training counts to the
words' shards, which sum them and count pieces; the pieces' totals, one row
each, go to all tasks; shards answer each block with counts and probabilities,
and the block adds up its documents.

A null or empty text is one end token. Repeated rows count and are scored like
any others. Without training documents all counts are zero.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.llm import exchange
from nearpath.llm.rows import id_and_text, input_tasks, spark_schema
from nearpath.sources.workdir import settle

SMOOTHING = 0.1
FOLDS = 10
LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(0x100))
#: Stands before each word, as the vocabulary writes it.
MARK = "▁"
UNUSED = -1e6
#: Rows of the piece counts that are sums over words.
ALL_WORDS, DISTINCT_WORDS = -1, -2
LOG10 = math.log(10)

SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("word_base", pa.float64()), ("word_score", pa.float64()),
])


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


def words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


class Lattice:
    """The vocabulary's pieces and their log probabilities."""

    def __init__(self, model: bytes, log_probability: np.ndarray):
        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = ahocorasick.Automaton()
        self.bytes = np.zeros(256)
        for i in range(vocabulary.get_piece_size()):
            piece = vocabulary.id_to_piece(i)
            if vocabulary.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = log_probability[i]
            elif usable(vocabulary, i):
                self.pieces.add_word(piece, (len(piece), float(log_probability[i])))
        self.pieces.make_automaton()
        self.letters = {p: w for p, (n, w) in self.pieces.items() if n == 1}

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all cuttings: forward recursion in log space."""
        text = MARK + word
        forward = [0.0] + [-math.inf] * len(text)
        reached = 0
        log, exp = math.log, math.exp

        def spell(stop: int) -> None:
            """Characters without a piece of their own, byte by byte."""
            nonlocal reached
            while reached < stop:
                letter = text[reached]
                if letter not in self.letters:
                    way = forward[reached] + float(self.bytes[list(letter.encode())].sum())
                    forward[reached + 1] = _add(forward[reached + 1], way)
                reached += 1

        for end, (size, weight) in self.pieces.iter(text):
            if end > reached:
                spell(end)
            way = forward[end + 1 - size] + weight
            have = forward[end + 1]
            if have == -math.inf:
                forward[end + 1] = way
            elif way > have:
                forward[end + 1] = way + log(1 + exp(have - way))
            else:
                forward[end + 1] = have + log(1 + exp(way - have))
        spell(len(text))
        return forward[-1]


def _add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def usable(vocabulary: sentencepiece.SentencePieceProcessor, i: int) -> bool:
    """Not a control sign, and not one of the vocabulary's unreachable pieces."""
    return not (
        vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i)
        or vocabulary.get_score(i) < UNUSED
    )


def piece_probabilities(model: bytes, counts: dict[int, int], n_ends: int) -> tuple:
    """Log probabilities by piece id, and that of the end of a text."""
    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = vocabulary.get_piece_size()
    weights = np.array([
        counts.get(i, 0) + SMOOTHING if usable(vocabulary, i) else 0.0 for i in range(size)
    ])
    total = weights.sum() + n_ends + SMOOTHING
    with np.errstate(divide="ignore"):
        return np.log(weights / total), math.log((n_ends + SMOOTHING) / total)


def lattice_scores(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The base score and the lattice score of every row, learned from those
    that are not held out."""
    docs = id_and_text(docs, id_col, text_col)
    shards = input_tasks(docs)
    with open(model_path, "rb") as file:
        model = file.read()  # a vocabulary's size, not the data's

    def count(rows: pa.RecordBatch) -> dict[bytes, int]:
        """Training count of each distinct word, 0 for held-out words."""
        held: set[bytes] = set()
        counts: Counter[bytes] = Counter()
        for doc_id, text in zip(*(rows.column(n).to_pylist() for n in ("doc_id", "text"))):
            (held if is_held_out(doc_id) else counts).update(words(text))
        return dict.fromkeys(held, 0) | counts

    def ask(rows: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        counts = count(rows)
        for shard, own in (exchange.by_shard(counts, shards) or {0: []}).items():
            numbers = np.fromiter(map(counts.__getitem__, own), "<u4", len(own))
            yield shard, exchange.pack_bytes(
                [zstandard.compress(numbers.tobytes()), exchange.pack_bytes(own)])

    def unpack(payload: bytes) -> tuple[list[bytes], np.ndarray]:
        numbers, own = exchange.unpack_bytes(payload)
        return exchange.unpack_bytes(own), np.frombuffer(zstandard.decompress(numbers), "<u4")

    def total(payloads: list[bytes]) -> dict[bytes, int]:
        counts: dict[bytes, int] = {}
        for payload in payloads:
            own, numbers = unpack(payload)
            for word, number in zip(own, numbers.tolist()):
                counts[word] = counts.get(word, 0) + number
        return counts

    def count_pieces(group: pa.Table) -> pa.Table:
        vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model)
        used = np.zeros(vocabulary.get_piece_size(), np.int64)
        known = {w: c for w, c in total(group.column("payload").to_pylist()).items() if c}
        cut = vocabulary.encode([word.decode() for word in known], num_threads=1)
        for pieces, number in zip(cut, known.values()):
            for piece in pieces:
                used[piece] += number
        at = np.flatnonzero(used)
        sums = [sum(known.values()), len(known)]
        return pa.table({
            "piece": pa.array(np.append(at, [ALL_WORDS, DISTINCT_WORDS]), pa.int64()),
            "n": pa.array(np.append(used[at], sums), pa.int64()),
        })

    asked = settle(exchange.requests(docs, ask), "word-requests")
    sums = exchange.by_shard_group(asked, shards, count_pieces, "piece long, n long")
    # a row for each piece of the vocabulary
    counts = {r["piece"]: r["n"] for r in sums.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    n_ends = docs.where(fold != 0).count()
    n_train = counts.pop(ALL_WORDS, 0) + n_ends
    n_distinct = counts.pop(DISTINCT_WORDS, 0) + (1 if n_ends else 0)
    probabilities, end_score = piece_probabilities(model, counts, n_ends)

    def answer(group: pa.Table) -> pa.Table:
        lattice = Lattice(model, probabilities)
        payloads = group.column("payload").to_pylist()
        known = {
            word: (number, lattice.log_probability(word.decode()))
            for word, number in total(payloads).items()
        }
        out = []
        for payload in payloads:
            own, _ = unpack(payload)
            values = [known[word] for word in own]
            out.append(zstandard.compress(
                np.array([c for c, _ in values], "<i8").tobytes()
                + np.array([p for _, p in values], "<f8").tobytes()))
        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"),
            "payload": pa.array(out, pa.binary()),
        })

    def finish(rows: pa.Table, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = (rows.column(name).to_pylist() for name in ("doc_id", "text"))
        number: dict[bytes, int] = {}
        found_counts, found_scores = [], []
        distinct = set()
        for text in texts:
            distinct.update(words(text))
        for shard, own in exchange.by_shard(distinct, shards).items():
            raw = zstandard.decompress(got[shard])
            found_counts.append(np.frombuffer(raw, "<i8", len(own)))
            found_scores.append(np.frombuffer(raw, "<f8", len(own), 8 * len(own)))
            number.update(zip(own, range(len(number), len(number) + len(own))))
        c = np.concatenate(found_counts) if found_counts else np.zeros(0, np.int64)
        score = np.concatenate(found_scores) if found_scores else np.zeros(0)
        base = np.log10(c + SMOOTHING)
        out = []
        for doc_id, text in zip(ids, texts):
            own = words(text)
            at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            out.append((doc_id, is_held_out(doc_id), len(own) + 1, int((c[at] > 0).sum()),
                        float(base[at].sum()), float(score[at].sum())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(column), f.type) for column, f in zip(zip(*out), SCORED)],
            schema=SCORED)

    answers = exchange.by_shard_group(asked, shards, answer, exchange.REQUESTS)
    scored = exchange.with_answers(docs, answers, finish, SCORED, spark_schema(SCORED))
    norm = math.log10(n_train + SMOOTHING * (n_distinct + 1))
    return scored.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + (1 if n_ends else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("word_base") + math.log10(n_ends + SMOOTHING) - F.col("n_tokens") * norm)
        .alias("base_score"),
        ((F.col("word_score") + end_score) / LOG10).alias("score"),
    )
