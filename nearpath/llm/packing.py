"""Order-preserving packing of documents into training sequences.

Each task lines up the tokens of its documents in their order and chooses where
to cut the line into windows of at most ``length`` tokens. Cuts may fall at the
ends of documents and sentences, and every ``STRIDE`` tokens inside a stretch
without such an end. With p the place of a cut, the cheapest way up to cut j is

    f[j] = min over i of f[i] + padding(p[j] - p[i]) + penalty[j]

where padding is ``length`` less the window, or a small fixed cost for a window
that is a power of two, which is not padded. For the first kind f[i] + p[i] is all that depends on i, so a
monotone queue holds the minimum of the sliding window and each transition
takes constant time; the few powers of two are looked up. Nothing is shuffled.

A document's tokens are those of its words, found once for each distinct word
of a task, and the end token. A null or empty text has the end token only.
Equal rows are packed like any others.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from nearpath.llm.rows import id_and_text, slices, spark_schema, table

LENGTH = 2048
END_ID = 1
STRIDE = 256
LINE_TOKENS = 1 << 20
#: Bytes of words and ids that are remembered: twice this at most.
CACHE_BYTES = 48 << 20
#: What a remembered word takes beside its bytes and ids.
ENTRY_BYTES = 150
SLICE_BYTES = 1 << 20
SMALLEST_POWER = 64
#: What a cut costs, in tokens of padding.
IN_SENTENCE, AFTER_SENTENCE, AFTER_DOCUMENT = 64, 8, 0
#: What a shorter window without padding costs: it still makes one sequence more.
SHORT = 16

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("sequence_length", pa.int64()), ("ids", pa.binary()),
])


def choose_cuts(places: list[int], penalties: list[int], length: int = LENGTH) -> list[int]:
    """Indices of the cheapest cuts among ``places``, ascending from 0.

    The first and the last place are cut; neighbours are at most ``length`` apart.
    """
    powers = [1 << k for k in range(length.bit_length())
              if SMALLEST_POWER <= 1 << k < length]
    at = {p: i for i, p in enumerate(places)}
    cost, came = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque()
    for j in range(1, len(places)):
        p = places[j]
        i = j - 1
        key = cost[i] + places[i]
        while queue and cost[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
        while p - places[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = cost[i] + length - (p - places[i])
        for power in powers:
            other = at.get(p - power)
            if other is not None and cost[other] + SHORT < best:
                best, i = cost[other] + SHORT, other
        cost[j], came[j] = best + penalties[j], i
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


class WordEncoder:
    """Token ids of a text, word by word.

    The vocabulary's rules never look across white space, so the ids of a text
    are those of its words. Words of plain letters, digits and signs are merged
    by the byte-pair library with the same ranks: a word's last byte carries the
    word end, written as byte 0xFF, which UTF-8 has not. Other words, and texts
    with unusual white space, go through the vocabulary file's own rules.
    """

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        self.exact = Tokenizer.from_str(vocabulary)
        self.merges = self._merges()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.room = CACHE_BYTES
        self.end = np.uint32(end_id).tobytes()

    #: Letters that are their own composed form, with one lower-case letter each.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
    ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

    def _merges(self) -> tiktoken.Encoding:
        byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        ranks = {}
        for token, rank in self.exact.get_vocab(with_added_tokens=False).items():
            body = token.removesuffix("</w>")
            if body and all(symbol in byte_of for symbol in body):
                ranks[bytes(byte_of[s] for s in body) + b"\xff" * (body != token)] = rank
        ranks[b"\xff"] = max(ranks.values()) + 1000
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks,
                                 special_tokens={})

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            ids = []
            for part in self.PART.findall(text.lower()):
                ids += self.merges._core_bpe.encode_single_piece(part.encode() + b"\xff")
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def words(self, text: str) -> tuple[list[bytes], list[bytes]]:
        """The words of a text and the ids of each, little-endian."""
        if self.ODD_SPACE.search(text):
            return [b""], [np.array(self.exact.encode(text, add_special_tokens=False).ids,
                                    "<u4").tobytes()]
        words = text.encode().split()
        if self.room < 0:  # words not met since the last time are forgotten
            self.known, self.older, self.room = {}, self.known, CACHE_BYTES
        known, older = self.known, self.older
        for word in set(words).difference(known):
            ids = known[word] = older.get(word) or self.word(word)
            self.room -= len(word) + len(ids) + ENTRY_BYTES
        return words, list(map(known.__getitem__, words))


def byte_symbols() -> list[str]:
    """The printable characters by which byte-level vocabularies write bytes."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(0x100)]


SENTENCE_ENDS = (b".", b"!", b"?")


def sentence_ends(words: list[bytes], ids: list[bytes]) -> np.ndarray:
    """Places, in tokens of the document, after a word that ends a sentence."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    ends = np.cumsum(sizes)
    closing = [i for i, word in enumerate(words) if word.endswith(SENTENCE_ENDS)]
    return ends[closing]


class Line:
    """Documents waiting to be packed together."""

    def __init__(self, length: int):
        self.length = length
        self.documents: list[tuple[int | None, bytes, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes, ends: np.ndarray) -> None:
        self.documents.append((doc_id, ids, ends))
        self.tokens += len(ids) // 4

    def candidates(self) -> tuple[list[int], list[int]]:
        places, penalties = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        before = 0
        for _, ids, ends in self.documents:
            n = len(ids) // 4
            own = np.unique(np.append(ends[(ends > 0) & (ends < n)], n))
            gaps = np.diff(own, prepend=0)
            wide = np.flatnonzero(gaps > 2 * STRIDE)
            extra = [np.arange(own[i] - gaps[i] + STRIDE, own[i], STRIDE) for i in wide]
            costs = np.full(len(own), AFTER_SENTENCE)
            costs[-1] = AFTER_DOCUMENT
            if extra:
                inner = np.concatenate(extra)
                own, costs = np.append(own, inner), np.append(costs, np.full(len(inner), IN_SENTENCE))
                order = np.argsort(own, kind="stable")
                own, costs = own[order], costs[order]
            places.append(own + before)
            penalties.append(costs)
            before += n
        return np.concatenate(places).tolist(), np.concatenate(penalties).tolist()

    def pack(self, first_sequence: int, schema: pa.Schema = SCHEMA) -> tuple[dict[str, list], int]:
        """Rows of the pieces, and how many sequences there are."""
        places, penalties = self.candidates()
        cuts = [places[i] for i in choose_cuts(places, penalties, self.length)]
        out = {name: [] for name in schema.names}
        sequence, begin = 0, 0
        for doc_id, ids, _ in self.documents:
            n, start = len(ids) // 4, 0
            while start < n:
                while cuts[sequence + 1] <= begin + start:
                    sequence += 1
                stop = min(n, cuts[sequence + 1] - begin)
                piece = ids[4 * start:4 * stop]
                for name, value in zip(schema.names, (
                    doc_id, start, stop - start, zlib.crc32(piece), n,
                    first_sequence + sequence, begin + start - cuts[sequence],
                    cuts[sequence + 1] - cuts[sequence], piece,
                )):
                    out[name].append(value)
                start = stop
            begin += n
        return out, len(cuts) - 1


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents with their places and, last, their ids.

    ``sequence_id`` is unique, not gapless: the task's number above 2**33.
    """
    schema = SCHEMA if with_ids else SCHEMA.remove(SCHEMA.get_field_index("ids"))
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()  # a vocabulary's size, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary, end_id)
        line, sequence = Line(length), TaskContext.get().partitionId() << 33
        for part in (part for batch in batches for part in slices(batch, "text", SLICE_BYTES)):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words, ids = encoder.words(text)
                line.add(doc_id, b"".join(ids) + encoder.end, sentence_ends(words, ids))
                if line.tokens >= LINE_TOKENS:
                    out, n = line.pack(sequence, schema)
                    line, sequence = Line(length), sequence + n
                    yield table(schema, out)
                    del out
        if line.documents:
            yield table(schema, line.pack(sequence, schema)[0])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, spark_schema(schema))
