"""Repeated passages across documents, found by sharded phrase automata.

A passage is ``WINDOW`` consecutive words. Each window has a key, the smallest
hash among its five-word runs, so equal windows have equal keys, and windows
side by side mostly share one: about a fifth as many keys as words.

1. Blocks of documents ask key shards which keys occur in two documents.
2. Stretches of windows with such a key are candidate passages. Each block
   sends its distinct ones, packed, with the smallest and largest document
   holding them, to the shards of their keys; a passage of a third of all
   documents is sent once a block.
3. Each shard confirms the phrases found in two documents (a window, or a
   stretch of windows that only one passage has), compiles them into an
   Aho-Corasick automaton over word numbers, with the smallest document of
   each, and streams its passages through it to locate every occurrence.
4. The places go back to the blocks, where words covered by a window of a
   smaller document are taken out.

Keys only choose candidates; windows are compared word by word. A key that more
than ``HOT`` documents have would bring all their passages to one shard: its
windows are dealt one by one, by the hash of all their words, so that a five-word
run in a third of all documents, amid different words, spreads over all shards. White space is
that of ASCII. Null and empty texts keep no words. A row without an id is left
as it is and removes nothing; rows of one id remove nothing from each other.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from nearpath.llm import exchange
from nearpath.llm.fingerprint import mix, rolling
from nearpath.llm.rows import id_and_text, input_tasks, nullable, spark_schema, table
from nearpath.llm.suffixes import covered
from nearpath.sources.workdir import work_dir

WINDOW = 13
RUN = 5
HOT = 4096
#: Of the words' hashes: an odd number, and the bytes hashed at once.
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20

DOCUMENT, PASSAGE, BLOCK = 0, 1, 2
SHARED, CUT = 1, 2

#: One table for what the blocks find: finished documents, passages, and the
#: documents of a block that hold passages.
FOUND = pa.schema([
    ("kind", pa.int32()), ("block", pa.binary()), ("shard", pa.int32()), ("payload", pa.binary()),
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
    ("kept_text", pa.string()),
])
KEPT = pa.schema([FOUND.field(n) for n in ("doc_id", "n_words", "n_removed", "kept_text")])


def window_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each window of a document, given its words' hashes."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        low = mix(rolling(hashes, RUN))
    width, have = WINDOW - RUN + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal keys."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return first, np.append(first[1:], len(keys))[: len(first)] - 1


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, from running sums of its bytes' powers."""
    parts = [_word_hashes(text[a:b]) for a, b in _pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``PIECE`` bytes that end between words."""
    start = 0
    while start < len(text):
        end = start + PIECE
        blank = _BLANK.search(text, end) if end < len(text) else None
        end = blank.start() if blank else len(text)
        yield start, end
        start = end


def _word_hashes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_BLANK[data]
    edge = inside[1:] != inside[:-1]
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[::2], bounds[1::2]
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


#: Filled by the task that needs them.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    kept = _POWERS
    if len(kept[0]) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            with np.errstate(over="ignore"):
                kept[i] = np.cumprod(factors)
    return kept


class Keys:
    """The runs of windows of a block's documents that share a key."""

    def __init__(self, texts: list[str]):
        self.n_words, self.first, self.last, keys, owner = [], [], [], [], []
        for i, text in enumerate(texts):
            hashes = word_hashes(text.encode())
            self.n_words.append(len(hashes))
            own = window_keys(hashes)
            first, last = runs(own)
            self.first.append(first)
            self.last.append(last)
            keys.append(own[first])
            owner.append(np.full(len(first), i))
        self.owner = np.concatenate(owner or [np.zeros(0, np.int64)])
        self.keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
        self.ends = np.cumsum([len(first) for first in self.first])

    def asked(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By shard the distinct keys, and how many documents have each (255: or more)."""
        order = np.argsort(self.keys, kind="stable")  # owners ascend within a key
        keys, owner = self.keys[order], self.owner[order]
        head = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        another = head | np.append(True, owner[1:] != owner[:-1])[: len(keys)]
        distinct = keys[head]
        n = np.bincount(np.cumsum(head) - 1, another, len(distinct))
        n = np.minimum(n, 255).astype(np.uint8)
        home = (distinct % np.uint64(shards)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[by_home])) + 1
        for part in np.split(by_home, cuts) if len(by_home) else []:
            yield int(home[part[0]]), distinct[part], n[part]


def shorten(keys: np.ndarray) -> bytes:
    """The upper six bytes of each key: enough to choose candidates by."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def lengthen(short: bytes) -> np.ndarray:
    out = np.zeros((len(short) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(short, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


class Phrases:
    """What the passages of a shard have in common, by the hashes of their words.

    ``windows`` are the passage and place of windows that several passages hold,
    two documents together; ``stretches`` the passage, first and last place of
    neighbouring windows that no other passage holds, of passages in two documents.
    """

    def __init__(self, passages: list[bytes], lows: np.ndarray, highs: np.ndarray):
        words = word_hashes(b"\n".join(passages))
        sizes = words_in(passages)
        self.windows, self.stretches = [], []
        if len(words) < WINDOW:
            return
        with np.errstate(over="ignore"):
            hashes = mix(rolling(words, WINDOW))
        owner = np.repeat(np.arange(len(passages)), sizes)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.flatnonzero(place[: len(hashes)] + WINDOW <= sizes[owner[: len(hashes)]])
        order = whole[np.argsort(hashes[whole])]
        head = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0)[: len(order)])
        if not len(head):
            return
        own = owner[order]
        single = np.minimum.reduceat(own, head) == np.maximum.reduceat(own, head)
        two = np.minimum.reduceat(lows[own], head) < np.maximum.reduceat(highs[own], head)
        n = np.diff(np.append(head, len(order)))
        mixed = np.repeat(two & ~single, n)
        self.windows = list(zip(own[mixed].tolist(), place[order][mixed].tolist()))
        alone = np.sort(order[np.repeat(two & single, n)])
        first = np.append(True, (np.diff(alone) != 1) | (np.diff(owner[alone]) != 0))[: len(alone)]
        last = np.append(first[1:], True)[: len(alone)]
        self.stretches = list(zip(owner[alone[first]].tolist(), place[alone[first]].tolist(),
                                  place[alone[last]].tolist()))


def words_in(passages: list[bytes]) -> np.ndarray:
    """Words of each passage; blanks stand singly between them."""
    return np.fromiter((p.count(b" ") + 1 for p in passages), np.int64, len(passages))


def pack_passages(own: list[bytes], passages: dict[bytes, list]) -> bytes:
    """Texts, of which none has a line feed, with the smallest and largest
    document of each."""
    held = np.array([[len(own), len(own)], *(passages[passage][2:] for passage in own)], np.int64)
    return zstandard.compress(held.tobytes() + b"\n".join(own), 3)


def unpack_passages(packed: bytes) -> tuple[list[bytes], list[int], list[int]]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    low, high = np.frombuffer(raw, np.int64, 2 * n, 16).reshape(n, 2).T.tolist()
    return raw[16 * (n + 1):].split(b"\n"), low, high


def found_rows(rest: pa.Array, columns: dict) -> pa.RecordBatch:
    """Rows of ``FOUND`` with these columns, others null, and ``rest``."""
    made = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rest), f.type)
            for f in FOUND]
    return pa.RecordBatch.from_arrays([*made, rest], names=[*FOUND.names, "rest"])


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row with its text less the words of repeated passages.

    ``kept_text`` joins the kept words by one blank; a text of which nothing is
    taken stays as it is. ``rest`` holds the other columns, as they are.
    """
    docs = id_and_text(docs, id_col, text_col, carry=True)
    shards = input_tasks(docs)
    passage_shards = 4 * shards
    rest_type = nullable(docs.schema["rest"].dataType)
    rest_arrow = to_arrow_type(rest_type)

    def ask(rows: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        asked = list(Keys(rows.column("text").to_pylist()).asked(shards))
        for shard, keys, n in asked or [(0, np.zeros(0, np.uint64), np.zeros(0, np.uint8))]:
            yield shard, zstandard.compress(shorten(keys) + n.tobytes(), 1)

    def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = zstandard.decompress(payload)
        n = len(raw) // 7
        return lengthen(raw[: 6 * n]), np.frombuffer(raw, np.uint8, n, 6 * n)

    def recurring(group: pa.Table) -> pa.Table:
        asked = [unpack(p) for p in group.column("payload").to_pylist()]
        everything = np.concatenate([keys for keys, _ in asked])
        _, inverse = np.unique(everything, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([n for _, n in asked]))
        flags = np.where(total > HOT, CUT, np.where(total > 1, SHARED, 0)).astype(np.uint8)
        parts = np.split(flags[inverse], np.cumsum([len(keys) for keys, _ in asked])[:-1])
        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"),
            "payload": pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary()),
        })

    def candidates(rows: pa.Table, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
        rests = one_array(rows.column("rest")).cast(rest_arrow)
        keys = Keys(texts)
        asked, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for shard, own, _ in keys.asked(shards):
            asked.append(own)
            flags.append(np.frombuffer(zstandard.decompress(got[shard]), np.uint8))
        asked, flags = np.concatenate(asked), np.concatenate(flags)
        if len(asked):
            order = np.argsort(asked)
            flags = flags[order][np.searchsorted(asked[order], keys.keys)]
        finished, held, done, waiting = [], [], [], []
        passages: dict[bytes, list] = {}
        sent: dict[int, list] = {}

        def ref(passage: bytes, home: int, doc_id: int) -> tuple[int, int]:
            """Shard and number of a passage that goes there with its documents."""
            seen = passages.get(passage)
            if seen is None:
                own = sent.setdefault(home, [])
                seen = passages[passage] = [home, len(own), doc_id, doc_id]
                own.append(passage)
            elif doc_id < seen[2]:
                seen[2] = doc_id
            elif doc_id > seen[3]:
                seen[3] = doc_id
            return seen[0], seen[1]

        for i, (doc_id, text) in enumerate(zip(ids, texts)):
            mine = slice(keys.ends[i] - len(keys.first[i]), keys.ends[i])
            hits = np.flatnonzero(flags[mine])
            if doc_id is None or not len(hits):
                finished.append((DOCUMENT, doc_id, keys.n_words[i], 0, text))
                done.append(i)
                continue
            words, refs = text.encode().split(), []
            homes = (keys.keys[mine][hits] % np.uint64(passage_shards)).tolist()
            for a, b, home, flag in zip(keys.first[i][hits].tolist(), keys.last[i][hits].tolist(),
                                        homes, flags[mine][hits].tolist()):
                if flag == SHARED:
                    refs.append((a, *ref(b" ".join(words[a:b + WINDOW]), home, doc_id)))
                    continue
                for place in range(a, b + 1):
                    window = b" ".join(words[place:place + WINDOW])
                    home = xxhash.xxh3_64_intdigest(window) % passage_shards
                    refs.append((place, *ref(window, home, doc_id)))
            held.append((doc_id, text, refs))
            waiting.append(i)
        if finished:
            yield found_rows(rests.take(pa.array(done)), dict(zip(
                ("kind", "doc_id", "n_words", "n_removed", "kept_text"), zip(*finished))))
        if held:
            rest = pa.RecordBatch.from_arrays([rests.take(pa.array(waiting))], ["rest"])
            packed = zstandard.compress(pickle.dumps((held, exchange.pack_rows(rest))), 3)
            block = xxhash.xxh3_128_digest(packed)
            yield found_rows(pa.nulls(1, rests.type), {
                "kind": [BLOCK], "block": [block], "payload": [packed]})
            payloads = [pack_passages(own, passages) for own in sent.values()]
            yield found_rows(pa.nulls(len(sent), rests.type), {
                "kind": [PASSAGE] * len(sent), "block": [block] * len(sent), "shard": list(sent),
                "payload": payloads})

    def locate(group: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        lows, highs, asked = [], [], []
        for payload in group.column("payload").to_pylist():
            own, low, high = unpack_passages(payload)
            places = []
            for passage, a, b in zip(own, low, high):
                at = index.setdefault(passage, len(index))
                if at == len(lows):
                    lows.append(a)
                    highs.append(b)
                else:
                    lows[at], highs[at] = min(lows[at], a), max(highs[at], b)
                places.append(at)
            asked.append(places)
        everything = list(index)
        phrases = Phrases(everything, np.array(lows, np.int64), np.array(highs, np.int64))
        number = defaultdict(count().__next__)
        codes = {
            i: tuple(map(number.__getitem__, everything[i].split()))
            for i in sorted({i for i, _ in phrases.windows} | {i for i, _, _ in phrases.stretches})
        }
        holders: dict[tuple, list[int]] = {}
        for i, place in phrases.windows:
            window = codes[i][place:place + WINDOW]
            seen = holders.setdefault(window, [lows[i], highs[i]])
            seen[0], seen[1] = min(seen[0], lows[i]), max(seen[1], highs[i])
        for i, first, last in phrases.stretches:
            holders[codes[i][first:last + WINDOW]] = [lows[i], highs[i]]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, (low, high) in holders.items():
            if low < high:  # confirmed: two documents
                automaton.add_word(phrase, (len(phrase), low))
        located: dict[int, np.ndarray] = {}
        if len(automaton):
            automaton.make_automaton()
            for i, own in codes.items():
                places = [(end - n + 1, end + 1, low) for end, (n, low) in automaton.iter(own)
                          if low < highs[i]]
                if places:
                    located[i] = np.array(places, np.int64)
        answers = [
            zstandard.compress(pickle.dumps(
                {k: located[at] for k, at in enumerate(places) if at in located}), 1)
            for places in asked
        ]
        return pa.table({"to_block": group.column("block"), "shard": group.column("shard"),
                         "places": pa.array(answers, pa.binary())})

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        places = {
            home: pickle.loads(zstandard.decompress(found))
            for home, found in zip(right.column("shard").to_pylist(),
                                   right.column("places").to_pylist())
        }
        out, rests = {name: [] for name in KEPT.names}, []
        for payload in left.column("payload").to_pylist():
            held, rest = pickle.loads(zstandard.decompress(payload))
            rests.append(one_array(exchange.unpack_rows(rest).column("rest")))
            for doc_id, text, refs in held:
                words = text.encode().split()
                spans = [
                    at + found[found[:, 2] < doc_id, :2]
                    for at, home, place in refs if (found := places[home].get(place)) is not None
                ]
                spans = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                gone = covered(spans[:, 0], spans[:, 1] - spans[:, 0], len(words))
                kept = [word for word, off in zip(words, gone.tolist()) if not off]
                for name, value in (
                    ("doc_id", doc_id), ("n_words", len(words)),
                    ("n_removed", len(words) - len(kept)),
                    ("kept_text", b" ".join(kept).decode() if len(spans) else text),
                ):
                    out[name].append(value)
        made = pa.Table.from_batches([table(KEPT, out)])
        return made.append_column("rest", pa.concat_arrays(rests))

    answers = exchange.by_shard_group(
        exchange.requests(docs, ask), shards, recurring, exchange.REQUESTS)
    found = exchange.with_answers(
        docs, answers, candidates, None,
        StructType.fromDDL(spark_schema(FOUND)).add("rest", rest_type))
    folder = work_dir(docs.sparkSession, "passages")
    found.write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    found = docs.sparkSession.read.schema(found.schema).parquet(folder)

    located = exchange.by_shard_group(
        found.where(F.col("kind") == PASSAGE).select("block", "shard", "payload"),
        passage_shards, locate, "to_block binary, shard int, places binary")
    changed = (
        found.where(F.col("kind") == BLOCK).select("block", "payload")
        .repartition(shards, "block").groupBy("block")
        .cogroup(located.repartition(shards, "to_block").groupBy("to_block"))
        .applyInArrow(take_out, StructType.fromDDL(spark_schema(KEPT)).add("rest", rest_type))
    )
    return found.where(F.col("kind") == DOCUMENT).select(*KEPT.names, "rest").unionByName(changed)
