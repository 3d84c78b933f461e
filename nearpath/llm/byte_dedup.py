"""Exact removal of repeated byte strings, through groups of maximal repeats.

Every byte is taken out that lies in a string of ``LENGTH`` bytes which starts
anywhere else too, in the same document or another. A window is such a string.
Its key is a hash of one of its 32-byte runs, chosen by the run's own hash (the
smallest; the first of equal ones), so equal windows have equal keys, and
windows side by side mostly share one: about one key for 85 bytes.

1. Blocks of documents ask key shards which keys occur twice.
2. Stretches of windows with such a key are candidate passages. Each block sends
   its distinct ones, with how often it has them, to the shards of their keys.
3. Each shard builds enhanced suffix arrays over its distinct passages, scans
   their interval trees for maximal repeats, and answers with their spans.
4. The spans go back to the blocks, where the bytes are taken out.

What a task holds does not grow with the input. Windows of different keys are
never equal, so a shard sorts its passages a few keys at a time, up to about
``SORT_BYTES``. Texts of a block go on as rows of about ``PIECE_BYTES``, and the
table between the steps has row groups of ``ROW_GROUP``: readers of Parquet keep
a buffer as large as the largest column chunk outside the heap, a thread.

All windows of a key meet in one shard, so no repeat is missed; keys only choose
candidates, the suffix array compares bytes. A key of more than ``HOT`` places
is cut: its windows are dealt by where the run stands in them, ``HOT_STEP``
bytes apart, and by the bytes that all windows so placed share (193 of 200), so
one run in a third of all documents, amid different texts, makes many small
groups.

Null and empty texts have no bytes. Equal rows are documents of their own, which
repeat each other; ids play no part in what is removed and may be null.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.llm import exchange
from nearpath.llm.fingerprint import mix, rolling
from nearpath.llm.repeat_groups import SuffixArray
from nearpath.llm.rows import id_and_text, input_tasks, table
from nearpath.llm.substring_dedup import lengthen, shorten
from nearpath.sources.workdir import work_dir

LENGTH = 200
RUN = 32
#: Windows looked at together: their arrays stay in a core's cache.
CHUNK = 1 << 17
HOT = 4096
HOT_STEP = 8
#: Keys of a shard fall into so many parts; a part is sorted as a whole.
PARTS = 256
SORT_BYTES = 1 << 19
PIECE_BYTES = 1 << 20
ROW_GROUP = 8 << 20

DOCUMENT, PASSAGE, BLOCK = 0, 1, 2
SHARED, CUT = 1, 2

FOUND = pa.schema([
    ("kind", pa.int32()), ("block", pa.binary()), ("shard", pa.int32()), ("payload", pa.binary()),
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
    ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary()),
])
FOUND_SCHEMA = (
    "kind int, block binary, shard int, payload binary, doc_id long, n_bytes long, "
    "n_removed long, starts array<long>, ends array<long>, kept binary"
)
KEPT = pa.schema([FOUND.field(n) for n in (
    "doc_id", "n_bytes", "n_removed", "starts", "ends", "kept")])
KEPT_SCHEMA = FOUND_SCHEMA[FOUND_SCHEMA.index("doc_id"):]


def run_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of ``RUN`` bytes, from doubled widths."""
    out, factor, have = data.astype(np.uint32) + np.uint32(1), np.uint32(0x9E3779B1), 1
    with np.errstate(over="ignore"):
        while have < RUN:
            out = out[:-have] * factor + out[have:]
            factor, have = factor * factor, 2 * have
        out ^= out >> np.uint32(16)
        out *= np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
        out *= np.uint32(0xC2B2AE35)
        out ^= out >> np.uint32(16)
    return out


def chosen_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where, of all windows of one chunk, another run is chosen, and where that is."""
    hashes = run_hashes(data)
    low = hashes.astype(np.uint64) << np.uint64(32)
    low |= np.arange(len(low), dtype=np.uint64)  # the first of equal ones
    width, have = LENGTH - RUN + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return head, place[head]


class Windows:
    """The stretches of windows of a block's documents that share a chosen run."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        last = len(data) - LENGTH + 1
        heads, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, last, CHUNK):
            head, place = chosen_runs(data[a:a + CHUNK + LENGTH - 1])
            heads.append(head + a)
            places.append(place + a)
        head, place = np.concatenate(heads), np.concatenate(places)
        # cut where documents begin, and where no window fits any more
        begins = ends - sizes
        cuts = np.unique(np.concatenate([head, begins, np.maximum(begins, ends - LENGTH + 1)]))
        cuts = cuts[cuts < max(last, 0)]
        place = place[np.searchsorted(head, cuts, "right") - 1]
        stop = np.append(cuts[1:], max(last, 0))[: len(cuts)] - 1
        owner = np.searchsorted(begins, cuts, "right") - 1
        fits = cuts + LENGTH <= ends[owner]
        self.first, self.last = cuts[fits], stop[fits]
        self.place, self.owner = place[fits], owner[fits]
        self.keys = self._keys(data)
        # a run that chunks or documents cut in two stands in one place
        self.new = np.append(True, self.place[1:] != self.place[:-1])[: len(self.place)]

    def _keys(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.place), np.uint64)
        step = CHUNK // RUN
        for a in range(0, len(out), step):
            own = data[self.place[a:a + step, None] + np.arange(RUN)].view("<u8")
            with np.errstate(over="ignore"):
                key = np.zeros(len(own), np.uint64)
                for column in own.T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
            out[a:a + step] = key
        return out

    def asked(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By shard the distinct keys, and in how many places each occurs (255: or more)."""
        keys, n = np.unique(self.keys[self.new], return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        home = (keys % np.uint64(shards)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[by_home])) + 1
        for part in np.split(by_home, cuts) if len(by_home) else []:
            yield int(home[part[0]]), keys[part], n[part]

    def stretches(self, data: np.ndarray, flags: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Owner, first and last window, and dealing hash of every candidate passage.

        Neighbours of one key are one stretch: a run that repeats in steps
        shorter than a window would else make one for each step.
        """
        shared = np.flatnonzero(flags == SHARED)
        if len(shared):
            joined = (
                (np.diff(shared) == 1) & (self.keys[shared[1:]] == self.keys[shared[:-1]])
                & (self.last[shared[:-1]] + 1 == self.first[shared[1:]])
                & (self.owner[shared[1:]] == self.owner[shared[:-1]])
                & (self.first[shared[1:]] % CHUNK != 0)
            )
            head = np.flatnonzero(np.append(True, ~joined))
            tail = np.append(head[1:], len(shared)) - 1
            yield from zip(
                self.owner[shared[head]].tolist(), self.first[shared[head]].tolist(),
                self.last[shared[tail]].tolist(), self.keys[shared[head]].tolist())
        for i in np.flatnonzero(flags == CUT).tolist():
            owner, first, last, place = (
                int(a[i]) for a in (self.owner, self.first, self.last, self.place))
            for step in range((place - last) // HOT_STEP, (place - first) // HOT_STEP + 1):
                low = max(first, place - (step + 1) * HOT_STEP + 1)
                high = min(last, place - step * HOT_STEP)
                # the bytes that every window so placed has
                core = data[place - step * HOT_STEP:place - (step + 1) * HOT_STEP + 1 + LENGTH]
                yield owner, low, high, xxhash.xxh3_64_intdigest(core.tobytes(), step)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts end to end, and where each ends and its size."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets[1:] - offsets[0], np.diff(offsets)


def pack_passages(passages: list[bytes], counts: array, parts: bytes) -> bytes:
    sizes = np.fromiter(map(len, passages), "<u4", len(passages))
    return zstandard.compress(
        np.uint32(len(passages)).tobytes() + sizes.tobytes()
        + np.asarray(counts, "<u4").tobytes() + bytes(parts) + b"".join(passages), 3)


def unpack_passages(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes, counts = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n)
    ends = 4 + 9 * n + np.cumsum(sizes, dtype=np.int64)
    passages = [raw[b - size:b] for b, size in zip(ends.tolist(), sizes.tolist())]
    return passages, counts, np.frombuffer(raw, np.uint8, n, 4 + 8 * n)


def pack_spans(n: np.ndarray, spans: np.ndarray) -> bytes:
    """How many spans each passage has, and all spans in that order."""
    return zstandard.compress(np.uint32(len(n)).tobytes() + n.astype("<u4").tobytes()
                              + spans.astype("<u4").tobytes(), 1)


def unpack_spans(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), "<u4")
    n = int(raw[0])
    return raw[1:n + 1], raw[n + 1:].reshape(-1, 2)


def chosen_spans(
    n: np.ndarray, spans: np.ndarray, passages: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same for some of the passages, in the order given."""
    own = n[passages].astype(np.int64)
    first = (np.cumsum(n, dtype=np.int64) - n)[passages]
    return own, spans[np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def portions(sizes: np.ndarray, parts: np.ndarray) -> Iterator[np.ndarray]:
    """The passages of as many whole parts as ``SORT_BYTES`` hold, one part at least."""
    order = np.argsort(parts, kind="stable")
    stops = np.append(np.flatnonzero(np.diff(parts[order])) + 1, len(order))
    reach = np.cumsum(sizes[order], dtype=np.int64)[stops - 1]
    first = done = 0
    while done < len(stops):
        before = reach[done - 1] if done else 0
        done = max(done + 1, int(np.searchsorted(reach, before + SORT_BYTES, "right")))
        yield order[first:stops[done - 1]]
        first = stops[done - 1]


def repeated_spans(passages: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many spans, and the ``(start, end)`` of these, each passage has of its
    maximal repeats, joined.

    A passage found twice is a repeat as a whole. Others are sorted with all
    those they may share a window with.
    """
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    data = np.frombuffer(b"".join(passages), np.uint8)
    whole = np.flatnonzero(counts > 1)
    found = [(whole, np.zeros(len(whole), np.int64), sizes[whole])]
    with np.errstate(over="ignore"):
        hashes = mix(rolling(data.astype(np.uint64) + np.uint64(1), LENGTH))
    owner = np.repeat(np.arange(len(passages)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = np.flatnonzero(place[: len(hashes)] + LENGTH <= sizes[owner[: len(hashes)]])
    order = fits[np.argsort(hashes[fits])]
    same = hashes[order[1:]] == hashes[order[:-1]]
    mixed = np.zeros(len(passages), bool)
    mixed[owner[order[1:][same]]] = True
    mixed[owner[order[:-1][same]]] = True
    if mixed.any():
        chosen = np.flatnonzero(mixed)
        places, lengths = SuffixArray(data[mixed[owner]], sizes[chosen], LENGTH).longest()
        begins = np.cumsum(sizes[chosen]) - sizes[chosen]
        number = np.searchsorted(begins, places, "right") - 1
        order = np.lexsort((places, number))
        places, lengths, number = places[order], lengths[order], number[order]
        reach = np.maximum.accumulate(places + lengths)  # spans of a passage end before the next
        new = np.append(True, (places[1:] > reach[:-1]) | (number[1:] != number[:-1]))
        head = np.flatnonzero(new[: len(places)])
        tail = np.append(head[1:], len(places))[: len(head)] - 1
        head, tail = (x[counts[chosen[number[head]]] == 1] for x in (head, tail))
        number = number[head]
        found.append((chosen[number], places[head] - begins[number], reach[tail] - begins[number]))
    at, starts, ends = map(np.concatenate, zip(*found))
    order = np.argsort(at, kind="stable")
    return np.bincount(at, minlength=len(passages)), np.stack([starts, ends], 1)[order]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = starts[1:] > ends[:-1]
    head = np.append(True, apart)[: len(starts)]
    tail = np.append(apart, True)[: len(starts)]
    return starts[head], ends[tail]


class Rows:
    """Rows that leave as batches of about ``PIECE_BYTES``."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.columns, self.size = {name: [] for name in self.schema.names}, 0

    def add(self, size: int, **row) -> Iterator[pa.RecordBatch]:
        for name, values in self.columns.items():
            values.append(row.get(name))
        self.size += size
        if self.size >= PIECE_BYTES:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        out = table(self.schema, self.columns)
        self.clear()
        return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed``, the removed runs (``starts``,
    ``ends``, in bytes) and the bytes that are left (``kept``; a character may
    have been cut)."""
    docs = id_and_text(docs, id_col, text_col)
    shards = input_tasks(docs)
    passage_shards = 4 * shards

    def ask(rows: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        asked = list(Windows(*bytes_of(rows.column("text"))).asked(shards))
        for shard, keys, n in asked or [(0, np.zeros(0, np.uint64), np.zeros(0, np.uint8))]:
            yield shard, zstandard.compress(shorten(keys) + n.tobytes(), 1)

    def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = zstandard.decompress(payload)
        n = len(raw) // 7
        return lengthen(raw[: 6 * n]), np.frombuffer(raw, np.uint8, n, 6 * n)

    def recurring(group: pa.Table) -> pa.Table:
        asked = [unpack(p) for p in group.column("payload").to_pylist()]
        everything = np.concatenate([keys for keys, _ in asked])
        n = np.concatenate([counts for _, counts in asked])
        _, inverse = np.unique(everything, return_inverse=True)
        total = np.bincount(inverse, n)
        flags = np.where(total > HOT, CUT, np.where(total > 1, SHARED, 0)).astype(np.uint8)
        parts = np.split(flags[inverse], np.cumsum([len(keys) for keys, _ in asked])[:-1])
        return pa.table({
            "block": group.column("block"), "shard": group.column("shard"),
            "payload": pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary()),
        })

    def candidates(rows: pa.Table, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        data, ends, sizes = bytes_of(rows.column("text"))
        ids = rows.column("doc_id").to_pylist()
        windows = Windows(data, ends, sizes)
        keys, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for shard, own, _ in windows.asked(shards):
            keys.append(own)
            flags.append(np.frombuffer(zstandard.decompress(got[shard]), np.uint8))
        keys, flags = np.concatenate(keys), np.concatenate(flags)
        order = np.argsort(keys)
        if len(keys):
            flags = flags[order][np.searchsorted(keys[order], windows.keys)]
        begins = ends - sizes
        sent: dict[int, tuple[dict[bytes, int], array, bytearray]] = {}
        owners, refs = array("q"), array("q")
        for owner, first, last, deal in windows.stretches(data, flags):
            passage, home = data[first:last + LENGTH].tobytes(), deal % passage_shards
            number, counts, parts = sent.setdefault(home, ({}, array("q"), bytearray()))
            at = number.setdefault(passage, len(number))
            if at == len(counts):
                counts.append(0)
                parts.append(deal // passage_shards % PARTS)
            counts[at] += 1
            owners.append(owner)
            refs.extend((first - int(begins[owner]), home, at))
        owners = np.array(owners, np.int64)
        order = np.argsort(owners, kind="stable")
        refs = np.array(refs, np.int64).reshape(-1, 3)[order]
        cuts = np.searchsorted(owners[order], np.arange(len(ids) + 1))
        name = xxhash.xxh3_128(repr(ids).encode() + sizes.tobytes())
        name.update(data)
        block = name.digest()
        out = Rows(FOUND)
        held: list[int] = []
        waiting = 0
        for i, doc_id in enumerate(ids):
            if cuts[i] < cuts[i + 1]:
                held.append(i)
                waiting += int(sizes[i])
            else:
                own = data[begins[i]:ends[i]].tobytes()
                yield from out.add(len(own), kind=DOCUMENT, doc_id=doc_id, n_bytes=len(own),
                                   n_removed=0, starts=[], ends=[], kept=own)
            if held and (waiting >= PIECE_BYTES or i == len(ids) - 1):
                payload = zstandard.compress(pickle.dumps((
                    [ids[k] for k in held], [data[begins[k]:ends[k]].tobytes() for k in held],
                    [int(cuts[k + 1] - cuts[k]) for k in held],
                    np.concatenate([refs[cuts[k]:cuts[k + 1]] for k in held]))), 3)
                yield from out.add(len(payload), kind=BLOCK, block=block, payload=payload)
                held, waiting = [], 0
        while sent:
            home, (number, counts, parts) = sent.popitem()
            payload = pack_passages(list(number), counts, parts)
            yield from out.add(len(payload), kind=PASSAGE, block=block, shard=home, payload=payload)
        yield out.batch()

    def locate(group: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        counts, parts, asked = array("q"), bytearray(), []
        for payload in group.column("payload"):
            own, n, part = unpack_passages(payload.as_buffer())
            places = array("q")
            for passage, times, of in zip(own, n.tolist(), part.tolist()):
                at = number.setdefault(passage, len(number))
                if at == len(counts):
                    counts.append(0)
                    parts.append(of)
                counts[at] += times
                places.append(at)
            asked.append(np.array(places, np.int64))
        passages, counts = list(number), np.array(counts, np.int64)
        sizes = np.fromiter(map(len, passages), np.int64, len(passages))
        seen, n, spans = [], [], []
        for portion in portions(sizes, np.frombuffer(parts, np.uint8)):
            own = repeated_spans([passages[i] for i in portion.tolist()], counts[portion])
            seen.append(portion)
            n.append(own[0])
            spans.append(own[1].astype(np.uint32))
        slot = np.argsort(np.concatenate(seen))
        n, spans = np.concatenate(n), np.concatenate(spans)
        answers = [pack_spans(*chosen_spans(n, spans, slot[places])) for places in asked]
        return pa.table({"to_block": group.column("block"), "shard": group.column("shard"),
                         "spans": pa.array(answers, pa.binary())})

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        base = np.full(passage_shards, -1)
        n, spans, have = [np.zeros(0, np.uint32)], [np.zeros((0, 2), np.uint32)], 0
        for home, packed in zip(right.column("shard").to_pylist(), right.column("spans")):
            if base[home] < 0:  # equal blocks get equal answers
                base[home] = have
                own = unpack_spans(packed.as_buffer())
                n.append(own[0])
                spans.append(own[1])
                have += len(own[0])
        n, spans = np.concatenate(n), np.concatenate(spans)
        out = Rows(KEPT)
        batches = []
        for payload in left.column("payload"):
            ids, texts, n_refs, refs = pickle.loads(zstandard.decompress(payload.as_buffer()))
            at, home, number = refs.T
            if (base[home] < 0).any():
                raise KeyError("a block without the answers of a shard")
            times, found = chosen_spans(n, spans, base[home] + number)
            found = found + np.repeat(at, times)[:, None]
            ends = np.append(0, np.cumsum(times))[np.cumsum(n_refs)]
            for doc_id, text, own in zip(ids, texts, np.split(found, ends[:-1])):
                starts, stops = joined(own[:, 0], own[:, 1])
                edges = [0, *np.stack([starts, stops], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                batches += out.add(
                    len(kept), doc_id=doc_id, n_bytes=len(text), n_removed=len(text) - len(kept),
                    starts=starts.tolist(), ends=stops.tolist(), kept=kept)
        return pa.Table.from_batches([*batches, out.batch()], KEPT)

    answers = exchange.by_shard_group(
        exchange.requests(docs, ask), shards, recurring, exchange.REQUESTS)
    found = exchange.with_answers(docs, answers, candidates, FOUND, FOUND_SCHEMA)
    folder = work_dir(docs.sparkSession, "byte-passages")
    (found.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
     .option("parquet.page.size.row.check.min", 8).partitionBy("kind").parquet(folder))
    found = docs.sparkSession.read.schema(found.schema).parquet(folder)

    located = exchange.by_shard_group(
        found.where(F.col("kind") == PASSAGE).select("block", "shard", "payload"),
        passage_shards, locate, "to_block binary, shard int, spans binary")
    changed = (
        found.where(F.col("kind") == BLOCK).select("block", "payload")
        .repartition(shards, "block").groupBy("block")
        .cogroup(located.repartition(shards, "to_block").groupBy("to_block"))
        .applyInArrow(take_out, KEPT_SCHEMA)
    )
    return found.where(F.col("kind") == DOCUMENT).select(*KEPT.names).unionByName(changed)
