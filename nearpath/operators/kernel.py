"""Small numpy helpers that run inside Arrow tasks. They hold no Spark state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cells of a distance matrix held at once by one task (16 MB of doubles).
TILE_CELLS = 2_000_000

# Products of lengths that single precision can hold with room to spare.
LARGEST = 1e15

# Objects beyond four times k that a query may have left for exact comparison.
CROWD = 256

# Values of vectors gathered at once when pairs are compared one by one.
PAIR_VALUES = 4_000_000


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Array column to a float64 matrix; every vector must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vectors must not be null")
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    lengths = pc.list_value_length(column).to_numpy()
    if (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    values = column.flatten()
    if values.null_count:
        raise ValueError("vectors must not hold nulls")
    return values.to_numpy(zero_copy_only=False).reshape(n, lengths[0]).astype(np.float64)


def to_vector_column(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, max(matrix.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(lengths == 0, 1.0, lengths)


def rank_in_runs(sorted_groups: np.ndarray) -> np.ndarray:
    """0-based position of each element within its run of equal values."""
    n = len(sorted_groups)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
    return np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))


def rows_by_key(keys: pa.Array | pa.ChunkedArray) -> dict[str, np.ndarray]:
    """Row numbers of each distinct key."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    encoded = keys.dictionary_encode()
    codes = encoded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(encoded.dictionary)))
    return dict(zip(encoded.dictionary.to_pylist(), np.split(order, ends[:-1])))


def pair_distances(
    queries: np.ndarray, objects: np.ndarray, rows: np.ndarray, cols: np.ndarray
) -> np.ndarray:
    """One minus the inner product of each pair, its products added in a fixed
    order, so a pair has one distance wherever it is computed."""
    out = np.empty(len(rows))
    step = max(1, PAIR_VALUES // max(queries.shape[1], 1))
    for start in range(0, len(rows), step):
        part = slice(start, start + step)
        out[part] = 1.0 - (queries[rows[part]] * objects[cols[part]]).sum(axis=1)
    return out


def nearest(
    queries: np.ndarray, ids: np.ndarray, objects: np.ndarray, k: int,
    bounds: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best objects of every query by (distance, id).

    Returns query row numbers, ids and distances. ``bounds`` holds, per query,
    a distance above which an object cannot be among its best; those are left
    out. A single-precision matrix product shortlists, with room for its
    rounding errors; queries it leaves too many objects for, all nearly as far
    away, are shortlisted again in double precision. The few pairs left are
    compared one by one, so the answer does not depend on how the objects were
    split over tasks. Never holds more than ``TILE_CELLS`` distances.

    With c the mean of the objects, q.o = (q - c).(o - c) + c.(o - c) + q.c. The
    last term is the same for all objects of a query, so the product is one of
    the differences to c and keeps its digits where all vectors lie close.
    """
    if not len(queries) or not len(objects):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = np.argsort(ids, kind="stable")
    ids, objects = ids[order], objects[order]
    step = max(1, TILE_CELLS // len(ids))
    centre = objects.mean(axis=0)
    wide = np.column_stack([objects - centre, np.zeros(len(objects))])
    wide[:, -1] = wide[:, :-1] @ centre
    farthest = _lengths(wide[:, :-1]).max()
    lift = np.abs(wide[:, -1]).max()
    from_origin = np.sqrt(centre @ centre)
    reach = _lengths(objects).max() + from_origin
    narrow = wide.astype(np.float32) if max(reach, lift) < LARGEST else None
    room = objects.shape[1] + 8
    found = []
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        known = np.full(len(part), np.inf) if bounds is None else bounds[start : start + step]
        least = 1.0 - known - part @ centre
        own = np.column_stack([part - centre, np.ones(len(part))])
        sizes = _lengths(own[:, :-1]) * farthest + lift
        # What the distances and the terms above may be off by in double precision.
        off = 2.3e-16 * (4 * room * (_lengths(part) + from_origin) * reach + 4)
        if narrow is None or max(sizes.max(), np.abs(own).max()) > LARGEST:
            rows, cols, _ = _shortlist(own, wide, k, least, 2 * off)
        else:
            rows, cols, crowded = _shortlist(
                own.astype(np.float32), narrow, k, least, 1.3e-7 * room * sizes + off, 4 * k + CROWD)
            if len(crowded):
                more, more_cols, _ = _shortlist(
                    own[crowded], wide, k, least[crowded], 2 * off[crowded])
                rows = np.concatenate([rows, crowded[more]])
                cols = np.concatenate([cols, more_cols])
        distance = pair_distances(part, objects, rows, cols)
        order = np.lexsort((cols, distance, rows))
        order = order[rank_in_runs(rows[order]) < k]
        found.append((rows[order] + start, ids[cols[order]], distance[order]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def _shortlist(
    part: np.ndarray, objects: np.ndarray, k: int, least: np.ndarray, slack: np.ndarray,
    most: int | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that can be among a query's k best.

    These are the largest products, none below ``least``; ``slack`` is what a
    product may be off by. Queries left with more than ``most`` objects get
    none; their rows come third.
    """
    n = len(objects)
    scores = part @ objects.T
    limit = least - slack
    unknown = np.flatnonzero(np.isneginf(limit))
    if len(unknown) and n > k:
        kth = np.partition(scores[unknown], n - k, axis=1)[:, n - k].astype(np.float64)
        limit[unknown] = kth - 2 * slack[unknown]
    limit = np.nextafter(limit.astype(scores.dtype), -np.inf, dtype=scores.dtype)
    hits = scores >= limit[:, None]
    crowded = np.empty(0, np.int64)
    if most is not None and n > most:
        crowded = np.flatnonzero(np.count_nonzero(hits, axis=1) > most)
        hits[crowded] = False
    return *np.divmod(_places(hits.ravel()), n), crowded


def _places(hits: np.ndarray) -> np.ndarray:
    """Where a mostly false array is true: eight at a time first."""
    whole = len(hits) // 8 * 8
    words = np.flatnonzero(hits[:whole].view(np.uint64))
    near = np.concatenate([(words[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(hits))])
    return near[hits[near]]


class RunningTopK:
    """Candidates of one task, kept at k per group and handed on when too many.

    ``bounds`` holds, per group, the distance that a further candidate must
    not exceed to be among its k best; what is known of it may be given.
    """

    def __init__(
        self, n_groups: int, k: int, limit: int = 2_000_000, bounds: np.ndarray | None = None
    ):
        self.k = k
        self.limit = limit
        self.bounds = np.full(n_groups, np.inf) if bounds is None else bounds.copy()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.compacted = True
        self.added = 0

    def add(self, group, neighbor_id, distance, *payload) -> None:
        if len(group):
            self.parts.append((group, neighbor_id, distance, *payload))
            self.compacted = False
            self.added += len(group)
            if self.added > self.limit // 2:
                self.compact()

    def compact(self) -> tuple[np.ndarray, ...]:
        if self.compacted:
            return self.parts[0] if self.parts else ()
        columns = [np.concatenate(part) for part in zip(*self.parts)]
        group, neighbor_id, distance = columns[:3]
        order = np.lexsort((neighbor_id, distance, group))
        rank = rank_in_runs(group[order])
        kth = order[rank == self.k - 1]
        self.bounds[group[kth]] = np.minimum(self.bounds[group[kth]], distance[kth])
        order = order[rank < self.k]
        columns = tuple(column[order] for column in columns)
        self.parts, self.compacted, self.added = [columns], True, 0
        return columns

    def settle(self):
        """Compact after a batch that brought much; release everything if it is
        still too much."""
        if self.parts and 4 * self.added < len(self.parts[0][0]):
            return
        columns = self.compact()
        if columns and len(columns[0]) > self.limit:
            self.parts = []
            yield columns

    def finish(self):
        columns = self.compact()
        if columns:
            yield columns


def forward(layers: list[int], weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Class probabilities of a feed-forward net with sigmoid hidden layers.

    ``weights`` is laid out as ``pyspark.ml`` perceptrons have it: for each
    layer the (out x in) matrix column by column, then the bias. A net without
    hidden layers is a multinomial logistic regression.
    """
    if layers[-1] == 1:
        return np.ones((len(x), 1))
    at = 0
    for depth, (n_in, n_out) in enumerate(zip(layers, layers[1:])):
        matrix = weights[at : at + n_in * n_out].reshape(n_in, n_out)
        at += n_in * n_out
        x = x @ matrix + weights[at : at + n_out]
        at += n_out
        if depth < len(layers) - 2:
            x = 1.0 / (1.0 + np.exp(-x))
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)
