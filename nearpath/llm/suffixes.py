"""Suffix arrays of many documents at once, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted order of all suffixes, and the ranks of their prefixes.

    ``codes`` holds the words of several documents one after the other, and
    ``owner``, ascending, the document of each. A suffix ends with its
    document, and documents sort apart, so no two documents are compared.
    ``levels[j][i]`` names the first ``2**j`` words at ``i`` (fewer at the end
    of a document); two places have equal names when those words are equal.
    Prefix doubling touches only suffixes that are not yet alone.
    """
    n = len(codes)
    key = owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
    rank = _first_of_group(key, np.zeros(n, np.int64))
    levels = [np.append(rank, -1)]
    step = 1
    active = _shared(rank)
    while len(active):
        following = active + step
        inside = following < n
        following[~inside] = 0
        inside &= owner[following] == owner[active]
        second = np.where(inside, rank[following] + 1, 0)
        fresh = _first_of_group(rank[active] * (n + 1) + second, rank[active])
        rank = rank.copy()
        rank[active] = fresh
        levels.append(np.append(rank, -1))
        step *= 2
        active = active[_shared(fresh)]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def _first_of_group(key: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each element ``base`` plus the place, among the elements of equal
    ``base``, of the first one with its key."""
    order = np.argsort(key, kind="stable")
    ordered, bases = key[order], base[order]
    places = np.arange(len(key))
    new_key = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
    new_base = np.append(True, bases[1:] != bases[:-1])[: len(key)]
    first = np.maximum.accumulate(np.where(new_key, places, 0))
    start = np.maximum.accumulate(np.where(new_base, places, 0))
    out = np.empty(len(key), np.int64)
    out[order] = bases + first - start
    return out


def _shared(rank: np.ndarray) -> np.ndarray:
    """The elements whose rank another one has too."""
    if not len(rank):
        return np.zeros(0, np.int64)
    _, inverse, counts = np.unique(rank, return_inverse=True, return_counts=True)
    return np.flatnonzero(counts[inverse] > 1)


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP array: equal leading words of each suffix in the order and the one before."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    pairs = np.arange(1, n)
    left, right = order[:-1].copy(), order[1:].copy()
    same = levels[0][left] == levels[0][right]
    pairs, left, right = pairs[same], left[same], right[same]
    length = np.zeros(len(pairs), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        equal = levels[j][left] == levels[j][right]
        step = equal.astype(np.int64) << j
        left, right, length = left + step, right + step, length + step
    lcp[pairs] = length
    return lcp


def longest_repeats(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place the length of the deepest LCP interval with its suffix:
    how many words from there on are found elsewhere in the document too."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if len(order) else lcp
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in the union of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0
