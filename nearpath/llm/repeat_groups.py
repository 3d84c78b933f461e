"""Maximal repeats of byte strings, from an enhanced suffix array in numpy.

The suffixes of all strings are sorted together. Neighbours' common prefixes
(LCP) form intervals: all suffixes that share a prefix, one inside another. A
scan with a stack visits them from the inside out. An interval is a maximal
repeat when its suffixes do not all have the same byte before them, so that it
cannot be made longer to the left without losing one; the start of a string
differs from everything. Every suffix of the interval is an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Symbols in the first name of a place: nine bits each, zero beyond the end.
FIRST, BITS = 7, 9

EDGE, DIVERSE = 0, -1


class SuffixArray:
    """The sorted suffixes, of ``least`` bytes and more, of strings laid end to end."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, least: int):
        n = len(data)
        ends = np.cumsum(sizes)
        self.left_of = np.zeros(n, np.int64)  # the byte before, plus one
        self.left_of[1:] = data[:-1].astype(np.int64) + 1
        self.left_of[(ends - sizes)[sizes > 0]] = EDGE
        self.rest = np.repeat(ends, sizes) - np.arange(n)
        self.words = self._first_words(data)
        self.levels = self._names()
        order = np.argsort(self.levels[-1])
        self.order = order[self.rest[order] >= least]
        self.lcp = self._common(least)

    def _first_words(self, data: np.ndarray) -> np.ndarray:
        words = np.zeros(len(data), np.uint64)
        for k in range(min(FIRST, len(data))):
            symbol = np.zeros(len(data), np.uint64)
            symbol[: len(data) - k] = data[k:]
            symbol += np.uint64(1)
            symbol[self.rest <= k] = 0
            words |= symbol << np.uint64(BITS * (FIRST - 1 - k))
        return words

    def _names(self) -> list[np.ndarray]:
        """Ranks of the first 7, 14, 28, ... bytes at each place (fewer at an end)."""
        n, step = len(self.words), FIRST
        rank = _refine(self.words, np.zeros(n, np.int64))
        levels, longest = [rank], int(self.rest.max(initial=0))
        active = _tied(rank)
        while len(active) and step < longest:
            inside = self.rest[active] > step
            second = np.where(inside, rank[np.where(inside, active + step, 0)] + 1, 0)
            fresh = _refine(rank[active] * (n + 1) + second, rank[active])
            rank = rank.copy()
            rank[active] = fresh
            levels.append(rank)
            step *= 2
            active = active[_tied(fresh)]
        return levels

    def _common(self, least: int) -> np.ndarray:
        """The common prefix of each suffix and the one before; 0 below ``least``."""
        lcp = np.zeros(len(self.order), np.int64)
        if len(lcp) < 2:
            return lcp
        last = len(self.words) - 1
        pairs = np.arange(1, len(lcp))
        for level in [rank for j, rank in enumerate(self.levels) if FIRST << j <= least][-1:]:
            pairs = pairs[level[self.order[:-1]] == level[self.order[1:]]]
        a, b = self.order[pairs - 1], self.order[pairs]
        most = np.minimum(self.rest[a], self.rest[b])
        length = np.zeros(len(pairs), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = np.minimum(a + length, last), np.minimum(b + length, last)
            equal = (self.levels[j][x] == self.levels[j][y]) & (length < most)
            length += equal * (FIRST << j)
        x, y = np.minimum(a + length, last), np.minimum(b + length, last)
        first, second = self.words[x], self.words[y]
        same = length < most
        for k in range(FIRST):
            shift = np.uint64(BITS * (FIRST - 1 - k))
            same &= (first >> shift) == (second >> shift)
            length += same
        length = np.minimum(length, most)
        lcp[pairs] = np.where(length >= least, length, 0)
        return lcp

    def groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """Length and all occurrences of every maximal repeat."""
        slots = self._diverse_slots()
        places = self.order[slots]
        for length, first, last, _ in scan(self.lcp[slots].tolist(), self.left_of[places].tolist()):
            yield length, places[first:last]

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in a maximal repeat, and the length of the longest that starts there."""
        slots = self._diverse_slots()
        places = self.order[slots]
        best = np.zeros(len(slots), np.int64)
        for length, _, _, own in scan(self.lcp[slots].tolist(), self.left_of[places].tolist()):
            best[own] = length
        return places[best > 0], best[best > 0]

    def _diverse_slots(self) -> np.ndarray:
        """Slots of the order in outermost intervals that a maximal repeat can be in:
        not all suffixes have the same byte before them."""
        n = len(self.order)
        if not n:
            return np.zeros(0, np.int64)
        head = np.flatnonzero(self.lcp == 0)
        left = self.left_of[self.order]
        low, high = np.minimum.reduceat(left, head), np.maximum.reduceat(left, head)
        sizes = np.diff(np.append(head, n))
        return np.flatnonzero(np.repeat((sizes > 1) & ((low != high) | (low == EDGE)), sizes))


def scan(lcp: list[int], left: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Length, first slot and slot after the last of every maximal repeat, inner
    ones first, and the slots that no inner one had."""
    stack: list[tuple[int, int, int, list[int]]] = [(0, 0, EDGE, [])]
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else 0
        first, byte, slots = i - 1, left[i - 1], [i - 1]
        while here < stack[-1][0]:
            length, first, other, more = stack.pop()
            byte = byte if byte == other and byte != EDGE else DIVERSE
            if len(more) < len(slots):
                slots, more = more, slots
            more.extend(slots)
            slots = more
            if byte == DIVERSE:
                yield length, first, i, slots
                slots = []
        if here > stack[-1][0]:
            stack.append((here, first, byte, slots))
        elif here:
            length, first, other, more = stack[-1]
            if len(more) < len(slots):
                slots, more = more, slots
            more.extend(slots)
            stack[-1] = (length, first, byte if byte == other and byte != EDGE else DIVERSE, more)


def _refine(key: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each element ``base`` plus the place, among the elements of equal
    ``base``, of the first one with its key; keys sort by base first."""
    order = np.argsort(key)
    ordered, bases = key[order], base[order]
    places = np.arange(len(key))
    first = np.append(True, ordered[1:] != ordered[:-1])[: len(key)]
    start = np.append(True, bases[1:] != bases[:-1])[: len(key)]
    first = np.maximum.accumulate(np.where(first, places, 0))
    start = np.maximum.accumulate(np.where(start, places, 0))
    out = np.empty(len(key), np.int64)
    out[order] = bases + first - start
    return out


def _tied(rank: np.ndarray) -> np.ndarray:
    """The elements whose rank another one has too."""
    order = np.argsort(rank)
    ordered = rank[order]
    same = ordered[1:] == ordered[:-1]
    tied = np.zeros(len(rank), bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    return np.flatnonzero(tied)
