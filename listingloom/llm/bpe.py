"""Byte-pair merging shared by the tokenizers, one input at a time or many at once, and a bounded cache for its results."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable

import numpy as np

#: Symbols up to which merging rescans the list; longer inputs use a heap.
SHORT = 48
#: Entries of a generation of each cache.
CACHE = 140_000


class Cache(dict):
    """Values of ``make``, in two generations: a full one replaces the older, so what is still in use stays."""

    def __init__(self, make: Callable):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        out = self[key] = self.old.get(key) or self.make(key)
        return out


def merge(s: list, rank: Callable) -> list:
    """Merges neighbours until none has a rank: the least rank first, the leftmost among equals.

    ``rank(symbol, default)`` is a dict's ``get``; symbols are str or bytes.
    """
    if len(s) > SHORT:
        return _merge_long(s, rank)
    none = 1e18
    ranks = [rank(a + b, none) for a, b in zip(s, s[1:])]
    ranks.append(none)  # of the last symbol, which has no right neighbour
    while (best := min(ranks)) != none:
        i = ranks.index(best)
        s[i] = both = s[i] + s.pop(i + 1)
        del ranks[i]
        if i < len(ranks) - 1:
            ranks[i] = rank(both + s[i + 1], none)
        if i:
            ranks[i - 1] = rank(s[i - 1] + both, none)
    return s


def _merge_long(s: list, rank: Callable) -> list:
    n = len(s)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, s[i] + s[i + 1]) for i in range(n - 1) if (r := rank(s[i] + s[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if s[i] is None or j < 0 or s[i] + s[j] != both:
            continue
        s[i], s[j] = both, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := rank(s[a] + s[b])) is not None:
                heapq.heappush(heap, (r, a, s[a] + s[b]))
    return [x for x in s if x is not None]


class PairTable:
    """Merges of many inputs at once: symbols are numbers, and a sorted table has the pairs that join.

    pieces: every string that may come out of a merge, with its rank (the least first; equal ranks leftmost first).
    Symbols are the pieces and the characters in them.
    """

    def __init__(self, rank: dict[str, float]):
        self.symbols = list(dict.fromkeys([*rank, *(c for p in rank for c in p)]))
        number = {s: i for i, s in enumerate(self.symbols)}
        order = {r: i for i, r in enumerate(sorted(set(rank.values())))}
        keys, ranks, joined = array("q"), array("i"), array("i")
        for p, r in rank.items():
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a * len(self.symbols) + b)
                    ranks.append(order[r])
                    joined.append(number[p])
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.order, self.joined = np.array(keys, np.int64)[at], np.array(ranks, np.int32)[at], np.array(joined, np.int32)[at]
        single = {c: number[c] for c in self.symbols if len(c) == 1}
        self.known = np.array(sorted(map(ord, single)), np.uint32)
        self.of_known = np.array([single[chr(c)] for c in self.known.tolist()], np.int32)

    NONE = np.iinfo(np.int32).max

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE where it doesn't join, and the place of its entry."""
        if not len(self.keys):
            return np.full(a.shape, self.NONE, np.int32), np.zeros(a.shape, np.int64)
        key = a.astype(np.int64) * len(self.symbols) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], self.NONE), at

    def split(self, text: np.ndarray) -> np.ndarray:
        """Symbols of code points; -1 for those in no piece."""
        at = np.minimum(np.searchsorted(self.known, text), len(self.known) - 1)
        return np.where(self.known[at] == text, self.of_known[at], -1)

    def merge(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, width) symbols padded with -1 -> the merged symbols, padded likewise, and how many each input has."""
        out, count = s.copy(), (s >= 0).sum(axis=1)
        rank, entry = self._look_up(s[:, :-1], s[:, 1:])
        row, place = np.arange(len(s)), np.arange(s.shape[1])
        while len(row) and s.shape[1] > 1:
            j = rank.argmin(axis=1)
            here = np.arange(len(row))
            live = rank[here, j] != self.NONE
            if not live.all():
                done = ~live
                out[row[done], : s.shape[1]] = s[done]
                row, s, rank, entry, j = row[live], s[live], rank[live], entry[live], j[live]
                here = np.arange(len(row))
            if not len(row):
                break
            s[here, j] = self.joined[entry[here, j]]
            count[row] -= 1
            # One symbol fewer: what stands behind the merged pair moves up, and the pairs on its two sides are new.
            width = int(count[row].max())
            s = np.take_along_axis(s, np.minimum(place[:width] + (place[:width] > j[:, None]), s.shape[1] - 1), axis=1)
            s[place[:width] >= count[row][:, None]] = -1
            if width < 2:
                out[row, :1] = s
                out[row, 1:] = -1
                break
            moved = np.minimum(place[: width - 1] + (place[: width - 1] >= j[:, None]), rank.shape[1] - 1)
            rank, entry = np.take_along_axis(rank, moved, axis=1), np.take_along_axis(entry, moved, axis=1)
            for at in (j - 1, j):
                use = (at >= 0) & (at < width - 1)
                r, k = here[use], at[use]
                rank[r, k], entry[r, k] = self._look_up(s[r, k], s[r, k + 1])
            rank[place[: width - 1] >= count[row][:, None] - 1] = self.NONE
        out[np.arange(out.shape[1]) >= count[:, None]] = -1
        return out, count
