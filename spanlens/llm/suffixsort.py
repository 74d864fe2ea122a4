"""Suffix sorting by mergesort whose comparisons are binary searches over prefix hashes."""

from __future__ import annotations

import numpy as np

from .common import _INVERSE, _ODD, powers


class Suffixes:
    """Suffixes of the rows of a matrix of bytes, compared on their first limit bytes.

    prefix[r, i] is the polynomial hash of row r's first i bytes, so the hash of any stretch takes two look-ups. The
    common extension of two suffixes is found by binary search on its length: a logarithmic number of hashes for
    each comparison. Equal hashes of different bytes are possible, so classes() checks the bytes.
    """

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit, width = data, limit, data.shape[1]
        self.prefix = np.zeros((len(data), width + 1), np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, width), axis=1, out=self.prefix[:, 1:])
        self.flat, self.back = self.prefix.reshape(-1), powers(_INVERSE, width + 1)

    def hashes(self, row: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        base = row * self.prefix.shape[1] + at
        return (self.flat[base + n] - self.flat[base]) * self.back[at]

    def common(self, r1: np.ndarray, a1: np.ndarray, r2: np.ndarray, a2: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at (r1, a1) and (r2, a2) share from their start, limit at most."""
        low, high = np.zeros(len(r1), np.int64), np.full(len(r1), self.limit, np.int64)
        for _ in range(int(self.limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes(r1, a1, mid) == self.hashes(r2, a2, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, r1: np.ndarray, a1: np.ndarray, r2: np.ndarray, a2: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the first suffix stands before the second; where they are equal, ties says."""
        n = self.common(r1, a1, r2, a2)
        i = np.minimum(n, self.limit - 1)
        x, y = self.data[r1, a1 + i], self.data[r2, a2 + i]
        return np.where(n == self.limit, ties, x < y)

    def sort(self, group: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A stable order by group, which must be sorted already, then by suffix: runs double until each group is one.

        All merges of a level are done at once: an element's place is its place in its run plus the number of elements
        of the neighbouring run that go before it, found by binary search.
        """
        n = len(row)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        start, length = np.repeat(first, size), np.repeat(size, size)
        local = np.arange(n) - start
        run = 1
        while n and run < int(size.max()):
            todo = np.flatnonzero(length > run)
            pos, low_run = local[todo], (local[todo] // run) * run
            right = (low_run // run) % 2 == 1
            other = np.where(right, low_run - run, low_run + run)
            count = np.clip(length[todo] - other, 0, run)
            base = start[todo] + other
            lo, hi = np.zeros(len(todo), np.int64), count.copy()
            mine = order[todo]
            for _ in range(int(run).bit_length()):
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                theirs, own = order[base[open_] + mid], mine[open_]
                # an equal element of the left run goes first
                ahead = self.before(row[theirs], at[theirs], row[own], at[own], right[open_])
                lo[open_], hi[open_] = np.where(ahead, mid + 1, lo[open_]), np.where(ahead, hi[open_], mid)
            merged = np.minimum(low_run, other)
            place = start[todo] + merged + (pos - low_run) + lo
            fresh = order.copy()
            fresh[place] = mine
            order = fresh
            run *= 2
        return order

    def classes(self, group: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of sort(), and a class number for each place in it: equal for suffixes of one group whose first
        limit bytes are equal, byte for byte."""
        order = self.sort(group, row, at)
        if not len(order):
            return order, order
        r, a, g = row[order], at[order], group[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (self.common(r[1:], a[1:], r[:-1], a[:-1]) < self.limit)
        number = np.cumsum(fresh) - 1
        lead = np.flatnonzero(fresh)[number]
        bad = np.zeros(len(order), bool)
        for i in range(0, len(order), 100_000):
            s, cols = slice(i, i + 100_000), np.arange(self.limit)
            bad[s] = (self.data[r[s, None], a[s, None] + cols] != self.data[r[lead[s]][:, None], a[lead[s]][:, None] + cols]).any(axis=1)
        top = int(number[-1]) + 1
        for c in np.unique(number[bad]):  # a collision: this class is told apart by its bytes
            members = np.flatnonzero(number == c)
            _, split = np.unique(self.data[r[members, None], a[members, None] + np.arange(self.limit)], axis=0, return_inverse=True)
            number[members] = top + split.reshape(-1)
            top += int(split.max()) + 1
        return order, number
