"""Suffix order by hash-compared merge sort.

Prefix sums of a polynomial hash (modulo 2**64, random values for bytes) give the hash
of any piece of a text in a few operations. The common extension of two suffixes is
found by binary search over its length, so a comparison takes logarithmically many
steps. Groups of suffixes are merge-sorted, all groups at once: at each level every
suffix finds its rank in the neighbouring run by binary search.

Equal neighbours are verified byte by byte; if one turns out to be a collision, its
whole group is sorted again by the bytes themselves.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(7_262_041)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Suffixes:
    """A text with its prefix hashes; suffixes are compared over ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        n = len(text)
        self.power = powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[text] * self.power[:n], out=self.prefix[1:])

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Hash of the ``depth`` bytes at each place."""
        return (self.prefix[at + self.depth] - self.prefix[at]) * self.power[len(self.text) - at]

    def equal(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        """Whether the pieces of this length at a and b have equal hashes."""
        n = len(self.text)
        return (self.prefix[a + length] - self.prefix[a]) * self.power[n - a] == (self.prefix[b + length] - self.prefix[b]) * self.power[n - b]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, ``depth`` at most; pieces must lie within the text."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.depth, np.int64)
        same = self.equal(a, b, self.depth)
        lo[same] = self.depth
        for _ in range(int(self.depth).bit_length()):
            mid = (lo + hi + 1) >> 1
            ok = self.equal(a, b, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; equal ones as ``ties`` says."""
        same = self.equal(a, b, self.depth)
        out = ties.copy()
        if not same.all():
            x, y = a[~same], b[~same]
            n = self.common(x, y)
            out[~same] = self.text[x + np.minimum(n, self.depth - 1)] < self.text[y + np.minimum(n, self.depth - 1)]
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes ``at`` within their groups (``group`` ascends), and which equal the one before.

        Returns (order, same): ``order`` indexes ``at``.
        """
        n = len(at)
        order = np.arange(n)
        if not n:
            return order, np.zeros(0, bool)
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(starts, n))
        first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        rank = np.arange(n) - first
        width = 1
        while width < sizes.max():
            busy = np.flatnonzero(size > width)
            r, base, total = rank[busy], first[busy], size[busy]
            run = r // width
            other = (run ^ 1) * width
            length = np.clip(total - other, 0, width)
            lo, hi = np.zeros(len(busy), np.int64), length.copy()
            own, right = at[order[busy]], (run & 1).astype(bool)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                them = at[order[base[open_] + other[open_] + mid]]
                # The left run's element comes first among equals.
                before = self.less(them, own[open_], right[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = base + np.minimum(run, run ^ 1) * width + (r - run * width) + lo
            moved = order[busy]
            order[to] = moved
            width *= 2
        same = np.zeros(n, bool)
        if n > 1:
            near = np.flatnonzero(group[1:] == group[:-1]) + 1
            same[near] = self.equal(at[order[near]], at[order[near - 1]], self.depth)
            self._verify(at, group, order, same, starts, sizes)
        return order, same

    def _verify(self, at, group, order, same, starts, sizes) -> None:
        pairs = np.flatnonzero(same)
        reach = np.arange(self.depth)
        for lo in range(0, len(pairs), 200_000):
            p = pairs[lo : lo + 200_000]
            wrong = p[(self.text[at[order[p], None] + reach] != self.text[at[order[p - 1], None] + reach]).any(axis=1)]
            for g in np.unique(np.searchsorted(starts, wrong, side="right") - 1).tolist():
                a, n = int(starts[g]), int(sizes[g])
                piece = lambda i: self.text[at[i] : at[i] + self.depth].tobytes()
                order[a : a + n] = own = sorted(order[a : a + n].tolist(), key=piece)
                same[a : a + n] = [False, *(piece(x) == piece(y) for x, y in zip(own, own[1:], strict=False))]
