"""Vectorised kernels over the UTF-8 bytes of many texts at once: word bounds, word hashes and windows of words."""

from __future__ import annotations

import functools

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
U = np.uint64
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(4)
def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    return v[LOWER] if fold else v


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each data[start:end] (ascending, not overlapping); fold: A-Z as a-z. Spans are taken in blocks of
    BLOCK bytes (or one longer span), so that a very long text needs no more memory than many short ones."""
    out = np.empty(len(starts), np.uint64)
    at, values = 0, _byte_values(fold)
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[to - 1]) - base
        up, down = _power_tables(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[data[base : base + n]] * up[:n], out=total[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * ODD)
        at = to
    return out


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts laid end to end. of: text of each word; first: first word of each text, then the total."""

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: bool = False):
        solid = ~SPACE[data]
        begins, finishes = solid.copy(), solid.copy()
        if len(data):
            begins[1:] &= ~solid[:-1]
            finishes[:-1] &= ~solid[1:]
            at = off[:-1][off[:-1] < off[1:]]
            begins[at] = solid[at]
            finishes[at[1:] - 1] = solid[at[1:] - 1]
        self.data, self.off, self.fold, self.solid = data, off, fold, solid
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)

    @functools.cached_property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, self.fold)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words within a text, and for each text (and the total) its first window."""
        h, n = self.hashes, len(self.hashes)
        counts = np.maximum(self.counts - k + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        if n < k:
            return np.empty(0, np.uint64), first
        total = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            total = mix(total + h[i : n - k + 1 + i]) if k <= 2 else total * U(BASE) + h[i : n - k + 1 + i]
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        return mix(total[at]), first

    def shingle_sets(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sorted distinct hashes of its k-word windows, or of all its words as one where they are
        fewer; without words none. Second: each text's first, then the total."""
        h, first = self.windows(k)
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        sizes = np.diff(first)
        if len(short):
            extra = np.array([_sequence(self.hashes[self.first[i] : self.first[i + 1]]) for i in short], np.uint64)
            h = np.insert(h, first[short], extra)
            sizes[short] = 1
            first = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a > 1:
                h[a:b].sort()
        if len(h):
            new = np.empty(len(h), bool)
            new[0] = True
            np.not_equal(h[1:], h[:-1], out=new[1:])
            new[first[:-1][sizes > 0]] = True
            passed = np.concatenate([[0], np.cumsum(new)])
            h, first = h[new], passed[first]
        return h, first


def _sequence(h: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for x in h:
        total = mix(total * U(BASE) + x + ODD)
    return mix(total + U(len(h)))[0]
