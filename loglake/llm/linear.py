"""Hashed token n-grams of many texts at once, and logistic regression over them by follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from loglake.llm.kernels import LOWER, ODD, SPACE, U, mix, span_hashes

LETTER, DIGIT, PUNCT = 1, 2, 3
CLASS = np.full(256, PUNCT, np.uint8)
CLASS[SPACE] = 0
CLASS[48:58] = DIGIT
CLASS[65:91] = LETTER
CLASS[97:123] = LETTER
CLASS[128:] = LETTER
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


class Tokens:
    """Runs of letters, of digits and of other characters (a letter: a-z, A-Z or not ASCII), in texts laid end to end.

    surface: hashes of the runs, A-Z as a-z. shape: lower, Capital, UPPER or mixed for letters, one for digits, the
    characters themselves for others, and whether the run equals the one before it.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        kind = CLASS[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[off] = True
        starts = np.flatnonzero(edge)
        starts, ends = starts[:-1], starts[1:]
        solid = kind[starts] != 0 if len(starts) else np.empty(0, bool)
        starts, ends = starts[solid], ends[solid]
        self.data, self.starts, self.ends = data, starts, ends
        self.kind = kind[starts]
        self.first = np.searchsorted(starts, off)
        self.surface = span_hashes(data, starts, ends, True)
        upper = np.concatenate([[0], np.cumsum(UPPER[data], dtype=np.int64)])
        n, caps = ends - starts, upper[ends] - upper[starts] if len(starts) else np.empty(0, np.int64)
        capital = UPPER[data[starts]] if len(starts) else np.empty(0, bool)
        letters = np.where(caps == 0, 1, np.where((caps == 1) & capital & (n > 1), 2, np.where(caps * 2 >= n, 3, 4)))
        code = np.where(self.kind == LETTER, letters, 5).astype(np.uint64)
        self.shape = np.where(self.kind == PUNCT, self.surface, mix(code))
        same = np.zeros(len(n), bool)
        same[1:] = self.surface[1:] == self.surface[:-1]
        same[self.first[:-1][self.first[:-1] < len(n)]] = False
        self.shape ^= same.astype(np.uint64) * ODD

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each run, A-Z as a-z; of all of it where it is shorter."""
        return span_hashes(self.data, self.starts, np.minimum(self.starts + n, self.ends), True)

    def __len__(self) -> int:
        return len(self.surface)


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of k tokens on end, at the place of the first; those that would pass the end are of what is there."""
    total = np.full(len(h), seed, np.uint64) * ODD
    for i in range(k):
        total[: len(h) - i] = mix(total[: len(h) - i] + h[i:])
    return total


@dataclass
class Ftrl:
    """Logistic regression; per-coordinate FTRL-proximal with L1 and L2. Features are (indices, values) a row."""

    dim: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    bias: float = 0.0
    z: np.ndarray = field(default=None)
    n: np.ndarray = field(default=None)

    def __post_init__(self):
        self.z, self.n = np.zeros(self.dim), np.zeros(self.dim)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 3, seed: int = 7) -> Ftrl:
        mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        order, seen = np.random.default_rng(seed), 0.0
        for _ in range(epochs):
            for i in order.permutation(len(rows)).tolist():
                at, x = rows[i]
                w = self.weights(at)
                g0 = 1 / (1 + np.exp(-min(max(self.bias + float(w @ x), -35.0), 35.0))) - y[i]
                g = g0 * x
                was = self.n[at]
                now = was + g * g
                self.z[at] += g - (np.sqrt(now) - np.sqrt(was)) / self.alpha * w
                self.n[at] = now
                seen += g0 * g0  # the bias is learned as well, without a penalty
                self.bias -= self.alpha * g0 / (self.beta + seen**0.5)
        return self

    def logit(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        w = self.weights()
        return np.array([self.bias + float(w[at] @ x) for at, x in rows])


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def per_text_sums(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(v, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


def index(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


__all__ = ["LOWER", "Ftrl", "Tokens", "grams", "index", "per_text_sums", "sigmoid"]
