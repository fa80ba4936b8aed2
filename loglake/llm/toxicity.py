"""Toxicity: a chain of linear models, one category after another.

Each model sees the text's hashed tokens and their beginnings (of PREFIXES bytes; present or not), so that it knows the kin
of a word it has met, and the probabilities that the models before it gave. In training those probabilities are out of
fold: each earlier model is trained on the other folds, on targets and features made from these folds alone, and predicts
the fold it has not seen; for scoring it is trained on all of them. Models are sparse logistic regressions (FTRL with L1).

The categories, in the chain's order, are label columns that the caller names. The tables at hand label toxicity as a whole;
there CATEGORIES are two steps towards it that are derived from the training rows, then the label: `marked` (toxic, and has a
feature that tells toxic documents), `dense` (marked, and the share of such features is above the median of marked ones).

Training takes a bounded sample of labelled documents (SAMPLE rows and common.SAMPLE_BYTES at most, the first by a hash of
the id); every document's whole text is scored, however long.

Defined cases: a null, empty or blank text has no tokens and is not toxic; without labelled or without toxic documents
nothing is toxic; an id of several rows is learned once, from its least text; ties and repeated rows get equal verdicts; a
null doc_id stays null; an empty table gives no rows; other columns, also of the categories' names, do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglake.llm.common import labelled_sample, raw, slices, table, temporaries, texts, tidy
from loglake.llm.kernels import U
from loglake.llm.linear import Ftrl, Tokens, grams, index, sigmoid

BITS = 20
SAMPLE = 6000
FOLDS = 3
CATEGORIES = ("marked", "dense", "toxic")
THRESHOLD = 0.5
L1 = 0.02
PREFIXES = (4, 5, 6)
EVIDENCE = 40.0  # log-likelihood ratio from which a feature counts
EPOCHS = 8
CHAIN = 4.0  # value of an earlier probability of 1 as a feature


def _laid(many: list[str]):
    col = texts(pa.array(many, pa.string()))
    return raw(col, 0, len(col))


def _families(t: Tokens) -> list[np.ndarray]:
    return [index(grams(h, 1, i), BITS) for i, h in enumerate((t.surface, *map(t.prefixes, PREFIXES)), 11)]


def token_rows(many: list[str]) -> list[np.ndarray]:
    """For each text the indices of its features, ascending, each once."""
    out = []
    for at in range(0, len(many), 500):
        t = Tokens(*_laid(many[at : at + 500]))
        every = np.stack(_families(t), 1)
        out += [np.unique(every[a:b]).astype(np.int32) for a, b in zip(t.first[:-1], t.first[1:])]
    return out


def telling(rows: list[np.ndarray], y: np.ndarray, least: float = EVIDENCE) -> np.ndarray:
    """Whether an index is commoner in positive texts than by chance: log-likelihood ratio of `least` or more."""
    n, k = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, v in zip(rows, y):
        n[r] += 1
        if v > 0:
            k[r] += 1
    share = min(max(float(np.mean(y > 0)) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(k > 0, k * np.log(k / (n * share)), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - share))), 0))
    return (n > 0) & (k > n * share) & (g >= least)


@dataclass
class Chain:
    """weights: for each category, of the indices that any model uses (a row each), then of earlier categories."""

    at: np.ndarray
    weights: np.ndarray
    before: np.ndarray
    bias: np.ndarray
    categories: tuple[str, ...] = CATEGORIES

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each category."""
        t = Tokens(data, off)
        n, k = len(off) - 1, len(self.bias)
        slot = self._slots()
        found = []
        of = np.repeat(np.arange(n), np.diff(t.first))
        for h in _families(t):
            s = slot[h]
            hit = np.flatnonzero(s >= 0)
            found.append(of[hit] * U(len(self.at) + 1).astype(np.int64) + s[hit])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        doc, s = pairs // (len(self.at) + 1), pairs % (len(self.at) + 1)
        out = np.zeros((n, k))
        for c in range(k):
            v = self.bias[c] + np.bincount(doc, self.weights[c][s], n) + CHAIN * out[:, :c] @ self.before[c][:c]
            out[:, c] = sigmoid(v)
        out[np.diff(t.first) == 0] = 0
        return out

    def _slots(self) -> np.ndarray:
        if not hasattr(self, "_slot"):
            self._slot = np.full(1 << BITS, -1, np.int32)
            self._slot[self.at] = np.arange(len(self.at))
        return self._slot


Targets = Callable[[list[np.ndarray], np.ndarray], np.ndarray]


def steps(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The targets of CATEGORIES, a column each, made from these rows and their toxicity alone."""
    toxic = y[:, -1] > 0
    marks = telling(rows, y[:, -1])
    has = np.array([marks[r].sum() for r in rows], float)
    share = has / np.maximum([len(r) for r in rows], 1)
    marked = toxic & (has > 0)
    middle = float(np.median(share[marked])) if marked.any() else 0.0
    return np.stack([marked, marked & (share > middle), toxic], 1).astype(float).reshape(-1, len(CATEGORIES))


def given(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Targets that the labels name themselves."""
    return (y > 0).astype(float)


def link(rows: list[np.ndarray], earlier: np.ndarray, v: np.ndarray) -> Ftrl:
    """One model of the chain: target v, on the features that tell it in these rows and on the probabilities of earlier
    categories (a column each)."""
    m = Ftrl((1 << BITS) + earlier.shape[1], alpha=1.0, l1=L1, l2=0.01)
    return m.fit(_features(rows, earlier, telling(rows, v)), v, epochs=EPOCHS)


def _features(rows: list[np.ndarray], earlier: np.ndarray, used: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    extra = (1 << BITS) + np.arange(earlier.shape[1])
    out = []
    for r, e in zip(rows, earlier):
        r = r if used is None else r[used[r]]
        out.append((np.concatenate([r, extra]), np.concatenate([np.ones(len(r)), CHAIN * e])))
    return out


def out_of_fold(rows: list[np.ndarray], y: np.ndarray, targets: Targets, folds: int = FOLDS) -> np.ndarray:
    """The probability of each category but the last for each row, from models that have seen neither it nor its fold."""
    fold = np.arange(len(rows)) % folds
    kept = [np.flatnonzero(fold != f) for f in range(folds)]
    aims = [targets([rows[i] for i in k.tolist()], y[k]) for k in kept]
    out = np.zeros((len(rows), y.shape[1] - 1 if targets is given else len(CATEGORIES) - 1))
    for c in range(out.shape[1]):
        for f, (keep, aim) in enumerate(zip(kept, aims)):
            held = np.flatnonzero(fold == f)
            if len(held) and len(keep):
                m = link([rows[i] for i in keep.tolist()], out[keep, :c], aim[:, c])
                out[held, c] = sigmoid(m.logit(_features([rows[i] for i in held.tolist()], out[held, :c])))
    return out


def train(many: list[str], y: np.ndarray, categories: tuple[str, ...] | None = None, folds: int = FOLDS) -> Chain:
    """y: a column for each of the categories, or, without these, of toxicity alone."""
    rows, y = token_rows(many), y.reshape(len(many), y.shape[1] if y.ndim > 1 else 1)
    targets = given if categories else steps
    names = tuple(categories or CATEGORIES)
    earlier = out_of_fold(rows, y, targets, folds)
    aims = targets(rows, y)
    models = [link(rows, earlier[:, :c], aims[:, c]) for c in range(len(names))]
    size, k = 1 << BITS, len(names)
    all_w, before = np.zeros((k, size)), np.zeros((k, k))
    for c, m in enumerate(models):
        w = m.weights()
        all_w[c], before[c, :c] = w[:size], w[size:]
    at = np.flatnonzero((all_w != 0).any(0))
    bias = np.array([m.bias if aims[:, c].any() else -35.0 for c, m in enumerate(models)])
    return Chain(at, all_w[:, at], before, bias, names)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: tuple[str, ...] | None = None) -> Chain:
    """categories: columns of labels in the chain's order, the verdict last; without them the column `toxic` and CATEGORIES."""
    names = tuple(categories or ("toxic",))
    with temporaries(docs.sparkSession):
        got = labelled_sample(docs, labels, names, sample).toPandas().sort_values("doc_id")
    return train(got["text"].tolist(), got[list(names)].to_numpy(float), categories)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the probability of each category, score (of the last) and the verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # as many weights as the bounded sample gives
    names = ["doc_id", *(f"p_{c}" for c in chain.categories), "score", "toxic"]
    schema = "doc_id long, " + ", ".join(f"`{n}` double" for n in names[1:-1]) + ", toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text):
                p = shared.value.probabilities(*raw(text, at, to))
                cols = [pa.array(x) for x in p.T]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), *cols, cols[-1], pa.array(p[:, -1] >= threshold)], names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def accept(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with its own columns, without the toxic ones: one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(where))
            for at, to in slices(text):
                toxic = shared.value.probabilities(*raw(text, at, to))[:, -1] >= threshold
                yield b.slice(at, to - at).filter(pa.array(~toxic))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
