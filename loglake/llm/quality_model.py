"""Quality classifier: hashed token n-grams, logistic regression by FTRL, scores as sparse dot products.

Features of a text: unigrams and bigrams of its tokens (case folded) and n-grams of up to three token shapes, each
hashed to BITS bits and weighted by its share of the text's tokens. Trained on a bounded sample of labelled documents
(SAMPLE rows and common.SAMPLE_BYTES at most, the first by a hash of the id); every document's whole text is scored.

Defined cases: a null, empty or blank text has no features and gets the training mean as score; without labelled
documents every score is 0.5; an id of several rows is learned once, from its least text; repeated rows get equal scores;
whole texts are scored, however long; a null doc_id stays null; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import bucket_of, labelled_sample, raw, slices, table, temporaries, texts
from loglake.llm.linear import Ftrl, Tokens, grams, index, per_text_sums, sigmoid

BITS = 18
SAMPLE = 6000
THRESHOLD = 0.3
SCALE = 20.0
FOLDS = 5


def _families(t: Tokens) -> Iterator[np.ndarray]:
    yield index(grams(t.surface, 1, 1), BITS)
    yield index(grams(t.surface, 2, 2), BITS)
    for k in (1, 2, 3):
        yield index(grams(t.shape, k, 2 + k), BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        t = Tokens(data, off)
        total = np.zeros(len(t))
        for at in _families(t):
            total += self.weights[at]
        return sigmoid(self.bias + SCALE * per_text_sums(total, t.first) / np.maximum(np.diff(t.first), 1))


def rows(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its feature indices, ascending, and their values."""
    t = Tokens(data, off)
    every = np.stack(list(_families(t)), 1) if len(t) else np.empty((0, 5), np.int64)
    out = []
    for a, b in zip(t.first[:-1], t.first[1:]):
        at, n = np.unique(every[a:b], return_counts=True)
        out.append((at.astype(np.int32), (SCALE * n / max(b - a, 1)).astype(np.float32)))
    return out


def train(texts_: list[str], y: np.ndarray) -> Model:
    found = [r for at in range(0, len(texts_), 500) for r in rows(*_laid(texts_[at : at + 500]))]
    m = Ftrl(1 << BITS).fit(found, y)
    return Model(m.weights().astype(np.float32), m.bias if len(y) else 0.0)


def _laid(many: list[str]):
    col = texts(pa.array(many, pa.string()))
    return raw(col, 0, len(col))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep=None) -> Model:
    """keep: a condition on doc_id that training rows meet. The driver holds the sample's texts."""
    with temporaries(docs.sparkSession):
        got = labelled_sample(docs, labels, "quality", sample, keep).toPandas().sort_values("doc_id")
    return train(got["text"].tolist(), got["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text, 2 << 20):
                s = shared.value.scores(*raw(text, at, to))
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), keep=bucket_of("doc_id", FOLDS) != 0)
    return score(docs, model).select("doc_id", (bucket_of("doc_id", FOLDS) == 0).alias("held_out"), F.col("score"), "predicted")
