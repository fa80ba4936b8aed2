"""Language ID by string kernels: presence of character n-grams, Nyström landmarks, one-versus-rest kernel ridge.

The kernel of two texts is the number of n-grams of 1 to ORDER bytes (UTF-8, A-Z as a-z) that both have, over the square
root of what each has: a blended-spectrum presence kernel, over all n-grams there are and without hashing. LANDMARKS
sample texts of each language span the Nyström features K(x, landmarks) K(landmarks)^-1/2; one ridge regression a language
(+1 or -1) is solved on them. Scoring is two matrix products a batch: presence of the n-grams that landmarks have times
their presence in the landmarks, then times the weights.

Trained on a bounded sample of documents with a language: SAMPLE rows and SAMPLE_BYTES at most, by turns from each language
(the first of each by a hash of the id, at most OF_ONE), so that a rare language is not crowded out. Every document's whole
text is read. The score is the winner's regression value, moved from -1..1 to 0..1.

The score tells languages apart, not strangers: a text in none of them scores near 0.5. What accept() rejects strangers by
is familiarity: the share of a text's distinct n-grams of ORDER bytes (of the longest it has, if shorter) that at least
KNOWN of the winner's training texts have. Each language's least is SLACK times the QUANTILE of what its training texts
reach when HELD folds are held out in turn; ALLOWANCE / sqrt(n) makes up for what chance does to a text of n n-grams.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the language first in order; without
training rows everything is `und`; a language of one training text has nothing held out, and so no least familiarity; an
id of several rows is learned once, from its least language and text; repeated rows get equal results; very long texts are
taken in blocks; a null doc_id stays null; an empty table gives no rows; lang, source, doc_id and further columns are not
read when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglake.llm.common import bounded_texts, bucket_of, crowded, materialise, raw, slices, table, temporaries, texts, tidy
from loglake.llm.kernels import LOWER

ORDER = 3
LANDMARKS = 24
MOST_LANDMARKS = 512
SAMPLE = 3000
SAMPLE_BYTES = 16 << 20
OF_ONE = 999
SPARE = 4  # times OF_ONE ids of a crowded language are expected to be ordered
RIDGE = 0.1
FOLDS = 4
UND = "und"
LEAST_SCORE = 0.3
KNOWN = 0.003
HELD = 4
QUANTILE = 0.05
SLACK = 0.65
ALLOWANCE = 0.5
TEXTS = 256  # in a batch: a text's number and an n-gram of three bytes make 32 bits
BLOCK = 1 << 20
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def _distinct(v: np.ndarray) -> np.ndarray:
    """v sorted, each value once; v is spent. Of small integers a sort is faster than the hashing of np.unique."""
    v.sort()
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def distinct_grams(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the distinct n-grams of each text, as (text, code) ascending. At most TEXTS texts."""
    low = LOWER[data].astype(np.uint32)
    of = np.repeat(np.arange(len(off) - 1, dtype=np.uint32), np.diff(off))
    out = []
    for k in range(1, ORDER + 1):
        found = []
        for a in range(0, max(len(low) - k + 1, 0), BLOCK):  # a long text's blocks overlap by what an n-gram needs
            b = min(a + BLOCK, len(low) - k + 1)
            code = of[a:b] << np.uint32(24)
            for i in range(k):
                code |= low[a + i : b + i] << np.uint32(8 * (k - 1 - i))
            found.append(_distinct(code[of[a:b] == of[a + k - 1 : b + k - 1]]))
        every = np.empty(0, np.uint32) if not found else found[0] if len(found) == 1 else _distinct(np.concatenate(found))
        out.append(((every >> np.uint32(24)).astype(np.int64), (every & np.uint32(0xFFFFFF)).astype(np.int64)))
    return out


def numbered(order: int, code: np.ndarray) -> np.ndarray:
    """Codes of an order (from 0) as numbers that differ between orders."""
    return code + sum(256**k for k in range(1, order + 1))


@dataclass
class Landmarks:
    """Presence of n-grams in landmark texts, sparse: grams ascending, of grams[i] the landmarks member[first[i]:first[i + 1]]."""

    grams: np.ndarray
    first: np.ndarray
    member: np.ndarray
    sizes: np.ndarray  # n-grams of each landmark

    @staticmethod
    def of(many: list[str]) -> Landmarks:
        code, mark, sizes = [], [], np.zeros(len(many))
        for at in range(0, len(many), TEXTS):
            for order, (of, c) in enumerate(distinct_grams(*_laid(many[at : at + TEXTS]))):
                code.append(numbered(order, c))
                mark.append(of + at)
                sizes += np.bincount(of + at, minlength=len(many))
        code, mark = np.concatenate(code or [np.empty(0, np.int64)]), np.concatenate(mark or [np.empty(0, np.int64)])
        by = np.argsort(code, kind="stable")
        grams, first = np.unique(code[by], return_index=True)
        return Landmarks(grams, np.append(first, len(code)), mark[by].astype(np.int32), sizes)

    def kernel(self, grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """K(texts, landmarks) for n texts of distinct_grams()."""
        m = len(self.sizes)
        size, out = np.zeros(n), np.zeros((n, m), np.float32)
        for order, (of, code) in enumerate(grams):
            size += np.bincount(of, minlength=n)
            code = numbered(order, code)
            at = np.minimum(np.searchsorted(self.grams, code), max(len(self.grams) - 1, 0))
            hit = np.flatnonzero(self.grams[at] == code) if len(self.grams) else np.empty(0, np.int64)
            used, col = np.unique(at[hit], return_inverse=True)
            mine, theirs = np.zeros((n, len(used)), np.float32), np.zeros((len(used), m), np.float32)
            mine[of[hit], col] = 1
            count = self.first[used + 1] - self.first[used]
            rows = np.repeat(np.arange(len(used)), count)
            spots = np.arange(count.sum()) + np.repeat(self.first[used] - (np.cumsum(count) - count), count)
            theirs[rows, self.member[spots]] = 1
            out += mine @ theirs
        return out / np.sqrt(np.maximum(size[:, None] * self.sizes[None, :], 1)).astype(np.float32)


def longest(grams: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of each text's n-grams of the longest order it has."""
    top = np.full(n, -1)
    for order, (of, _) in enumerate(grams):
        top[of] = order
    keep = [(of[top[of] == order], numbered(order, code[top[of] == order])) for order, (of, code) in enumerate(grams)]
    return np.concatenate([x for x, _ in keep]), np.concatenate([x for _, x in keep])


def familiar(of: np.ndarray, number: np.ndarray, n: int, known: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of each of n texts with the n-grams longest() gives: the share that is known to language which[text], and what chance
    may take from it. known: ascending, language << 32 | number."""
    key = (np.maximum(which, 0)[of] << 32) | number
    at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
    has = np.bincount(of, known[at] == key if len(known) else None, n) if len(known) else np.zeros(n)
    count = np.bincount(of, minlength=n)
    return np.minimum(has / np.maximum(count, 1) + ALLOWANCE / np.sqrt(np.maximum(count, 1)), 1)


def lettered(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    n = np.concatenate([[0], np.cumsum(ASCII_LETTER[data], dtype=np.int64)])
    has = n[off[1:]] > n[off[:-1]]
    for i in np.flatnonzero(~has & (off[1:] > off[:-1])).tolist():
        has[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "ignore"))
    return has


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray
    known: np.ndarray  # language << 32 | n-gram, of those that KNOWN of its texts have, ascending
    least: np.ndarray  # for each language, the least familiarity

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each of at most TEXTS texts its language, the score, and whether it is as familiar as texts of that language
        are (`und` is not)."""
        n = len(off) - 1
        if not self.languages:
            return [UND] * n, np.zeros(n), np.zeros(n, bool)
        grams = distinct_grams(data, off)
        v = self.landmarks.kernel(grams, n) @ self.weights
        best = v.argmax(1)
        ok = lettered(data, off)
        score = np.where(ok, np.clip((v[np.arange(n), best] + 1) / 2, 0, 1), 0.0).astype(float)
        met = ok & (familiar(*longest(grams, n), n, self.known, best) >= self.least[best])
        return [self.languages[i] if k else UND for i, k in zip(best.tolist(), ok.tolist())], score, met


def _laid(many: list[str]):
    col = texts(pa.array(many, pa.string()))
    return raw(col, 0, len(col))


def train(many: list[str], lang: list[str], landmarks: int = LANDMARKS) -> Model:
    languages = sorted(set(lang))
    if not languages:
        return Model([], Landmarks.of([]), np.zeros((0, 0), np.float32), np.zeros(0, np.int64), np.zeros(0))
    y = np.array([languages.index(x) for x in lang])
    nth = np.zeros(len(y), np.int64)  # of its language
    for c in range(len(languages)):
        nth[y == c] = np.arange((y == c).sum())
    chosen = np.flatnonzero(nth < min(landmarks, max(1, MOST_LANDMARKS // len(languages))))[:MOST_LANDMARKS]
    marks = Landmarks.of([many[i] for i in chosen.tolist()])
    k, of, number = [], [], []
    for at in range(0, len(many), TEXTS):
        part = many[at : at + TEXTS]
        grams = distinct_grams(*_laid(part))
        k.append(marks.kernel(grams, len(part)))
        o, m = longest(grams, len(part))
        of.append((o + at).astype(np.int32))
        number.append(m.astype(np.int32))
    k = np.concatenate(k).astype(float)
    root = inverse_root(k[chosen])
    w = ridge(k @ root, y, len(languages))
    known, least = _familiarity(np.concatenate(of), np.concatenate(number), y, nth % HELD)
    return Model(languages, marks, (root @ w).astype(np.float32), known, least)


def inverse_root(k: np.ndarray) -> np.ndarray:
    """K^-1/2 of a kernel matrix, up to a rotation; directions that it hardly has are left out."""
    s, u = np.linalg.eigh((k + k.T) / 2)
    good = s > 1e-6 * s.max()
    return u[:, good] / np.sqrt(s[good])


def ridge(z: np.ndarray, y: np.ndarray, languages: int, least: float = RIDGE) -> np.ndarray:
    """One-versus-rest weights on features z; each language counts alike."""
    target = np.where(y[:, None] == np.arange(languages), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=languages)[y]
    return np.linalg.solve((z * weight[:, None]).T @ z + least / len(z) * np.eye(z.shape[1]), (z * weight[:, None]).T @ target)


def _familiarity(of: np.ndarray, number: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model.known, and Model.least from texts that are held out of what is known; of, number: the texts' n-grams."""
    size = np.bincount(y)
    reached = np.zeros(len(y))
    key = (y[of] << 32) | number
    every, place = np.unique(key, return_inverse=True)
    total, need = np.bincount(place, minlength=len(every)), KNOWN * size[every >> 32]
    for f in range(HELD):
        held = fold[of] == f
        left = total - np.bincount(place[held], minlength=len(every))
        known = every[(left > 0) & (left >= KNOWN * (size - np.bincount(y[fold == f], minlength=len(size)))[every >> 32])]
        texts_ = np.flatnonzero(fold == f)
        reached[texts_] = familiar(np.searchsorted(texts_, of[held]), number[held].astype(np.int64), len(texts_), known, y[texts_])
    least = np.array([SLACK * np.quantile(reached[y == c], QUANTILE) if size[c] > 1 else 0.0 for c in range(len(size))])
    return every[total >= need], least


def sampled(docs: DataFrame, sample: int = SAMPLE, keep=None) -> DataFrame:
    """(doc_id, text, lang) of the training sample. Of a crowded language only ids of low hash are ordered: as many as give
    SPARE times OF_ONE of them, with a chance of about 1e-700 to give fewer than OF_ONE."""
    known = docs.select("doc_id", "text", "lang").dropna()
    ids = known if keep is None else known.where(keep)
    ids = materialise(ids.groupBy("doc_id").agg(F.min("lang").alias("_of")), "ids").withColumn("_h", F.xxhash64("doc_id"))
    hot = F.broadcast(crowded(ids, "_of").withColumnRenamed("n", "_many"))  # fewer than common.CROWDED
    low = (F.col("_h").cast("double") + 2.0**63) / 2.0**64 * F.col("_many") < SPARE * OF_ONE
    ids = ids.join(hot, "_of", "left").where(F.col("_many").isNull() | low).drop("_many")
    # the first of each language, in two levels: of each of 256 shares of it, then of what these leave
    for by in (("_of", F.pmod("_h", F.lit(256))), ("_of",)):
        ids = ids.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("_h", "doc_id"))).where(F.col("_n") <= OF_ONE)
    picked = ids.orderBy("_n", "_h", "doc_id").limit(sample).select("doc_id")
    return bounded_texts(known, picked, SAMPLE_BYTES, ("lang",))


def fit(docs: DataFrame, sample: int = SAMPLE, keep=None) -> Model:
    """keep: a condition on doc_id that training rows meet."""
    with temporaries(docs.sparkSession):
        got = sampled(docs, sample, keep).toPandas().sort_values("doc_id")
    return train(got["text"].tolist(), got["lang"].tolist())


def _each(model, text: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    for a, b in slices(text, 2 << 20):
        for at in range(a, b, TEXTS):
            to = min(at + TEXTS, b)
            yield at, to, *model.predict(*raw(text, at, to))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded sample's n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, lang, score, _ in _each(shared.value, texts(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """docs, with its own columns, without those whose language is `und`, scores under `least` or is too unfamiliar (see
    Model.predict): one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, lang, score, met in _each(shared.value, texts(b.column(where))):
                yield b.slice(at, to - at).filter(pa.array((np.array(lang) != UND) & (score >= least) & met))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, keep=bucket_of("doc_id", FOLDS) != 2)
    return predict(docs, model).select("doc_id", (bucket_of("doc_id", FOLDS) == 2).alias("held_out"), "lang_pred", "score")
