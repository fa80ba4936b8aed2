"""Quality rules: document statistics, fixed base rules, and gradient-boosted trees over the statistics.

The trees are trained on a bounded sample of labelled documents (SAMPLE rows and common.SAMPLE_BYTES at most, the first by
a hash of the id), flattened into numpy node arrays and applied to all documents at once. The score may not rise with the share of repeated words,
of duplicate lines or of symbols.

Defined cases: a null, empty or blank text has no words and fails the base rules (fewer than 20 words); whole texts are
measured, however long; without any labelled document the trees keep all that the base rules keep. Labels of unknown
documents take no place in the sample, and an id of several labels or rows counts once, with its highest label and its
least text. Rows are scored one by one: repeated ones get equal verdicts, a null doc_id stays null, an empty table gives no
rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglake.llm import boosting
from loglake.llm.common import labelled_sample, raw, slices, table, temporaries, texts
from loglake.llm.kernels import Words, span_hashes

SAMPLE = 6000
THRESHOLD = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_digits", "n_lines", "n_distinct", "n_ended", "n_punctuated")
#: Features of the trees and which way the score may move with each.
FEATURES = {"repeat_share": -1, "dup_line_share": -1, "symbol_share": -1, "upper_share": 0, "digit_share": 0, "mean_word": 0, "distinct_share": 0, "words_a_line": 0, "ended_share": 0, "punctuated_share": 0, "log_words": 0}
WINDOW = 8


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _sorted_within(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h sorted within each text, and whether a value equals the one before it in its text."""
    s = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            s[a:b].sort()
    again = np.zeros(len(s), bool)
    if len(s):
        again[1:] = s[1:] == s[:-1]
        again[first[:-1][first[:-1] < first[1:]]] = False
    return s, again


def repeated_words(w: Words, k: int = WINDOW) -> np.ndarray:
    """For each text, how many words lie in k-word windows that it has twice or more."""
    h, first = w.windows(k)
    s, again = _sorted_within(h, first)
    out = np.zeros(len(w.counts), np.int64)
    per = np.concatenate([[0], np.cumsum(again)])
    for i in np.flatnonzero(per[first[1:]] > per[first[:-1]]).tolist():
        a, b = first[i], first[i + 1]
        hit = np.isin(h[a:b], s[a:b][again[a:b]])
        edge = np.zeros(b - a + k, np.int64)
        at = np.flatnonzero(hit)
        edge[at] += 1
        np.add.at(edge, at + k, -1)
        out[i] = (np.cumsum(edge) > 0).sum()
    return out


def duplicate_lines(w: Words) -> np.ndarray:
    """For each text, the lines (between line feeds) that have a word and equal an earlier line."""
    data, off = w.data, w.off
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    # a text's first line starts at its offset; a feed's next line may start at the text's end and then is empty
    of = np.searchsorted(off, starts, "right") - 1
    ends = np.concatenate([starts[1:], [len(data)]])
    ends = np.minimum(ends, off[np.minimum(of + 1, len(off) - 1)])
    ends = ends - (np.isin(ends - 1, feeds, assume_unique=False) & (ends > starts))
    words = np.concatenate([[0], np.cumsum(w.solid, dtype=np.int64)])
    real = (ends > starts) & (words[np.maximum(ends, starts)] > words[starts])
    starts, ends, of = starts[real], ends[real], of[real]
    h = span_hashes(data, starts, ends, False)
    first = np.searchsorted(of, np.arange(len(off)))
    _, again = _sorted_within(h, first)
    return _per_text(again, first)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS for each text."""
    w = Words(data, off)
    lead = (data & 0xC0) != 0x80
    _, seen = _sorted_within(w.hashes, w.first)
    last = data[w.ends - 1] if len(w.ends) else np.empty(0, np.uint8)
    ended = (last == 46) | (last == 33) | (last == 63)
    letters = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | ((last >= 48) & (last <= 57))
    return np.stack(
        [
            w.counts,
            _per_text(lead & w.solid, off),
            _per_text(SYMBOLS[data], off),
            duplicate_lines(w),
            repeated_words(w),
            _per_text(lead, off),
            _per_text((data >= 65) & (data <= 90), off),
            _per_text((data >= 48) & (data <= 57), off),
            _per_text(data == 10, off) + 1,
            w.counts - _per_text(seen, w.first),
            _per_text(ended, w.first),
            _per_text(~letters, w.first),
        ],
        1,
    ).astype(np.int64)


def features(s: np.ndarray) -> np.ndarray:
    c = {k: s[:, i].astype(float) for i, k in enumerate(STATS)}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "n_chars", "n_lines"))
    return np.stack(
        [c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_symbols"] / chars, c["n_upper"] / chars, c["n_digits"] / chars, c["word_chars"] / words, c["n_distinct"] / words, words / lines, c["n_ended"] / words, c["n_punctuated"] / words, np.log(words)],
        1,
    )


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])


def measure(docs: DataFrame, extra: str = "") -> DataFrame:
    """doc_id, the extra column if any, and STATS."""
    extra_kind = f", `{extra}` {docs.schema[extra].dataType.simpleString()}" if extra else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text):
                s = statistics(*raw(text, at, to))
                keep = [b.column(0)[at:to], *([b.column(2)[at:to]] if extra else [])]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c) for c in s.T)], ["doc_id", *([extra] if extra else []), *STATS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *([extra] if extra else [])).mapInArrow(run, f"doc_id {kind}{extra_kind}, " + ", ".join(f"{k} long" for k in STATS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest:
    """Trees trained on the statistics of at most `sample` labelled documents: a few numbers a row go to the driver."""
    with temporaries(docs.sparkSession):
        rows = measure(labelled_sample(docs, labels, "quality", sample), "label").toPandas().sort_values("doc_id")
    s = rows[list(STATS)].to_numpy(np.int64).reshape(-1, len(STATS))
    return boosting.train(features(s), rows["label"].to_numpy(float), tuple(FEATURES.values()))


def judge(docs: DataFrame, forest: boosting.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some hundred nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text):
                s = statistics(*raw(text, at, to))
                failed = base_failed(s)
                score = shared.value.probability(features(s)) if len(shared.value.roots) else np.ones(len(s))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at:to].cast(pa.int64()), *(pa.array(s[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                    ["doc_id", *STATS[:5], "base_failed", "kept", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS[:5]) + ", base_failed boolean, kept boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
