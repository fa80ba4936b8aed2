"""Token packing: documents into sequences of a fixed window with next to no padding.

1. Each document is encoded once and gets id 0 at its end. A very long text is encoded part by part.
   Whole windows of a long document are sequences by themselves; what remains is a piece shorter than the window.
   Pieces go to a written table, each with its partition and its rank among equally long pieces of that partition.
2. The histogram of piece lengths (as many bins as the window, whatever the input) goes to the driver. All pairs and
   triples of lengths that fill the window exactly are enumerated, their repeat counts solved by non-negative least
   squares against the histogram (accelerated projected gradient), rounded down to what the histogram allows, and the
   rest is used up greedily, largest counts first.
3. Pieces that no combination takes are laid end to end, by length and rank, and cut at every window: the greedy packing
   of the residuals. Only the last sequence of all can be shorter than the window.
4. A piece's global rank among its length (ranks before its partition + its own) gives its place by arithmetic. No group
   of equally long pieces is ever gathered: a third of all documents may have one length.

Defined cases: a null or empty text is the single id 0; repeated rows and ids are separate documents; a null doc_id
stays null; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loglake.llm.common import materialise, slices, table, texts

WINDOW = 1024
ROUNDS = 400
OWN = 1 << 62  # sequence ids of whole windows start here, 2**36 for each partition
PART = 1 << 20
#: Where a text may be cut: the vocabulary's pattern never joins a character to a white space that follows it.
CUT = re.compile(r"(?<=[!-~])[ \n]")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Content and id of the tokens that the tokenizer's JSON, beside the rank file, adds to the ranks; without one none."""
    beside = os.path.splitext(vocabulary)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if odd := [x["content"] for x in found if x["single_word"] or x["lstrip"] or x["rstrip"]]:
        raise ValueError(f"added tokens that take in what stands beside them: {odd}")
    return {x["content"]: x["id"] for x in found}


class Encoder:
    """Texts to ids as 16-bit integers (a vocabulary of up to 65,536).

    added: tokens beyond the ranks. A text is cut at them, the longest first, before anything else; each is its id.
    """

    def __init__(self, vocabulary: str, added: dict[str, int] | None = None, part: int = PART):
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.part = part
        self.added = {a: np.array([i], "<u2").tobytes() for a, i in (added or {}).items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> bytes:
        if not any(a in text for a in self.added):
            return self._plain(text)
        return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(self.cuts.split(text)))  # tokens at odd places

    def _plain(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > self.part and (m := CUT.search(text, at + self.part)):
            out.append(self._ids(text[at : m.start()]))
            at = m.start()
        return b"".join(out) + self._ids(text[at:])

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()


@functools.lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary, added_tokens(vocabulary))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenise(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, doc_tokens, part, first_own and own (whole windows: their place among those of
    this partition, and their checksums), left (length of the last piece), nth (its rank among those in this partition)
    and piece (its ids, 16-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = encoder(vocabulary), TaskContext.get().partitionId()
        met = [0] * window
        whole = 0
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text, 2 << 20):
                cols: list[list] = [[] for _ in range(6)]
                for raw in map(t.encode, text[at:to].to_pylist()):
                    ids = np.frombuffer(raw + b"\0\0", "<u2")
                    n, k = len(ids), len(ids) // window
                    left = n - k * window
                    for c, v in zip(cols, (n, whole, [crc(ids[i * window : (i + 1) * window]) for i in range(k)], left, met[left], ids[k * window :].tobytes())):
                        c.append(v)
                    whole += k
                    met[left] += 1
                n = len(cols[0])
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary())
                made = [pa.array(c, k) for c, k in zip(cols, kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), pa.array([part] * n, pa.int32()), *made], ["doc_id", "part", "doc_tokens", "first_own", "own", "left", "nth", "piece"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, doc_tokens long, first_own long, own array<long>, left int, nth long, piece binary")


def combinations(window: int) -> np.ndarray:
    """All pairs and triples of lengths, ascending, whose sum is the window; a pair has 0 in front."""
    a = np.arange(1, window)
    pairs = np.stack([np.zeros_like(a), a, window - a], 1)
    x, y = (v.ravel() for v in np.meshgrid(a, a, indexing="ij"))
    triples = np.stack([x, y, window - x - y], 1)
    both = np.concatenate([pairs, triples])
    return both[(both[:, 0] <= both[:, 1]) & (both[:, 1] <= both[:, 2])]


def solve(combos: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the combinations closest to counts, in squares."""
    real = (combos > 0).astype(float)
    use = lambda x: np.bincount(combos.ravel(), (x[:, None] * real).ravel(), len(counts))
    back = lambda r: (r[combos] * real).sum(1)
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    target = counts.astype(float)
    target[0] = 0
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(use(y) - target), 0)
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


class Plan:
    """Where the g-th piece of each length goes; made from the histogram alone."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window = window
        combos = combinations(window)
        combos = combos[(counts[combos] > 0)[:, 1:].all(1) & ((combos[:, 0] == 0) | (counts[combos[:, 0]] > 0))]
        rest = counts.astype(np.int64).copy()
        rest[0] = 0
        taken: dict[int, int] = {}
        if len(combos):
            x = solve(combos, counts)
            order = np.argsort(-x, kind="stable")
            for wanted in (np.floor(x), np.ceil(x), np.full(len(x), np.inf)):  # rounded, then greedily
                for i in order.tolist():
                    want = wanted[i]
                    if want < 1:
                        continue
                    members = [m for m in combos[i].tolist() if m]
                    can = min(rest[m] // members.count(m) for m in members)
                    can = int(min(can, want - taken.get(i, 0)) if want < np.inf else can)
                    if can > 0:
                        for m in members:
                            rest[m] -= can
                        taken[i] = taken.get(i, 0) + can
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
        self.planned = 0
        for i, n in taken.items():
            at = 0
            for m in combos[i].tolist():
                if m:
                    slots[m].append((n, self.planned, at))
                    at += m
            self.planned += n
        self.ranks = [np.cumsum([0] + [s[0] for s in own]) for own in slots]
        self.base = [np.array([s[1] for s in own], np.int64) for own in slots]
        self.at = [np.array([s[2] for s in own], np.int64) for own in slots]
        self.stream = np.concatenate([[0], np.cumsum(rest * np.arange(window))])[:-1]
        self.cut_tokens = int((rest * np.arange(window)).sum())

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its sequence, offset there, and how many of its tokens go there; the rest begins the next one."""
        sequence, offset, n = np.zeros((3, len(length)), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            size, own = int(length[at[0]]), rank[at]
            ranks = self.ranks[size]
            e = np.minimum(np.searchsorted(ranks, own, "right"), len(ranks)) - 1
            taken = own < ranks[-1]
            place = self.stream[size] + (own - ranks[-1]) * size
            sequence[at], offset[at] = self.planned + place // self.window, place % self.window
            if taken.any():
                hit = at[taken]
                sequence[hit] = self.base[size][e[taken]] + own[taken] - ranks[e[taken]]
                offset[hit] = self.at[size][e[taken]]
            n[at] = np.minimum(size, self.window - offset[at])
        return sequence, offset, n


def _rows(p: Plan, b: pa.RecordBatch, window: int) -> list[np.ndarray]:
    """The columns of SCHEMA but the first for a batch of pieces, and before them the row of the batch that each is of."""
    part, total, first, left, nth, ahead = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "doc_tokens", "first_own", "left", "nth", "before"))
    own = b.column("own")
    many = np.diff(own.offsets.to_numpy()).astype(np.int64)
    of = np.repeat(np.arange(len(b)), many)
    i = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    whole = [of, i * window, np.full(len(of), window), own.flatten().to_numpy(), total[of], OWN + (part[of] << 36) + first[of] + i, np.zeros(len(of), np.int64)]

    rest = np.flatnonzero(left > 0)
    sequence, offset, n = p.places(left[rest], nth[rest] + ahead[rest])
    start = total[rest] - left[rest]
    cut = np.flatnonzero(n < left[rest])
    pieces = b.column("piece")
    data = np.frombuffer(pieces.buffers()[2], "<u2") if pieces.buffers()[2] else np.empty(0, "<u2")
    at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(b)][rest].astype(np.int64) // 2
    ids = memoryview(data.astype("<u4").tobytes())
    sums = lambda a, k: np.array([zlib.crc32(ids[4 * x : 4 * (x + y)]) for x, y in zip(a.tolist(), k.tolist())], np.int64)
    head = [rest, start, n, sums(at, n), total[rest], sequence, offset]
    more = left[rest][cut] - n[cut]
    tail = [rest[cut], start[cut] + n[cut], more, sums(at[cut] + n[cut], more), total[rest][cut], sequence[cut] + 1, np.zeros(len(cut), np.int64)]
    return [np.concatenate(c) for c in zip(whole, head, tail)]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece; see SCHEMA."""
    tokens = materialise(tokenise(docs, vocabulary, window), "pieces")
    grid = tokens.where("left > 0").groupBy("part", "left").agg(F.count("*").alias("n"))
    counts = np.zeros(window, np.int64)
    for r in grid.groupBy("left").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        counts[r["left"]] = r["n"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, window))  # by the window, not by the input
    before = grid.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("left").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = tokens.join(before, ["part", "left"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, *cols = _rows(plan.value, b, window)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), *(pa.array(c, pa.int64()) for c in cols)], SCHEMA.replace(" long", "").split(", "))

    return placed.select("doc_id", "part", "doc_tokens", "first_own", "own", "left", "nth", "piece", "before").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
