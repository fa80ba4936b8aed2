"""SentencePiece encoding and decoding through a table of distinct marked words.

The model marks each space and prefixes a text with one mark. Where no piece has a mark after another character, no
merge crosses from a word into the next mark, nor into a line feed, which no piece holds: a text's pieces are those of
its marked words (a run of marks and what follows up to the next mark), one after another. Each Python worker keeps a table of the distinct marked words it has
met (bounded; cleared when full), segments each of them once, and joins ids and decoded text back by position.

Defined cases: a null text is an empty one; an empty text has only the begin and end ids and decodes to the empty
text; the character U+2581 in a text is a mark like a space, as in the library. A model whose pieces cross marks is
encoded text by text instead. Whole texts are taken, however long. Rows are independent: ties, repeated rows and other
columns do not matter; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglake.llm.common import slices, table, texts

MARK = "▁"
MARKED = re.compile(f"[ {MARK}]+[^ {MARK}]*")
FEED = re.compile("(?=\n)")
TABLE_ENTRIES = 400_000
SLICE_BYTES = 2 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class WordTable:
    """Marked word (without its first mark) -> its ids as little-endian 32-bit integers. Each is decoded once, too; `odd`
    keeps those that do not decode to themselves, whose texts are then decoded whole."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and self._plain()
        self.entries, self.ids, self.odd = entries, {}, {}
        self.mark = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))

    def _plain(self) -> bool:
        """Whether texts are marked as described: a mark in front, spaces kept, nothing else rewritten."""
        sp = self.sp
        probe = " a  bﬁ　c "
        return sp.decode(sp.encode(probe)) == probe and sp.encode("a", out_type=str)[0].startswith(MARK)

    def _learn(self, words: set[str]) -> None:
        """A key is a marked word without its first mark, or a line feed and what follows it unmarked."""
        new = list(words)
        ids = self.sp.encode(new, num_threads=1)
        to = np.cumsum([0, *map(len, ids)]) * 4
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4", to[-1] // 4).tobytes()
        for w, a, b in zip(new, to.tolist(), to[1:].tolist()):
            lone = w[:1] == "\n"
            self.ids[w] = flat[a + 4 * lone : b] if w else self.mark
        for w, back in zip(new, self.sp.decode(ids)):
            if back != w:
                self.odd[w] = back

    def words(self, text: str) -> list[str]:
        if MARK in text or "  " in text or text[0] == " ":
            found = (w[1:].replace(MARK, " ") for w in MARKED.findall(" " + text))
            return [k for w in found for k in (FEED.split(w) if "\n" in w else [w])]
        return text.replace("\n", " \n").split(" ")

    def encode_all(self, many: list[str]) -> list[tuple[bytes, str | None]]:
        """For each text its ids without begin and end, and the text they decode to (None: to be decoded whole). The distinct
        words that the table lacks are segmented in one call. `many` should hold a few MB at most."""
        if not self.splits:
            return [(np.array(self.sp.encode(x), "<u4").tobytes() if x else b"", None) for x in many]
        split = [self.words(x) if x else [] for x in many]
        need = set().union(*split)
        missing = need - self.ids.keys()
        if len(self.ids) + len(missing) > self.entries:
            self.ids.clear()
            self.odd.clear()
            missing = need
        if missing:
            self._learn(missing)
        ids, odd = self.ids.__getitem__, self.odd
        if not odd:  # each word decodes to itself, so a text does, with marks as spaces
            return [(b"".join(map(ids, w)), x.replace(MARK, " ")) for x, w in zip(many, split)]
        return [(b"".join(map(ids, w)), None if any(k in odd for k in w) else x.replace(MARK, " ")) for x, w in zip(many, split)]

    def encode(self, text: str) -> tuple[bytes, str | None]:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


@functools.lru_cache(2)
def word_table(model: str) -> WordTable:
    return WordTable(model)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) with begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_table(model)
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text, SLICE_BYTES):
                ids = [np.frombuffer(t.begin + x + t.end, "<u4").astype("i4") for x, _ in t.encode_all(text[at:to].to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of what encode() returned; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = word_table(model).sp
        for b in batches:
            text = [None if x is None else sp.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Counts and digests of each document's ids and of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_table(model)
        for b in batches:
            rows: tuple[list, list, list] = ([], [], [])
            text = texts(b.column(1))
            for at, to in slices(text, SLICE_BYTES):
                for ids, back in t.encode_all(text[at:to].to_pylist()):
                    ids = t.begin + ids + t.end
                    if back is None:
                        back = t.decode(ids)
                    for out, v in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
