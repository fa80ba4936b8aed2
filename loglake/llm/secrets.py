"""Secret scans: fixed patterns, and values in credential contexts that would cost too much to guess.

Three fixed kinds of span are found (assign, access, hex). The fourth, guess, is by password guess cost: a value that
follows a credential word is cut into words, dates, repeats, keyboard walks and brute-force spans so that the total
guesses are least (dynamic programming over positions); if even that takes GUESSES or more, the value is a secret.

Defined cases: a null or empty text has no spans, and its digest is that of the empty text; positions are code points,
end exclusive; spans are ordered by start, then by kind as listed; equal and overlapping spans of different kinds all
stay. Texts of any length are scanned whole, in time linear in their length. Rows are independent.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import slices, table, texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORD = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|client)[ _-]?key|bearer|login)"
CONTEXT = re.compile(
    rf"""(?:{WORD}["']?[ \t]*(?::|=>?|(?<=[ \t])is[ \t])[ \t]*|(?:bearer|basic)[ \t]+)["']?([^\s"'<>,;]{{6,}})""",
    re.I | re.A,
)
NAME = re.compile(rf"{WORD}[:=]*", re.I | re.A)
HINTS = ("pass", "pwd", "secret", "token", "credential", "auth", "key", "bearer", "basic", "login")
GUESSES = 1e10
HEXED = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
SPANS = "array<struct<kind:string,start:int,end:int>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# Rows of a common keyboard, and values that head every list of leaked passwords.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
COMMON = ("password", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "secret", "changeme", "default", "guest", "root", "test", "user", "example", "none", "null", "true", "false")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
LONGEST_WORD = 16


@functools.lru_cache(2)
def word_ranks(model: str | None) -> dict[str, int]:
    """Lower-case words of letters with a rank each: COMMON, then whole-word pieces of a public vocabulary in its order."""
    words = dict.fromkeys(COMMON)
    if model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if p[0] == "▁" and 3 <= len(w := p[1:].lower()) <= LONGEST_WORD and w.isalpha():
                words.setdefault(w)
    return {w: i + 1 for i, w in enumerate(words)}


def _beside() -> frozenset[str]:
    """Pairs of keys of which the second lies beside the first, along a row."""
    return frozenset(x for row in KEYBOARD for a, b in zip(row, row[1:]) for x in (a + b, b + a))


BESIDE = _beside()


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    best = [0.0] + [math.inf] * n
    cut = math.log10(2)  # each further segment doubles the arrangements to try
    run = walk = 0
    run_from, walk_from = [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        if i and low[i] != low[i - 1]:
            run = i
        if i and low[i - 1 : i + 1] not in BESIDE:
            walk = i
        run_from[i + 1], walk_from[i + 1] = run, walk
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := DATE.match(low, i)):
            dates.setdefault(m.end(), []).append(i)
    for j in range(1, n + 1):
        found = best[j - 1] + math.log10(_alphabet(value[j - 1]))
        for k in range(max(0, j - LONGEST_WORD), j - 2):
            if rank := ranks.get(low[k:j]):
                cased = 0 if value[k:j] == low[k:j] else math.log10(2) if value[k:j] in (low[k:j].capitalize(), low[k:j].upper()) else (j - k) * math.log10(2)
                found = min(found, best[k] + math.log10(rank + 1) + cased + cut)
        if j - (k := run_from[j]) >= 3:
            found = min(found, best[k] + math.log10(_alphabet(value[k]) * (j - k)) + cut)
        if j - (k := walk_from[j]) >= 3:
            found = min(found, best[k] + math.log10(len(BESIDE) * (j - k)) + cut)
        for k in dates.get(j, ()):
            found = min(found, best[k] + math.log10(365 * 120) + cut)
        best[j] = found
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed kinds."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode().translate(HEXED):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def guessed(text: str, ranks: dict[str, int], least: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in credential contexts that cost 10**least guesses or more. A value that is a context word
    itself (`login: passphrase: x`), or is cheap (`Authorization: Bearer x`), may be the context of the next: the search
    goes on at its start. A cheap value holds few context words, as each costs guesses, so it is searched few times."""
    m = CONTEXT.search(text)
    while m:
        strong = not NAME.fullmatch(m[1]) and guess_cost(m[1], ranks) >= least
        if strong:
            yield m.span(1)
        m = CONTEXT.search(text, m.end() if strong else m.start(1))


def spans(text: str, ranks: dict[str, int], guesses: float = GUESSES) -> list[tuple[int, int, int]]:
    """base_spans() and those of kind guess, in order."""
    out, low, least = base_spans(text), text.lower(), math.log10(guesses)
    if any(h in low for h in HINTS):
        out += [(a, 3, b) for a, b in guessed(text, ranks, least)]
    return sorted(out)


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scan(docs: DataFrame, words: str | None, guesses: float = GUESSES) -> DataFrame:
    """(doc_id, found): all spans of each document. words: a sentencepiece model whose pieces are the known words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(words)
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text):
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(x, ranks, guesses)] for x in text[at:to].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], pa.array(found, SPANS_ARROW)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {SPANS}")


def redact(docs: DataFrame, words: str | None, guesses: float = GUESSES, mark: str = "[SECRET]") -> DataFrame:
    """docs with its own columns, every span of its text replaced by mark (overlapping spans by one); n_chars, where
    there, follows the text. A null text stays null."""
    schema = docs.schema
    where = schema.fieldNames().index("text")

    def clean(text: str | None, ranks: dict[str, int]) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, _, e in spans(text, ranks, guesses):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = word_ranks(words)
        for b in batches:
            parts = [pa.array([clean(x, ranks) for x in b.column(where)[at:to].to_pylist()], b.column(where).type) for at, to in slices(texts(b.column(where)))]
            if parts:
                yield b.set_column(where, b.schema.field(where), pa.concat_arrays(parts))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in schema.fieldNames():
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = scan(table(spark, sf_dir, "documents"), default_words())
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(told(F.filter("found", lambda x: x["kind"] != "guess")).cast("binary"), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
        count("guess").alias("n_guess"),
    )
