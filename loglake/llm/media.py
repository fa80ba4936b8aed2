"""Media columns: bytes stored as progressive JPEG, read back, and their full-resolution RGB tensors.

A payload is stored losslessly in the format's own unit, the quantised DCT coefficient: byte b is the coefficient
b - 32 (wrapped to -128..127, so that spaces are zeros), block after block over luma and the two chroma components, which
are at half resolution. The quantiser is 1. A payload of more than TILE bytes becomes several images end to end in one
media value. Images are encoded and decoded in groups of GROUP_BYTES, so what either needs beside the payload and its media
value does not grow with them. The length stands in a comment.

decode_column() is the general reader: any progressive file with 8-bit samples in one component or three becomes RGB
tensors, one for each image in it.

Defined cases: a null or empty text is the payload of 192 spaces; whole texts are stored, however long; equal texts, on
repeated rows, too, have equal media; a null or empty media value decodes to null; one that is not such a JPEG, or is
damaged in its markers, raises ValueError; a null doc_id stays null; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loglake.llm import progressive
from loglake.llm.common import slices, table, texts

UNIT = 192
MCU_BYTES = 384
ROW = 64  # units in a row of an image
TILE = 2048 * MCU_BYTES
SLICE_BYTES = GROUP_BYTES = 3 << 19
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _grouped(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[tuple[int, ...], tuple[bytes, ...]]]:
    """(owner, part) rows in groups of at most GROUP_BYTES, or of one part that is longer."""
    held, n = [], 0
    for i, p in parts:
        if held and n + len(p) > GROUP_BYTES:
            yield tuple(zip(*held))
            held, n = [], 0
        held.append((i, p))
        n += len(p)
    if held:
        yield tuple(zip(*held))


def write(payloads: list[bytes]) -> list[bytes]:
    """Each payload's media value."""
    out: list[list[bytes]] = [[] for _ in payloads]
    for of, tiles in _grouped((i, p[at : at + TILE]) for i, p in enumerate(payloads) for at in range(0, len(p), TILE)):
        shapes, rows = [], []
        for t in tiles:
            part = np.frombuffer(t, np.uint8)
            units = -(-len(part) // MCU_BYTES)
            shapes.append(progressive.Shape(min(units, ROW), -(-units // ROW)))
            c = np.zeros(shapes[-1].starts[-1] * 64, np.int8)
            c[: len(part)] = (part - np.uint8(32)).view(np.int8)
            rows.append(c)
        notes = [str(len(t)).encode() for t in tiles]
        for i, f in zip(of, progressive.encode(np.concatenate(rows).reshape(-1, 64), shapes, notes)):
            out[i].append(f)
    return [b"".join(x) for x in out]


def read(media: list[bytes]) -> list[tuple[bytes, str]]:
    """Each media value's payload, and features of its RGB tensors: size, means, deviations and mean step of channels."""
    payload: list[list[bytes]] = [[] for _ in media]
    sums = [[0] * 10 for _ in media]
    for of, files in _grouped((i, m[a:b]) for i, m in enumerate(media) for a, b in progressive.images(m)):
        heads, found, _ = progressive.decode(list(files))
        for h, c, i in zip(heads, found, of):
            payload[i].append((c.astype(np.uint8) + np.uint8(32)).tobytes()[: int(h.note)])
            x = progressive.rgb(h, c)
            flat = x.reshape(-1, 3)
            wide = flat.astype(np.int32)
            step = np.abs(np.diff(x[..., 1].astype(np.int16), axis=1))
            new = [len(flat), *wide.sum(0, dtype=np.int64).tolist(), *np.einsum("ij,ij->j", wide, wide, dtype=np.int64).tolist(), int(step.sum()), h.width, h.height]
            sums[i] = [a + b for a, b in zip(sums[i], new)]
    out = []
    for parts, (n, r, g, b, r2, g2, b2, step, w, h) in zip(payload, sums):
        dev = [max(q / n - (s / n) ** 2, 0) ** 0.5 for s, q in ((r, r2), (g, g2), (b, b2))]
        out.append((b"".join(parts), f"{w}x{h};mean={r / n:.3f},{g / n:.3f},{b / n:.3f};dev={dev[0]:.3f},{dev[1]:.3f},{dev[2]:.3f};step={step / n:.3f}"))
    return out


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each document's text as a media value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text, SLICE_BYTES):
                made = write([padded(x.encode()) for x in text[at:to].to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), pa.array(made, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def decode_column(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, channels, tensor) for every image of (doc_id, media): 8-bit samples, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "height", "width", "channels", "tensor"], (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            if none := [(ids[i], None, None, None, None) for i, v in enumerate(values) if not v]:
                yield made(none)
            for of, files in _grouped((i, v[x:y]) for i, v in enumerate(values) if v for x, y in progressive.images(v)):
                heads, found, _ = progressive.decode(list(files))
                yield made([(ids[i], *(x := progressive.rgb(h, c)).shape, x.tobytes()) for h, c, i in zip(heads, found, of)])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, channels int, tensor binary")


def digests(docs: DataFrame) -> DataFrame:
    """Stores every document's text, reads it back and describes what was stored and read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text, SLICE_BYTES):
                plain = [x.encode() for x in text[at:to].to_pylist()]
                media = write([padded(x) for x in plain])
                rows = [
                    (len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature)
                    for x, m, (back, feature) in zip(plain, media, read(media))
                ]
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), *(pa.array(list(c)) for c in zip(*rows))], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
