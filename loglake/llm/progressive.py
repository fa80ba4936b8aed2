"""Progressive JPEG in numpy, many images at once: encoding and decoding of coefficients, and RGB tensors.

Entropy-coded segments are cut at restart markers into streams that stand alone. The decoder advances all streams of a
scan together, one symbol a step, over the streams of every image that has the same scans; scans add to the coefficient
arrays in the file's order (spectral selection and successive approximation). The encoder writes SCRIPT.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: the zigzag order by diagonals is computed; markers and the scan script are as follows.
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
OTHER_FRAMES = (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCC, 0xCD, 0xCE, 0xCF)
#: Scans as written: components, first and last coefficient, high and low bit.
SCRIPT = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 6, 63, 0, 0), ((0,), 1, 5, 1, 0), ((0, 1, 2), 0, 0, 1, 0))
SAMPLING = ((2, 2), (1, 1), (1, 1))  # luma at full resolution, chroma at half either way
INTERVAL = 4  # units between restart markers
U = np.uint64


@functools.cache
def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@functools.cache
def inverse_dct() -> np.ndarray:
    """Zigzag coefficients (a row) times this: the 64 samples of a block."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return full[zigzag()].astype(np.float32)


def _lengths_ac() -> dict[int, int]:
    """Code length of each (run, size): short for what bytes of text make, ten bits for the rest."""
    out = {run << 4 | size: 10 for run in range(16) for size in range(11)}
    return out | {0x07: 1, 0x17: 3, 0x06: 4, 0x16: 5, 0x04: 5, 0x00: 6, 0x05: 6, 0x14: 7}


def _table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length of each symbol, and the table as it stands in a file."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    at, was = 0, 0
    for s in order:
        at <<= lengths[s] - was
        was = lengths[s]
        code[s], size[s] = at, was
        at += 1
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return code, size, counts + bytes(order)


@functools.cache
def tables() -> tuple:
    """The encoder's tables for DC and AC."""
    return _table({s: 4 for s in range(12)}), _table(_lengths_ac())


@functools.lru_cache(64)
def _lookup(counts_and_symbols: bytes) -> np.ndarray:
    """16 bits that lie ahead -> length << 8 | symbol."""
    out = np.zeros(1 << 16, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(counts_and_symbols[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | counts_and_symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.cache
def _bit_lengths() -> np.ndarray:
    return np.array([i.bit_length() for i in range(1 << 12)], np.int64)


def bit_length(v: np.ndarray) -> np.ndarray:
    """For 0 <= v < 4096, more than any coefficient of eight-bit samples has."""
    return _bit_lengths()[v]


def _merged(keys: np.ndarray, columns: tuple, other: np.ndarray, others: tuple) -> tuple:
    """The columns of two tables, either in the order of its keys, as one in that order; equal keys: others last."""
    at = np.searchsorted(keys, other, "right")
    return tuple(np.insert(a, at, b) for a, b in zip(columns, others))


# ---- geometry ----


@dataclass(frozen=True)
class Shape:
    """Size in units (one per interleaved MCU) and sampling factors. Blocks are numbered component by component."""

    wide: int
    high: int
    sampling: tuple = SAMPLING

    @functools.cached_property
    def blocks(self) -> list[tuple[int, int]]:
        return [(self.high * v, self.wide * h) for h, v in self.sampling]

    @functools.cached_property
    def starts(self) -> list[int]:
        return [0, *itertools.accumulate(a * b for a, b in self.blocks)]


@functools.lru_cache(256)
def interleaved(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in the order of an interleaved scan, a row for each unit, and the component of each column."""
    cols, of = [], []
    y, x = np.arange(shape.high)[:, None], np.arange(shape.wide)[None, :]
    for c, ((h, v), (_, width), start) in enumerate(zip(shape.sampling, shape.blocks, shape.starts)):
        for j in range(v):
            for i in range(h):
                cols.append((start + (y * v + j) * width + x * h + i).ravel())
                of.append(c)
    return np.stack(cols, 1), np.array(of)


# ---- encoding ----


def _pack(value: np.ndarray, bits: np.ndarray, stream: np.ndarray, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """Items (in order, their streams ascending) as bytes, each stream filled up with ones to a whole byte; and each
    stream's first byte, then the total."""
    ends = np.bincount(stream, bits, streams).astype(np.int64)
    size = (ends + 7) >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    fill = np.flatnonzero(ends & 7)
    lack = 8 - (ends[fill] & 7)
    at = np.cumsum(bits) - bits
    begun = np.concatenate([[0], np.cumsum(ends)])[:-1]
    at += (8 * first[:-1] - begun)[stream]
    extra = (8 * first[fill] + ends[fill], (U(1) << lack.astype(np.uint64)) - U(1), lack)
    at, value, bits = _merged(at, (at, value, bits), extra[0], extra)
    words = np.zeros(int(first[-1] + 11) // 4 + 2, np.uint64)
    if len(at):
        wide = value << (64 - bits - (at & 31)).astype(np.uint64)
        word = at >> 5
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[new]] |= np.bitwise_or.reduceat(wide >> U(32), new)
        words[word[new] + 1] |= np.bitwise_or.reduceat(wide & U(0xFFFFFFFF), new)
    return words.astype(">u4").view(np.uint8)[: first[-1]], first


def _framed(data: np.ndarray, first: np.ndarray, image: np.ndarray, images: int) -> list[bytes]:
    """Each image's streams as one entropy-coded segment: zeros after 0xFF, restart markers between streams."""
    stuffed = np.flatnonzero(data == 0xFF) + 1
    nth = np.arange(len(image)) - np.searchsorted(image, image)
    later = np.flatnonzero(nth > 0)
    marks = np.stack([np.full(len(later), 0xFF), 0xD0 + (nth[later] - 1) % 8], 1).ravel()
    where = np.concatenate([stuffed, np.repeat(first[later], 2)])
    what = np.concatenate([np.zeros(len(stuffed), np.int64), marks]).astype(np.uint8)
    order = np.argsort(where, kind="stable")
    out = np.insert(data, where[order], what[order])
    begins = first[np.searchsorted(image, np.arange(images + 1))]
    # what stands before byte b: stuffing up to b, and marks up to and with those at b, which end the image before
    grown = begins + np.searchsorted(stuffed, begins, "right") + 2 * np.searchsorted(first[later], begins, "left")
    return [out[a:b].tobytes() for a, b in zip(grown[:-1], grown[1:])]


def _ac_first(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, bits and block of the items of blocks c (a row each, the scan's coefficients)."""
    code, size, _ = tables()[1]
    q = np.sign(c) * (np.abs(c) >> low)
    block, k = np.nonzero(q)
    v = q[block, k]
    run = k.copy()
    same = np.zeros(len(k), bool)
    same[1:] = block[1:] == block[:-1]
    run[same] = (k[1:] - k[:-1] - 1)[same[1:]]
    skips = run >> 4
    s = bit_length(np.abs(v))
    symbol = (run & 15) << 4 | s
    extra = np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)
    value, bits = code[symbol] << s.astype(np.uint64) | extra, size[symbol] + s
    last = np.full(len(c), -1)
    last[block] = k
    short = np.flatnonzero(last < c.shape[1] - 1)
    wide = 2 * (c.shape[1] + 1)
    key = block * wide + 2 * k + 1
    more, other = (code[:1].repeat(len(short)), size[:1].repeat(len(short)), short), short * wide + wide - 1
    if skips.any():  # runs of 16 zeros go before the coefficient, ends after all of a block
        many = np.repeat(np.flatnonzero(skips), skips[skips > 0])
        runs = (code[0xF0:0xF1].repeat(len(many)), size[0xF0:0xF1].repeat(len(many)), block[many])
        both = key[many] - 1
        more = _merged(other, more, both, runs)
        other = np.sort(np.concatenate([other, both]), kind="stable")
    return _merged(key, (value, bits, block), other, more)


def _ac_refine(c: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _ac_first, for one more bit; for bands of up to 15 coefficients, so that no run passes 15."""
    code, size, _ = tables()[1]
    n, wide = c.shape
    assert wide <= 15
    mag = np.abs(c) >> low
    known, fresh = (np.abs(c) >> high) > 0, mag == 1
    fresh &= ~known
    zeros = (mag == 0).astype(np.int64)
    passed = np.cumsum(zeros, 1)
    block, k = np.nonzero(fresh)
    same = np.zeros(len(k), bool)
    same[1:] = block[1:] == block[:-1]
    before = np.zeros(len(k), np.int64)
    before[1:] = passed[block[:-1], k[:-1]]
    run = passed[block, k] - np.where(same, before, 0)
    symbol = run << 4 | 1
    value, bits = code[symbol] << U(1) | (c[block, k] > 0).astype(np.uint64), size[symbol] + 1
    end = np.full(n, -1)
    end[block] = k
    short = np.flatnonzero(end < wide - 1)
    owner = np.where(fresh, np.arange(wide), wide)
    owner = np.minimum.accumulate(owner[:, ::-1], 1)[:, ::-1]
    kb, kk = np.nonzero(known)
    step = wide + 2
    key = np.concatenate([(block * step + k) * step, (short * step + wide) * step, (kb * step + owner[kb, kk]) * step + 1 + kk])
    value = np.concatenate([value, np.full(len(short), code[0]), (mag[kb, kk] & 1).astype(np.uint64)])
    bits = np.concatenate([bits, np.full(len(short), size[0]), np.ones(len(kb), np.int64)])
    block = np.concatenate([block, short, kb])
    order = np.argsort(key, kind="stable")
    return value[order], bits[order], block[order]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(coefficients: np.ndarray, shapes: list[Shape], notes: list[bytes]) -> list[bytes]:
    """One file for each shape. coefficients: all images' blocks, a row of 64 in zigzag order each (whole numbers that a
    quantiser of 1 leaves as they are). notes: a comment for each."""
    c = coefficients.astype(np.int32)
    begin = np.concatenate([[0], np.cumsum([s.starts[-1] for s in shapes])])
    parts: list[list[bytes]] = [[] for _ in shapes]
    for comps, first, last, high, low in SCRIPT:
        blocks, image, stream, nth = [], [], [], 0
        for i, s in enumerate(shapes):
            b = interleaved(s)[0] if first == 0 else np.arange(s.starts[comps[0]], s.starts[comps[0] + 1])[:, None]
            units = np.arange(len(b)) // INTERVAL
            blocks.append((b + begin[i]).ravel())
            stream.append(np.repeat(nth + units, b.shape[1]))
            image.append(np.full(units[-1] + 1, i))
            nth += units[-1] + 1
        at, stream, image = (np.concatenate(x) for x in (blocks, stream, image))
        if first == 0:
            dc = c[at, 0] >> low
            if high:
                value, bits, of = (dc & 1).astype(np.uint64), np.ones(len(dc), np.int64), np.arange(len(dc))
            else:
                comp = np.concatenate([np.tile(interleaved(s)[1], s.wide * s.high) for s in shapes])
                group = np.lexsort((np.arange(len(dc)), comp, stream))
                diff = dc[group]
                chained = (stream[group][1:] == stream[group][:-1]) & (comp[group][1:] == comp[group][:-1])
                diff[1:] -= np.where(chained, dc[group][:-1], 0)
                v = np.empty_like(diff)
                v[group] = diff
                code, size, _ = tables()[0]
                s = bit_length(np.abs(v))
                extra = np.where(v < 0, v + (1 << s) - 1, v).astype(np.uint64)
                value, bits, of = code[s] << s.astype(np.uint64) | extra, size[s] + s, np.arange(len(dc))
        else:
            band = c[at, first : last + 1]
            value, bits, of = _ac_refine(band, high, low) if high else _ac_first(band, low)
        data, starts = _pack(value, bits, stream[of], len(image))
        head = bytes([len(comps), *(x for k in comps for x in (k + 1, 0x00)), first, last, high << 4 | low])
        for p, d in zip(parts, _framed(data, starts, image, len(shapes))):
            p += [_segment(SOS, head), d]
    common = _segment(DQT, b"\0" + b"\1" * 64)
    huffman = _segment(DHT, b"\x00" + tables()[0][2]) + _segment(DHT, b"\x10" + tables()[1][2])
    out = []
    for s, note, p in zip(shapes, notes, parts):
        hmax, vmax = max(h for h, _ in s.sampling), max(v for _, v in s.sampling)
        size = (s.high * vmax * 8).to_bytes(2, "big") + (s.wide * hmax * 8).to_bytes(2, "big")
        frame = b"\x08" + size + bytes([len(s.sampling), *(x for k, (h, v) in enumerate(s.sampling) for x in (k + 1, h << 4 | v, 0))])
        out.append(b"".join([b"\xff\xd8", _segment(COM, note), common, _segment(SOF2, frame), huffman, _segment(DRI, INTERVAL.to_bytes(2, "big")), *p, b"\xff\xd9"]))
    return out


# ---- decoding ----


@dataclass
class Scan:
    comps: tuple
    first: int
    last: int
    high: int
    low: int
    tables: tuple  # of DC, and of AC, as they stand in the file, for each component
    interval: int
    begin: int
    end: int


@dataclass
class Parsed:
    shape: Shape | None = None
    height: int = 0
    width: int = 0
    quantisers: list = field(default_factory=list)
    scans: list = field(default_factory=list)
    note: bytes = b""
    end: int = 0

    @property
    def kind(self) -> tuple:
        return (self.shape.sampling, *((s.comps, s.first, s.last, s.high, s.low, s.tables) for s in self.scans))


#: A marker that ends an entropy-coded segment: no stuffing, no restart.
ENDING = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]", re.S)


def images(data: bytes) -> Iterator[tuple[int, int]]:
    """Begin and end of each image of a file that holds one or more, end to end: markers alone are looked at."""
    at = 0
    while at < len(data):
        begin, at = at, at + 2
        if data[begin:at] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            while data[at : at + 2] == b"\xff\xff":  # fill bytes
                at += 1
            marker, size = data[at : at + 2], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == b"\xff\xd9":
                at += 2
                break
            if len(marker) < 2 or marker[0] != 0xFF or size < 2:
                raise ValueError("a JPEG file that ends early or is damaged")
            at += 2 + size
            if marker[1] == SOS:
                found = ENDING.search(data, at)
                if found is None:
                    raise ValueError("a JPEG file that ends early or is damaged")
                at = found.start()
        yield begin, at


def parse(data: bytes, at: int) -> Parsed:
    """The head and scans of the image that begins at `at`: progressive, of eight-bit samples in one component or three."""
    try:
        return _parse(data, at)
    except (IndexError, KeyError) as e:
        raise ValueError("a JPEG file that ends early or is damaged") from e


def _parse(data: bytes, at: int) -> Parsed:
    out, dc, ac, q, interval, frame = Parsed(), {}, {}, {}, 0, []
    at += 2
    while data[at + 1] != EOI:
        if data[at + 1] == 0xFF:
            at += 1
            continue
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == DQT:
            while body:
                wide = 1 + (body[0] >> 4)
                q[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == DHT:
            while body:
                size = 17 + sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = body[1:size]
                body = body[size:]
        elif marker == DRI:
            interval = int.from_bytes(body, "big")
        elif marker == COM:
            out.note = body
        elif marker in OTHER_FRAMES:
            raise ValueError("not a progressive JPEG file")
        elif marker == SOF2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError(f"samples of {body[0]} bits in {body[5]} components; known are 8 bits in 1 or 3")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not out.height or not out.width or not all(0 < v <= 4 for f in frame for v in f[1:3]):
                raise ValueError("a frame without a size or with odd sampling")
            hmax, vmax = max(f[1] for f in frame), max(f[2] for f in frame)
            if any(hmax % f[1] or vmax % f[2] for f in frame):
                raise ValueError("sampling that does not divide that of the finest component")
            out.shape = Shape(-(-out.width // (8 * hmax)), -(-out.height // (8 * vmax)), tuple((f[1], f[2]) for f in frame))
        elif marker == SOS:
            names = [f[0] for f in frame]
            if any(body[1 + 2 * i] not in names for i in range(body[0])):
                raise ValueError("a scan of a component that the frame does not have")
            comps = tuple(names.index(body[1 + 2 * i]) for i in range(body[0]))
            picks = [body[2 + 2 * i] for i in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            high, low = bits >> 4, bits & 15
            used = tuple((dc[p >> 4] if not high else None, None) if first == 0 else (None, ac[p & 15]) for p in picks)
            end = ENDING.search(data, at).start()
            out.scans.append(Scan(comps, first, last, high, low, used, interval, at, end))
            at = end
    if out.shape is None:
        raise ValueError("a JPEG file without a frame")
    out.quantisers, out.end = [q[f[3]] for f in frame], at + 2
    return out


def parse_all(files: list[bytes]) -> tuple[np.ndarray, list[Parsed], list[int]]:
    """All images' bytes, their heads, and the file of each: a file may hold several images, end to end."""
    data = b"".join(files)
    heads, of, base = [], [], 0
    for i, f in enumerate(files):
        for begin, _ in images(f):
            heads.append(parse(data, base + begin))
            of.append(i)
        base += len(f)
    return np.frombuffer(data, np.uint8), heads, of


class Streams:
    """The streams of one scan in many files: bytes without stuffing and markers, and a reading place in bits for each."""

    def __init__(self, data: np.ndarray, spans: list[tuple[int, int]]):
        size = np.array([b - a for a, b in spans])
        at = np.arange(size.sum()) + np.repeat(np.array([a for a, _ in spans]) - (np.cumsum(size) - size), size)
        raw = data[at]
        ends = np.cumsum(size)
        prev = np.zeros(len(raw), bool)
        prev[1:] = raw[:-1] == 0xFF
        prev[ends[:-1][ends[:-1] < len(raw)]] = False
        mark = np.flatnonzero(prev & (raw >= 0xD0) & (raw <= 0xD7))
        gone = prev & (raw == 0)
        gone[mark] = gone[mark - 1] = True
        kept = np.concatenate([[0], np.cumsum(~gone)])
        starts = np.sort(np.concatenate([ends - size, mark + 1]))
        self.image = np.searchsorted(ends, starts, "right")
        self.place = 8 * kept[starts]
        self.bytes = np.concatenate([raw[~gone], np.zeros(16, np.uint8)])
        self.view = np.ndarray((len(self.bytes) - 8,), ">u8", self.bytes, strides=(1,))

    def ahead(self, place: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place, at the top."""
        return self.view[np.minimum(place >> 3, len(self.view) - 1)].astype(np.uint64) << (place & 7).astype(np.uint64)


def _extend(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The next `size` bits of x as a signed number of that size."""
    s = size.astype(np.uint64)
    v = np.where(size > 0, x >> (U(64) - np.maximum(s, U(1))), U(0)).astype(np.int64)
    return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)


def _dc_scan(out: np.ndarray, s: Streams, units: np.ndarray, count: np.ndarray, comp: np.ndarray, scan: Scan) -> None:
    """units: first place in the scan's order of blocks for each stream (see _decode_kind); count: units of each."""
    order, per = units
    n = len(count)
    guess = np.zeros((n, int(comp.max()) + 1), np.int64)
    place = s.place.copy()
    for t in range(int(count.max()) * len(comp)):
        live = np.flatnonzero(t < count * len(comp))
        c = comp[t % len(comp)]
        block = order[per[live] + t]
        x = s.ahead(place[live])
        if scan.high:
            out[block, 0] |= ((x >> U(63)).astype(np.int64) << scan.low).astype(out.dtype)
            place[live] += 1
            continue
        found = _lookup(scan.tables[scan.comps.index(c)][0])[(x >> U(48)).astype(np.int64)]
        length, size = found >> 8, found & 255
        guess[live, c] += _extend(x << length.astype(np.uint64), size)
        out[block, 0] = guess[live, c] << scan.low
        place[live] += length + size


def _ac_scan(out: np.ndarray, s: Streams, begin: np.ndarray, count: np.ndarray, scan: Scan) -> None:
    """Spectral selection, first bits: begin and count are each stream's blocks."""
    table, last = _lookup(scan.tables[0][1]), scan.last
    place, block, end = s.place.copy(), begin.copy(), begin + count
    k = np.full(len(place), scan.first)
    steps = 0
    while len(place):
        x = s.ahead(place)
        found = table[(x >> U(48)).astype(np.int64)]
        length, run, size = found >> 8, found >> 4 & 15, found & 15
        x <<= length.astype(np.uint64)
        real = size > 0
        place += length + size
        k += run
        hit = np.flatnonzero(real & (k <= last))
        out[block[hit], k[hit]] = _extend(x[hit], size[hit]) << scan.low
        k += 1
        stop = np.flatnonzero(~real & (run < 15))
        if len(stop):
            r = run[stop]
            more = np.where(r > 0, x[stop] >> (U(64) - np.maximum(r, 1).astype(np.uint64)), U(0)).astype(np.int64)
            block[stop] += (1 << r) - 1 + more
            place[stop] += r
            k[stop] = last + 1
        over = k > last
        block += over
        k[over] = scan.first
        steps += 1
        if steps % 8 == 0 or len(place) < 64:
            live = block < end
            if not live.all():
                place, block, end, k = place[live], block[live], end[live], k[live]
        elif (done := block >= end).any():  # finished streams idle at the block after their last; they must not write
            stay = ~done
            place, block, end, k = place[stay], block[stay], end[stay], k[stay]


def _ac_refine_scan(out: np.ndarray, s: Streams, begin: np.ndarray, count: np.ndarray, scan: Scan) -> None:
    """One more bit: each step handles one coefficient of each stream. pending: zeros still to pass before the new
    coefficient `fresh` (its sign, or 0 for a run of zeros only), -1 with nothing pending, or a count of ended blocks."""
    table, last, bit = _lookup(scan.tables[0][1]), scan.last, 1 << scan.low
    place, block, end = s.place.copy(), begin.copy(), begin + count
    n = len(place)
    k, pending, fresh, ended = np.full(n, scan.first), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(place):
        ask = np.flatnonzero((pending < 0) & (ended == 0))
        if len(ask):
            x = s.ahead(place[ask])
            found = table[(x >> U(48)).astype(np.int64)]
            length, run, size = found >> 8, found >> 4 & 15, found & 15
            x <<= length.astype(np.uint64)
            stop = (size == 0) & (run < 15)
            more = np.where(run > 0, x >> (U(64) - np.maximum(run, 1).astype(np.uint64)), U(0)).astype(np.int64)
            ended[ask] = np.where(stop, (1 << run) + more, 0)
            fresh[ask] = np.where(size > 0, np.where(x >> U(63) > 0, bit, -bit), 0)
            pending[ask] = np.where(stop, -1, run)
            place[ask] += length + np.where(stop, run, size)
        now = out[block, k].astype(np.int64)
        known = now != 0
        hit = np.flatnonzero(known)
        if len(hit):
            add = (s.ahead(place[hit]) >> U(63)).astype(np.int64) * bit
            fixed = now[hit] & bit == 0 if bit == 1 else (np.abs(now[hit]) & bit) == 0
            fixed = (np.abs(now[hit]) & bit) == 0
            out[block[hit], k[hit]] = now[hit] + np.where(fixed, np.sign(now[hit]) * add, 0)
            place[hit] += 1
        zero = ~known & (ended == 0)
        put = np.flatnonzero(zero & (pending == 0))
        out[block[put], k[put]] = fresh[put]
        pending[zero] -= 1
        k += 1
        over = k > last
        block += over
        k[over] = scan.first
        pending[over] = -1
        ended[over & (ended > 0)] -= 1
        live = block < end
        if not live.all():
            place, block, end, k, pending, fresh, ended = (a[live] for a in (place, block, end, k, pending, fresh, ended))


def _decode_kind(data: np.ndarray, files: list[Parsed]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of files that have the same scans: all blocks, and each file's first block."""
    starts = np.concatenate([[0], np.cumsum([f.shape.starts[-1] for f in files])])
    out = np.zeros((starts[-1], 64), np.int32)
    for n, scan in enumerate(files[0].scans):
        s = Streams(data, [(f.scans[n].begin, f.scans[n].end) for f in files])
        nth = np.arange(len(s.image)) - np.searchsorted(s.image, s.image)
        if len(scan.comps) > 1:
            units = np.array([f.shape.wide * f.shape.high for f in files])
        else:
            units = np.array([_own_blocks(f, scan.comps[0])[0] * _own_blocks(f, scan.comps[0])[1] for f in files])
        every = np.array([f.scans[n].interval or u for f, u in zip(files, units)])[s.image]
        count = np.clip(units[s.image] - nth * every, 0, every)
        if len(scan.comps) > 1 or scan.first == 0:
            if len(scan.comps) > 1:
                rows = [interleaved(f.shape) for f in files]
                order = np.concatenate([(r[0][:, np.isin(r[1], scan.comps)] + a).ravel() for r, a in zip(rows, starts)])
                comp = rows[0][1][np.isin(rows[0][1], scan.comps)]
            else:
                order = np.concatenate([_raster(f, scan.comps[0]) + a for f, a in zip(files, starts)])
                comp = np.array(scan.comps)
            base = np.concatenate([[0], np.cumsum(units)])[:-1] * len(comp)
            _dc_scan(out, s, (order, base[s.image] + nth * every * len(comp)), count, comp, scan)
            continue
        full = all(_own_blocks(f, scan.comps[0]) == f.shape.blocks[scan.comps[0]] for f in files)
        begin = np.array([f.shape.starts[scan.comps[0]] for f in files]) + starts[:-1]
        run = _ac_refine_scan if scan.high else _ac_scan
        if full:
            run(out, s, begin[s.image] + nth * every, count, scan)
        else:  # a component that ends within its last unit: its scans leave out the blocks beyond
            order = np.concatenate([_raster(f, scan.comps[0]) + a for f, a in zip(files, starts)])
            part = out[order]
            base = np.concatenate([[0], np.cumsum(units)])[:-1]
            run(part, s, base[s.image] + nth * every, count, scan)
            out[order] = part
    return out, starts


def _own_blocks(f: Parsed, c: int) -> tuple[int, int]:
    """Rows and columns of blocks that a component's own scans have."""
    hmax, vmax = max(h for h, _ in f.shape.sampling), max(v for _, v in f.shape.sampling)
    h, v = f.shape.sampling[c]
    return -(-f.height * v // (8 * vmax)), -(-f.width * h // (8 * hmax))


def _raster(f: Parsed, c: int) -> np.ndarray:
    rows, cols = _own_blocks(f, c)
    return (f.shape.starts[c] + np.arange(rows)[:, None] * f.shape.blocks[c][1] + np.arange(cols)).ravel()


def decode(files: list[bytes]) -> tuple[list[Parsed], list[np.ndarray], list[int]]:
    """Each image's head, its coefficients as stored (a row of 64 in zigzag order for each block), and its file."""
    data, heads, of = parse_all(files)
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h.kind, []).append(i)
    out: list = [None] * len(heads)
    for own in groups.values():
        c, starts = _decode_kind(data, [heads[i] for i in own])
        for i, a, b in zip(own, starts[:-1], starts[1:]):
            out[i] = c[a:b]
    return heads, out, of


def rgb(head: Parsed, coefficients: np.ndarray) -> np.ndarray:
    """The image, height x width x 3 (or x 1), 8 bits: dequantised, inverse-transformed, chroma repeated to full size."""
    s = head.shape
    hmax, vmax = max(h for h, _ in s.sampling), max(v for _, v in s.sampling)
    planes = []
    for q, (rows, cols), (h, v), a, b in zip(head.quantisers, s.blocks, s.sampling, s.starts[:-1], s.starts[1:]):
        x = (coefficients[a:b] * q).astype(np.float32) @ inverse_dct()
        x = x.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if h < hmax:
            x = np.repeat(x, hmax // h, 1)
        if v < vmax:
            x = np.repeat(x, vmax // v, 0)
        planes.append(x)
    if len(planes) == 1:
        out = (planes[0] + 128)[..., None]
    else:
        y, cb, cr = planes[0] + 128, planes[1], planes[2]
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[: head.height, : head.width]
