"""N-gram Jaccard join by parity sketches: all documents that links of similar shingle sets connect.

Two documents link when DEN * |intersection| >= NUM * |union| of their sets of k-word shingles.

1. Sets. Words are hashed from the whole text; a text's set is the sorted distinct hashes of its k-word windows. The
   fingerprint of a set stands for all documents that have it: equal sets are one node from here on.
2. Sketches. For sets of a size band, shingles are dealt to m cells by their hash. A cell of the (very wide) parity sketch
   is the XOR of its shingles' 64-bit values. Each shingle that only one of two sets has changes one cell, so a distance
   in cells is at most the symmetric difference, which the similarity bounds by D = (a + b)(DEN - NUM)/(DEN + NUM).
   By pigeonhole, of D + 1 + s cells 1 + s agree in every pair that links, and agreeing cells hold the same shingles. The
   slack s lets a set leave out its poor cells (fewer than RICH shingles), on which strangers agree: all of them if they
   are at most s, else the s // 2 poorest. Either way some agreeing cell is emitted by both sets.
   Each set takes the cells that its own largest D needs: for its own band and, as the larger partner, for lower bands.
3. Candidates. Equal cells join. Within a task equal cells are joined to their first node before anything is shuffled;
   after the shuffle a streaming pass joins what is left. A cell that a third of all documents share is thus a star,
   one row a task, never a group. What results are connected candidate groups, not pairs.
4. Verification. Each candidate group is compared by blocks: fixed-width bit sketches give a Hamming distance that bounds
   the symmetric difference from below, pairs within the bound and not yet connected are verified exactly on their sets,
   and a block reports a spanning forest of its links. Large groups are dealt to pairs of blocks over many tasks, first
   with the sketches alone, which split them into groups of really near sets, then those with the sets.
5. Components of the links, and for each the smallest doc_id.

Defined cases: a null, empty or blank text has an empty set and links with nothing; a text with fewer than k words has its
whole word sequence as one shingle; repeated rows (of one doc_id, too) are rows of their own with the same results per
text; a row without a doc_id links like any other, and its component is the smallest doc_id that there is in it, or null;
an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loglake.llm.common import joined, materialise, raw, settled, slices, table, texts, tidy
from loglake.llm.components import components, forest
from loglake.llm.kernels import ODD, U, Words, mix

SLICE_BYTES = 1 << 19
BLOCK_BYTES = 2 << 20
BLOCK_SETS = 1024
SKETCH_BLOCK_SETS = 4096
BLOOM_MEMBER_BITS = 16
BLOOM_LEAST, BLOOM_MOST = 20, 28  # powers of two: bits of a Bloom filter
BLOOM_HASHES = 4
MET_SETS = 1 << 18
HELD_CELLS = 1 << 19
RICH = 3  # shingles from which a cell is always emitted


@dataclass(frozen=True)
class Similarity:
    """k-word shingles, and a similarity of num / den or more."""

    k: int
    num: int
    den: int

    def difference(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return ((a + b) * (self.den - self.num)) // (self.den + self.num)

    def largest(self, a):
        """The largest partner of a set of size a."""
        return a * self.den // self.num

    def bands(self, most: int) -> np.ndarray:
        """First sizes of the bands, up to one past `most`: each a quarter as large again as the one before."""
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, out[-1] * 5 // 4))
        return np.array(out, np.int64)


def slack(d):
    """Cells beyond pigeonhole's D + 1; depends on the band alone."""
    return np.where(d > 0, 2 + d // 5, 0)


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set (0 for an empty one)."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        v = mix(h ^ U(0xD6E8FEB86659FD93))
        out[full] = mix(np.add.reduceat(v, first[:-1][full]) + sizes[full].astype(np.uint64) * ODD)
    return out


def cells(h: np.ndarray, first: np.ndarray, which: np.ndarray, m: np.ndarray, need: np.ndarray, s: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells that sets `which` emit in their schemes, and the place in `which` of each. m: cells of the
    scheme, need: how many of them, from the first, this set takes, s: slack."""
    sizes = (first[1:] - first[:-1])[which]
    at = np.repeat(first[:-1][which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    of = np.repeat(np.arange(len(which)), sizes)
    v = h[at]
    cell = ((v >> U(32)) * m.astype(np.uint64)[of] >> U(32)).astype(np.int64)  # ascending within a set
    keep = cell < need[of]
    v, of, cell = mix(v[keep] + ODD), of[keep], cell[keep]
    if not len(v):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])]))
    value, count = np.bitwise_xor.reduceat(v, new), np.diff(np.append(new, len(v)))
    of, cell = of[new], cell[new]
    emit = count >= RICH
    poor = need - np.bincount(of[emit], minlength=len(which))
    extra_of, extra_cell = [], []
    starts = np.searchsorted(of, np.arange(len(which) + 1))
    for i in np.flatnonzero(poor > s).tolist():  # rare
        own = slice(starts[i], starts[i + 1])
        empty = np.setdiff1d(np.arange(need[i]), cell[own], assume_unique=True)
        left_out = s[i] // 2
        extra_of.append(np.full(len(empty[left_out:]), i))
        extra_cell.append(empty[left_out:])
        few = np.flatnonzero(~emit[own])
        few = few[np.argsort(count[own][few], kind="stable")][max(left_out - len(empty), 0) :]
        emit[starts[i] + few] = True
    of, cell, value = (np.concatenate([x[emit], *y]) for x, y in ((of, extra_of), (cell, extra_cell), (value, [np.zeros(len(e), np.uint64) for e in extra_of])))
    return mix(value + mix(cell.astype(np.uint64) * ODD + band[of].astype(np.uint64))), of


def emitted(h: np.ndarray, first: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all cells that the sets emit, and each key's set."""
    n = np.diff(first)
    if not n.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edges = sim.bands(int(n.max()))
    own = np.searchsorted(edges, n, "right") - 1
    keys, sets = [], []
    for back in range(len(edges)):
        band = own - back
        top = edges[np.minimum(np.maximum(band, 0) + 1, len(edges) - 1)] - 1  # largest size of the band
        if back == 0:
            d = sim.difference(n, sim.largest(n))
            take = n > 0
        else:
            d = sim.difference(n, top)
            take = (n > 0) & (band >= 0) & (top * sim.den >= n * sim.num)
        which = np.flatnonzero(take & (d > 0))
        if back and not take.any():
            break
        if len(which):
            most = sim.difference(top, sim.largest(top))[which]
            s = slack(most)
            k, of = cells(h, first, which, most + 1 + s, d[which] + 1 + s, s, band[which])
            keys.append(k)
            sets.append(which[of])
    return (np.concatenate(keys), np.concatenate(sets)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


def sized(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles and set (the fingerprint; null for an empty set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(1))
            for at, to in slices(text, SLICE_BYTES):
                h, first = Words(*raw(text, at, to), fold=True).shingle_sets(sim.k)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to].cast(pa.int64()), pa.array(n), pa.array(fingerprints(h, first).view(np.int64), mask=n == 0)], ["doc_id", "n_shingles", "set"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set long")


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, node) rows: each key with its first node, and edges from there to the other nodes, as a forest."""
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = node[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else node
    far = ~new & (head != node)
    u, v = forest(head[far], node[far]) if far.any() else (node[:0], node[:0])
    return key[new], node[new], u, v


def candidates(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Edges (u, v) between fingerprints whose components hold all pairs that can link."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            key, node, u, v = stars(*(np.concatenate(x) for x in zip(*held)))
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                k = pa.array(key[part].view(np.int64))
                yield pa.RecordBatch.from_arrays([k, pa.array(node[part]), pa.nulls(len(k), pa.int64())], ["key", "u", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(mix(v.view(np.uint64) + ODD).view(np.int64)), pa.array(u), pa.array(v)], ["key", "u", "v"])

        for b in batches:
            text = texts(b.column(0))
            for at, to in slices(text, SLICE_BYTES):
                h, first = Words(*raw(text, at, to), fold=True).shingle_sets(sim.k)
                f = fingerprints(h, first).view(np.int64)
                fresh = np.zeros(len(f), bool)
                for i, x in enumerate(f.tolist()):
                    if x not in met:
                        met.add(x)
                        fresh[i] = True
                n_all = np.diff(first)
                if not (fresh & (n_all > 0)).any():
                    continue
                keep = np.repeat(fresh, n_all)
                first = np.concatenate([[0], np.cumsum(np.where(fresh, n_all, 0))])
                key, of = emitted(h[keep], first, sim)
                held.append((key, f[of]))
                n += len(key)
                if n >= HELD_CELLS:
                    yield from out()
                    held, n = [], 0
                    met.clear()
                elif len(met) > MET_SETS:  # sets of few shingles emit no cells
                    met.clear()
        if held:
            yield from out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node = None, 0
        us, vs, n = [], [], 0
        for b in batches:
            key, u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ready = ~np.isnan(v) if v.dtype.kind == "f" else np.ones(len(v), bool)
            if ready.any():
                mask = b.column(2).is_valid()
                us.append(b.column(1).filter(mask).to_numpy())
                vs.append(b.column(2).drop_null().to_numpy())
            key, node = key[~ready], u[~ready]
            if len(key):
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                new[0] = key[0] != last_key
                head = np.where(new, np.arange(len(key)), 0)
                np.maximum.accumulate(head, out=head)
                first = node[head]
                if not new[0]:
                    until = int(np.argmax(new)) if new.any() else len(key)
                    first[:until] = last_node
                far = first != node
                us.append(first[far])
                vs.append(node[far])
                last_key, last_node = key[-1], first[-1]
            n = sum(map(len, us))
            if n >= 1 << 20:
                u2, v2 = forest(np.concatenate(us), np.concatenate(vs))
                yield pa.RecordBatch.from_arrays([pa.array(u2), pa.array(v2)], ["u", "v"])
                us, vs, n = [], [], 0
        if n:
            u2, v2 = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u2), pa.array(v2)], ["u", "v"])

    rows = docs.select("text").mapInArrow(tidy(emit), "key long, u long, v long")
    dealt = rows.repartition(_partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidy(join), "u long, v long")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def linked_within(sets: list[np.ndarray], n: np.ndarray, ids: np.ndarray, side: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between sets of side 0 and of side 1, or within side 0 where there is no side 1."""
    order = np.argsort(n, kind="stable")
    sets, ids, side, n = [sets[i] for i in order], ids[order], side[order], n[order]
    words = max(4, int(sim.difference(n[-1], n[-1])) // 8 + 1)
    sketch = np.zeros((len(sets), words), np.uint64)
    for i, s in enumerate(sets):
        w = ((s >> U(32)) * U(words) >> U(32)).astype(np.int64)  # ascending, as the set is
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        sketch[i, w[at]] = np.bitwise_xor.reduceat(U(1) << (mix(s + ODD) & U(63)), at)
    both = bool(side.any())
    label = np.arange(len(sets))
    us, vs = [], []
    for i in range(len(sets)):
        to = np.searchsorted(n, sim.largest(n[i]), "right")
        if to <= i + 1:
            continue
        near = slice(i + 1, to)
        ask = label[near] != label[i]
        if both:
            ask &= side[near] != side[i]
        j = np.flatnonzero(ask) + i + 1
        if not len(j):
            continue
        bound = sim.difference(n[i], n[j])
        first = min(8, words)
        j, bound = _close(sketch, i, j, bound, slice(0, first))
        if first < words and len(j):
            j, bound = _close(sketch, i, j, bound, slice(0, words))
        for x in j.tolist():
            if label[x] != label[i] and _linked(sets[i], sets[x], sim):
                us.append(ids[i])
                vs.append(ids[x])
                label[label == label[x]] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _close(sketch: np.ndarray, i: int, j: np.ndarray, bound: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    apart = np.bitwise_count(sketch[j, part] ^ sketch[i, part]).sum(1, dtype=np.int64)
    ok = apart <= bound
    return j[ok], bound[ok]


def _linked(a: np.ndarray, b: np.ndarray, sim: Similarity) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * sim.den >= sim.num * (len(a) + len(b) - common)


def _places(f: np.ndarray, power: int) -> np.ndarray:
    """BLOOM_HASHES places in a Bloom filter of 2**power bits for each fingerprint, a row each."""
    v = f.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        steps = np.arange(1, BLOOM_HASHES + 1, dtype=np.uint64) * ODD
    return (mix(v[:, None] + steps) >> U(64 - power)).astype(np.int64)


def _bloom(members: DataFrame) -> np.ndarray:
    """A Bloom filter over the members' sets, of BLOOM_MEMBER_BITS bits a member between its bounds: tasks emit the words they
    set, which are merged by or. Past the upper bound it lets more strangers through, which a join then removes."""
    count = members.count()
    power = min(max((count * BLOOM_MEMBER_BITS).bit_length(), BLOOM_LEAST), BLOOM_MOST)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _places(b.column(0).to_numpy(), power).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    merged = members.select("set").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = merged.toPandas()  # at most 2**power / 64 rows
    out = np.zeros(1 << power - 6, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def _in_bloom(bloom: np.ndarray, f: np.ndarray) -> np.ndarray:
    at = _places(f, (64 * len(bloom)).bit_length() - 1)
    return ((bloom[at >> 6] >> (at & 63).astype(np.uint64)) & U(1)).all(1)


def _blocked(groups: DataFrame, size: Column) -> DataFrame:
    """(set, component, blocks, block) of groups: each component in as many blocks as `size` (an aggregate) asks for."""
    shape = groups.groupBy("component").agg(size.cast("int").alias("blocks"))
    members = joined(groups.select("set", "component"), shape, "component")
    return members.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))


def _compared(docs: DataFrame, members: DataFrame, sim: Similarity, payload, compare) -> DataFrame:
    """compare(sets, side, payloads) -> (u, v) over all pairs of blocks of each component; payload(hashes) is what a set
    brings along. The texts are read again; a Bloom filter of bounded size keeps those of other sets out of the shuffle."""
    maybe = docs.sparkSession.sparkContext.broadcast(_bloom(members))  # 2**BLOOM_MOST bits at most

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            text = texts(b.column(0))
            for at, to in slices(text, SLICE_BYTES):
                h, first = Words(*raw(text, at, to), fold=True).shingle_sets(sim.k)
                f = fingerprints(h, first).view(np.int64)
                fresh = [i for i in np.flatnonzero(_in_bloom(maybe.value, f)).tolist() if f[i] not in met and not met.add(f[i])]
                if fresh:
                    made = pa.array([payload(h[first[i] : first[i + 1]]).tobytes() for i in fresh], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(f[fresh]), pa.array(np.diff(first)[fresh]), made], ["set", "n", "payload"])
            if len(met) > MET_SETS:
                met.clear()

    found = docs.select("text").mapInArrow(tidy(take), "set long, n long, payload binary").dropDuplicates(["set"])
    sets = found.join(members, "set")
    # block b meets block c >= b in unit (b, c); one block alone is unit (0, 0)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = sets.select("component", "set", "n", "payload", "block", every).select("component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "set", "n", "payload")

    def unit(got: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in got.column("payload").to_pylist()]
        u, v = compare(found, got.column("n").to_numpy(), got.column("set").to_numpy(), got.column("side").to_numpy(), sim)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return units.groupBy("component", "a", "b").applyInArrow(unit, "u long, v long")


def sketch_words(n: int) -> int:
    """64-bit words of a set's sketch, a power of two: 1.3 to 2.7 bits a shingle, several times the difference allowed."""
    return 1 << max(1, (n // 24).bit_length() - 1)


def sketched(h: np.ndarray) -> np.ndarray:
    """The parity sketch of a set's sorted hashes: each flips one bit. Neighbouring words of it, XORed, are the sketch of
    half as many words."""
    words = sketch_words(len(h))
    w = ((h >> U(32)) * U(words) >> U(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    out = np.zeros(words, np.uint64)
    out[w[at]] = np.bitwise_xor.reduceat(U(1) << (mix(h + ODD) & U(63)), at)
    return out


def near_within(sketches: list[np.ndarray], n: np.ndarray, ids: np.ndarray, side: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (as in linked_within) whose sketches' distance does not rule a link out."""
    order = np.argsort(n, kind="stable")
    n, ids, side = n[order], ids[order], side[order]
    words = np.array([len(sketches[i]) for i in order])
    kinds = {int(w): np.stack([sketches[i] for i in order[words == w]]) for w in np.unique(words)}
    begins = {w: int(np.searchsorted(words, w)) for w in kinds}
    both, label = bool(side.any()), np.arange(len(n))
    us, vs = [], []
    for i in range(len(n)):
        to = int(np.searchsorted(n, sim.largest(n[i]), "right"))
        if to <= i + 1:
            continue
        w = int(words[i])
        mine = kinds[w][i - begins[w]]
        ask = label[i + 1 : to] != label[i]
        if both:
            ask &= side[i + 1 : to] != side[i]
        every = np.flatnonzero(ask) + i + 1
        hits = []
        for other, rows in kinds.items():  # partners have as many words, or twice as many: those are folded
            j = every[words[every] == other]
            if not len(j):
                continue
            theirs = rows[j - begins[other]]
            while theirs.shape[1] > w:
                theirs = theirs[:, ::2] ^ theirs[:, 1::2]
            apart = np.bitwise_count(theirs ^ mine).sum(1, dtype=np.int64)
            hits.append(j[apart <= sim.difference(n[i], n[j])])
        hit = np.concatenate(hits) if hits else every
        if len(hit):
            groups, one = np.unique(label[hit], return_index=True)
            us += [ids[i]] * len(one)
            vs += ids[hit[one]].tolist()
            label[np.isin(label, groups)] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def refined(docs: DataFrame, groups: DataFrame, sim: Similarity) -> DataFrame:
    """groups (set, n_shingles, component), those of more than a block replaced by the components of what the sketches
    alone do not rule out: shared passages chain strangers into one group, and sketches are small enough to compare all."""
    large = groups.groupBy("component").agg(_blocks_needed().alias("blocks")).where("blocks > 1")
    if large.isEmpty():
        return groups
    marked = materialise(joined(groups, large, "component"), "marked")
    members = materialise(_blocked(marked.where("blocks is not null").drop("blocks"), F.ceil(F.count("*") / SKETCH_BLOCK_SETS)), "large-members")
    near = components(_compared(docs, members, sim, sketched, near_within)).select(F.col("node").alias("set"), F.col("component").alias("component"))
    split = marked.drop("component").join(near, "set").select(*groups.columns)
    return materialise(marked.where("blocks is null").select(*groups.columns).union(split), "refined")


def _blocks_needed() -> Column:
    return F.ceil(F.greatest(F.sum(8 * F.col("n_shingles") + 64) / BLOCK_BYTES, F.count("*") / BLOCK_SETS))


def links(docs: DataFrame, groups: DataFrame, sim: Similarity) -> DataFrame:
    """Edges (u, v) of a spanning forest of the links within groups (set, n_shingles, component), by blocks."""
    members = materialise(_blocked(refined(docs, groups, sim), _blocks_needed()), "members")
    return _compared(docs, members, sim, lambda h: h, linked_within)


def classes(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles, set (fingerprint of its shingles) and component_id of every document."""
    return linked(docs, sim).drop("linked")


def linked(docs: DataFrame, sim: Similarity) -> DataFrame:
    """classes(), and linked: the component as one of its sets, as component_id may be null or of several components."""
    spark = docs.sparkSession
    return settled(spark, "classes", lambda: _linked_rows(docs, sim))


def _linked_rows(docs: DataFrame, sim: Similarity) -> DataFrame:
    spark = docs.sparkSession
    rows = materialise(sized(docs, sim), "sets")
    first = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"))

    def grouped() -> DataFrame:
        found = components(candidates(docs, sim))
        return first.join(found.select(F.col("node").alias("set"), "component"), "set").select("set", "n_shingles", "component")

    groups = settled(spark, "groups", grouped)
    final = settled(spark, "final", lambda: components(links(docs, groups, sim)).select(F.col("node").alias("set"), F.col("component").alias("linked")))
    named = first.select("set", F.col("doc_id").alias("own")).join(final, "set", "left").withColumn("linked", F.coalesce("linked", "set"))
    least = named.groupBy("linked").agg(F.min("own").alias("least"))
    named = joined(named, least, "linked").select("set", "linked", F.col("least").alias("component_id"))
    return joined(rows, named, "set").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set", "linked")


def _with_set(docs: DataFrame, sim: Similarity, name: str) -> DataFrame:
    """docs, and the fingerprint of each row's own set (null for an empty one) as the column `name`."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = texts(b.column(where))
            for at, to in slices(text, SLICE_BYTES):
                h, first = Words(*raw(text, at, to), fold=True).shingle_sets(sim.k)
                of = pa.array(fingerprints(h, first).view(np.int64), mask=np.diff(first) == 0)
                yield pa.RecordBatch.from_arrays([*b.slice(at, to - at).columns, of], [*b.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, LongType())]))


def representatives(docs: DataFrame, sim: Similarity) -> DataFrame:
    """docs with its own columns, one row of each component: that of its smallest doc_id (null last), and of several such
    rows that of the smallest set, then of the smallest hash of the text. Rows without words stay, but of those with one
    doc_id and equal texts one does."""
    found = linked(docs, sim)
    each = found.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "doc_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n"))
    left = docs.join(each.where("gone or n > 1").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again, unnamed = each.where("n > 1").select("doc_id"), found.where("doc_id is null")
    if again.isEmpty() and unnamed.isEmpty():
        return left
    # Rows that their doc_id does not tell apart: known by doc_id and set, of which equal ones meet in partial aggregates.
    odd = docs.join(again, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    name = "set"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    odd = _with_set(odd, sim, name)
    wordless = odd.where(F.col(name).isNull()).drop(name)
    wordless = wordless.where("doc_id is null").union(wordless.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    first = found.where("set is not null and doc_id <=> component_id").groupBy("linked").agg(F.min("doc_id").alias("least"), F.min("set").alias("of"))
    one = odd.where(F.col(name).isNotNull()).groupBy(F.col("doc_id").alias("id"), F.col(name).alias("own")).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text")).alias("row"))
    one = one.join(first, F.col("id").eqNullSafe(F.col("least")) & (F.col("own") == F.col("of")), "left_semi").select("row.*")
    return left.where("doc_id is not null").union(wordless).union(one)


CONTRACT = Similarity(4, 85, 100)
PIPELINE = Similarity(5, 80, 100)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), CONTRACT).drop("set")

ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE 100 * common >= 85 * (len(a.s) + len(b.s) - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = sets.doc_id
"""
