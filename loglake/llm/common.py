"""What the operators of this package share: reading tables, materialising, sampling labelled rows."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.scratch import materialise, settled, temporaries

SAMPLE_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CROWDED = 100_000
LEAST_CROWD = 10_000


def crowded(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of more than 1 / CROWDED of the rows, and of more than LEAST_CROWD of them, with their number n: fewer than
    CROWDED, so small enough to broadcast whatever the input."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("all"))
    return counted.join(F.broadcast(total), F.col("n") > F.greatest(F.col("all") / CROWDED, F.lit(LEAST_CROWD)), "left_semi")  # one row


def joined(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows left-joined to side (one row a key). Rows of crowded keys find theirs in a broadcast; in the shuffle of the others
    they, and those of a null key, are dealt out under keys that match nothing."""
    names = [c for c in side.columns if c != key]
    hot = F.broadcast(crowded(rows, key).select(F.col(key).alias("_hot")))
    few = F.broadcast(side.join(hot, F.col(key) == F.col("_hot")).select("_hot", F.struct(*names).alias("_few")))  # fewer than CROWDED
    out = rows.join(few, F.col(key) == F.col("_hot"), "left")
    alone = F.col("_few").isNotNull() | F.col(key).isNull()
    out = out.withColumns({"_alone": alone, "_key": F.when(alone, F.xxhash64(F.monotonically_increasing_id()).cast(rows.schema[key].dataType)).otherwise(F.col(key))})
    rest = side.select(F.col(key).alias("_other"), F.struct(*names).alias("_rest"), F.lit(False).alias("_shared"))
    out = out.join(rest, (F.col("_key") == F.col("_other")) & (F.col("_alone") == F.col("_shared")), "left")
    found = F.coalesce("_few", "_rest")
    return out.select(*rows.columns, *(found[c].alias(c) for c in names))


def texts(column: pa.Array) -> pa.Array:
    """A text column as large strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a texts() column of at most max_bytes, or of one row that is longer: bounds what a kernel holds."""
    import numpy as np

    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        to = min(to, len(column))
        yield at, to
        at = to


def raw(column: pa.Array, at: int, to: int):
    """The bytes of rows at..to as uint8, and their offsets from 0 as int64."""
    import numpy as np

    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset + at : column.offset + to + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def tidy(run):
    """A function over Arrow batches that gives its freed memory back to the system when a task ends: Python workers stay
    for later stages, and several of them share an executor."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return inner


def bucket_of(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str | tuple[str, ...], rows: int, keep=None, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label), or a column for each of several labels, of at most `rows` labelled documents of at most
    `most_bytes` in all (or one that is longer): the first by a hash of the id, so the same on every run, spread over all
    sources. Both bounds are parameters of each classifier.

    Ids are joined before they are limited, so labels of unknown documents take no place; an id counts once, with its least
    text and its highest label. Only ids move in that join. Labels are taken where none of an id's row is null."""
    names = (label,) if isinstance(label, str) else label
    kinds = {n: "label" if isinstance(label, str) else n for n in names}
    d = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    y = labels.select("doc_id", *(F.col(n).cast("double").alias(k) for n, k in kinds.items())).dropna()
    if keep is not None:
        y = y.where(keep)
    y = y.groupBy("doc_id").agg(*(F.max(k).alias(k) for k in kinds.values()))
    picked = y.join(d.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return bounded_texts(d, picked, most_bytes)


def bounded_texts(docs: DataFrame, picked: DataFrame, most_bytes: int = SAMPLE_BYTES, least=None) -> DataFrame:
    """picked (doc_id, ...: a bounded number of rows in order of their hash) with a text each: the least of the id's texts,
    or the one of the least value of the columns `least`; as many rows, in that order, as most_bytes allow."""
    picked = F.broadcast(picked.withColumn("_order", F.xxhash64("doc_id")))  # bounded by the caller's limit
    rest = [c for c in picked.columns if c != "doc_id"]
    one = docs.join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*(least or ()), "text")).alias("_row"), *(F.first(c).alias(c) for c in rest))
    one = materialise(one.select("doc_id", "_row.*", *rest), "sample")
    sizes = one.select("doc_id", "_order", F.octet_length("text").alias("n")).collect()  # ids and sizes of the sample
    total, kept = 0, []
    for r in sorted(sizes, key=lambda r: (r["_order"], r["doc_id"])):
        total += r["n"]
        if kept and total > most_bytes:
            break
        kept.append((r["doc_id"],))
    few = docs.sparkSession.createDataFrame(kept, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    return one.join(F.broadcast(few), "doc_id").drop("_order")


__all__ = ["bounded_texts", "bucket_of", "crowded", "joined", "labelled_sample", "materialise", "raw", "settled", "slices", "table", "temporaries", "texts", "tidy"]
