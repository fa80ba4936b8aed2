"""Rolling segments: a new one begins before a record when the present one has reached its cap, so the last record of a
segment may pass it. That is a fold over all records; here it runs chunk by chunk in parallel."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.operators.append import running_total
from loglake.scratch import materialise, temporaries

CHUNK_CAPS = 16
CHUNK_BYTES = 32 << 20
FAN = 16
STEPS = "chunk long, upto long, goal long, segments long"
ENTRIES = "chunk long, wanted long, nth long"


def with_offsets(log: DataFrame, size: str = "frame_bytes") -> DataFrame:
    """log with log_offset: bytes of all records before. An append may have told them already."""
    if "log_offset" in log.columns:
        return log
    return running_total(log, F.col(size), "log_offset", inclusive=False)


def _jumps(off: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a segment that begins at each record: where (in bytes) the first segment past the chunk begins, and how many
    segments begin in the chunk on the way. By doubling: rounds go with the logarithm of a chunk's segments."""
    n = len(off)
    step = np.searchsorted(off, off + cap)
    goal, count = off + cap, np.ones(n, np.int64)
    while (live := step < n).any():
        to = step[live]
        goal[live] = goal[to]
        count[live] += count[to]
        step[live] = step[to]
    return goal, count


def _merged(chunk: int, upto: np.ndarray, goal: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """Steps, of those on end that lead alike the last."""
    last = np.flatnonzero(np.append((goal[1:] != goal[:-1]) | (count[1:] != count[:-1]), True)) if len(upto) else upto
    return pd.DataFrame({"chunk": chunk, "upto": upto[last], "goal": goal[last], "segments": count[last]})


def _summary(cap: int):
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        """How a chunk leads from a wanted place (in bytes) to the next one, as steps: both rise together."""
        off = np.sort(chunk["log_offset"].to_numpy())
        out = _merged(chunk["chunk"].iloc[0], off, *_jumps(off, cap))
        return out[: bisect_left(out["upto"].tolist(), off[0] + cap) + 1]  # no segment before the chunk reaches further

    return run


def _in_order(steps: pd.DataFrame):
    """(chunk, upto, goal, segments) of each chunk, in order."""
    steps = steps.sort_values(["chunk", "upto"], ignore_index=True)
    cuts = np.flatnonzero(np.diff(steps["chunk"].to_numpy(), prepend=-1, append=-1))
    cols = [steps[c].to_numpy() for c in ("chunk", "upto", "goal", "segments")]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(cols[0][a]), cols[1][a:b], cols[2][a:b], cols[3][a:b]


def _composed(steps: pd.DataFrame) -> pd.DataFrame:
    """The steps of FAN chunks on end as those of one: chains run through, and meet on the way, so that fewer differ."""
    upto = goal = count = np.empty(0, np.int64)
    for _, u, g, n in _in_order(steps):
        at = np.searchsorted(u, goal)
        hit = at < len(u)
        count = count + np.where(hit, n[np.minimum(at, len(u) - 1)], 0)
        goal = np.where(hit, g[np.minimum(at, len(u) - 1)], goal)
        new = u > (upto[-1] if len(upto) else -1)
        upto, goal, count = (np.concatenate(x) for x in ((upto, u[new]), (goal, g[new]), (count, n[new])))
    return _merged(int(steps["chunk"].iloc[0]) // FAN, upto, goal, count)


def _followed(steps: pd.DataFrame, wanted: int, nth: int) -> pd.DataFrame:
    """Where the one real chain enters each chunk: the place wanted, and the number of the segment that begins there."""
    out = []
    for c, u, g, n in _in_order(steps):
        out.append((c, wanted, nth))
        i = int(np.searchsorted(u, wanted))
        if i < len(u):
            wanted, nth = int(g[i]), nth + int(n[i])
    return pd.DataFrame(out, columns=["chunk", "wanted", "nth"])


def _entries(steps: DataFrame, chunks: int, wanted: int, nth: int) -> DataFrame:
    """_followed() for any number of chunks: groups of FAN are composed until one is left, then entries go down again. A task
    holds the steps of FAN chunks: at most as many each as records fit a segment."""
    if chunks <= FAN:
        return steps.groupBy(F.col("chunk") * 0).applyInPandas(lambda s: _followed(s, wanted, nth), ENTRIES)
    group = F.floor(F.col("chunk") / FAN).cast("long")
    above = materialise(steps.groupBy(group).applyInPandas(_composed, STEPS), "steps")
    entered = _entries(above, -(-chunks // FAN), wanted, nth)

    def down(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return _followed(s, int(e["wanted"].iloc[0]), int(e["nth"].iloc[0])) if len(s) else pd.DataFrame([], columns=["chunk", "wanted", "nth"])

    return steps.withColumn("_group", group).groupBy("_group").cogroup(entered.groupBy("chunk")).applyInPandas(lambda k, s, e: down(k, s.drop(columns="_group"), e), ENTRIES)


def _begins(cap: int):
    def run(key: tuple, chunk: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        """The segments that begin in a chunk."""
        off = np.sort(chunk["log_offset"].to_numpy())
        found, at = [], int(np.searchsorted(off, entry["wanted"].iloc[0])) if len(entry) else len(off)
        while at < len(off):
            found.append(off[at])
            at = int(np.searchsorted(off, off[at] + cap))
        first = int(entry["nth"].iloc[0]) if len(entry) else 0
        return pd.DataFrame({"segment_id": np.arange(first, first + len(found)), "opened": np.array(found, np.int64)})

    return run


def begun(offsets: DataFrame, cap: int, first_id: int = 0, used: int = 0, chunk_bytes: int | None = None) -> pd.DataFrame:
    """(segment_id, opened): where in bytes each segment begins, for records at the offsets (log_offset). With `used`, the
    first segment is there already and holds so many bytes. At most as many rows as segments can have ids."""
    spark = offsets.sparkSession
    size = chunk_bytes or max(cap * CHUNK_CAPS, CHUNK_BYTES)
    with temporaries(spark):
        cut = offsets.select(F.floor(F.col("log_offset") / size).cast("long").alias("chunk"), "log_offset")
        last = cut.agg(F.max("chunk")).first()[0]
        if last is None:
            return pd.DataFrame({"segment_id": [], "opened": []}, dtype="int64")
        if last * size > 2 * cap * (S.MAX_SEGMENT_ID + 1):  # a segment holds less than two caps
            raise ValueError(f"the log needs more than {S.MAX_SEGMENT_ID + 1} segments of {cap} bytes")
        wanted, nth = max(cap - used, 0) if used else 0, first_id + bool(used)
        if last:
            steps = materialise(cut.groupBy("chunk").applyInPandas(_summary(cap), STEPS), "steps")
            entries = _entries(steps, last + 1, wanted, nth)
        else:  # where one chunk is entered needs no steps
            entries = spark.createDataFrame([(0, wanted, nth)], ENTRIES)
        found = cut.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInPandas(_begins(cap), "segment_id long, opened long")
        out = found.toPandas().sort_values("opened", ignore_index=True)
    if used:
        out = pd.concat([pd.DataFrame({"segment_id": [first_id], "opened": [-used]}), out], ignore_index=True)
    if len(out) and out["segment_id"].iloc[-1] > S.MAX_SEGMENT_ID:
        raise ValueError(f"the log needs more than {S.MAX_SEGMENT_ID + 1} segments")
    return out


def assign(log: DataFrame, cap: int, size: str = "frame_bytes", first_id: int = 0, used: int = 0, chunk_bytes: int | None = None) -> DataFrame:
    """log with segment_id and byte_offset (within the segment), in its own columns and partitions otherwise.

    Each chunk of chunk_bytes (CHUNK_CAPS caps, and CHUNK_BYTES at least, unless given) tells, for every place a segment might have to begin at, where the chain leaves it.
    These steps compose, so they are reduced as a tree; the one real chain then goes down the tree, and every chunk finds
    its own segments. A row finds its segment among all begins by bisection: of the row only its offset goes to Python."""
    placed, told = with_offsets(log, size), "log_offset" in log.columns
    with temporaries(log.sparkSession):
        offsets = placed.select("log_offset")
        begins = begun(offsets if told else materialise(offsets, "offsets"), cap, first_id, used, chunk_bytes)
    shared = log.sparkSession.sparkContext.broadcast((begins["opened"].to_numpy(np.int64), begins["segment_id"].to_numpy(np.int64)))  # MAX_SEGMENT_ID + 1 rows at most

    @F.pandas_udf("segment_id int, byte_offset long")
    def place(offset: pd.Series) -> pd.DataFrame:
        opened, ids = shared.value
        at = np.searchsorted(opened, offset.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"segment_id": ids[at].astype(np.int32), "byte_offset": offset.to_numpy(np.int64) - opened[at]})

    found = placed.withColumn("_found", place(F.col("log_offset").cast("long")))
    return found.select(*log.columns, "_found.segment_id", "_found.byte_offset")


def statistics(log: DataFrame, last_write: Column | None = None) -> DataFrame:
    """One row a segment: first and last seq, bytes, records, whether it is the active (last) one. Written, as its callers
    read it more than once, and each time would read the whole log."""
    extra = [] if last_write is None else [F.max(last_write).alias("last_write")]
    out = log.groupBy("segment_id").agg(F.min("seq_no").alias("first_seq"), F.max("seq_no").alias("last_seq"), F.sum("frame_bytes").alias("bytes"), F.count("*").alias("records"), *extra)
    out = materialise(out, "statistics")  # MAX_SEGMENT_ID + 1 rows at most
    newest = out.agg(F.max("segment_id").alias("_active"))
    return out.crossJoin(F.broadcast(newest)).withColumn("is_active", F.col("segment_id") == F.col("_active")).drop("_active")  # one row
