"""Appending: sequence numbers, frames, and running offsets, without moving all rows to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loglake import schema as S
from loglake.scratch import materialise

RANGE_BYTES = 256 << 20
BLOCK = 1 << 16


def _ranges(df: DataFrame) -> int:
    """How many order ranges df is dealt to: as many as the session shuffles to, or as its estimated size needs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, 1 << 17))


@F.pandas_udf(LongType())
def _before(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The sum of the values before each row of a task."""
    total = 0
    for v in values:
        ends = total + np.cumsum(v.to_numpy(np.int64))
        yield pd.Series(ends - v.to_numpy(np.int64))
        total = int(ends[-1]) if len(ends) else total


def sequence(df: DataFrame, order: list[str], start: int = 0, name: str = "seq_no", ranges: int | None = None, total: tuple[str, Column] | None = None) -> DataFrame:
    """df with a sequence number by `order`, gapless from start; with `total`, a name and a long column, also the sum of that
    column over all rows before each.

    Rows are dealt to order ranges and sorted once, and written with their places: Spark samples range bounds anew in each
    run, so a second evaluation could number rows otherwise. A row's number is its place plus the counts of the ranges
    before, a row for each range. Rows of equal keys lie in one range: order by something that tells rows apart."""
    dealt = df.repartitionByRange(ranges or _ranges(df), *(F.col(c) for c in order)).sortWithinPartitions(*order)
    size = F.lit(0).cast("long") if total is None else F.coalesce(total[1].cast("long"), F.lit(0))
    ahead = size if total is None else _before(F.col("_size"))
    placed = materialise(dealt.withColumn("_size", size).select(F.monotonically_increasing_id().alias("_place"), "_size", ahead.alias("_ahead"), *df.columns), "sequence")
    part = F.shiftright("_place", 33)  # Spark's layout of these ids: the partition, then 33 bits of the row's place
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("_size").alias("_all"))
    before = lambda c: F.coalesce(F.sum(c).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_part", (before("_n") - F.shiftleft(F.col("_part"), 33) + start).alias("_shift"), before("_all").alias("_base"))
    out = placed.join(F.broadcast(shift), part == F.col("_part"))  # a row for each range, 2**17 at most
    more = [] if total is None else [(F.col("_base") + F.col("_ahead")).cast("long").alias(total[0])]
    return out.select(*df.columns, (F.col("_place") + F.col("_shift")).cast("long").alias(name), *more)


def running_total(df: DataFrame, value: Column, name: str, order: str = "seq_no", keys: tuple[str, ...] = (), block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """df with the sum of `value` over the rows of the same keys up to each (or before it), by a gapless long `order`.

    Within blocks of `order`, and over the blocks' sums; without keys these sums have blocks again. A key with a third of
    all rows is as many blocks as its rows need, and no task holds more of it than one. The rows move once: the join with
    the blocks' sums uses the partitioning of the window. Keys are compared as one struct, in which nulls are equal."""
    part = ["_block", *(["_keys"] if keys else [])]
    cut = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    if keys:
        cut = cut.withColumn("_keys", F.struct(*keys))
    sums = cut.groupBy(*part).agg(F.sum("_value").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*part[1:]).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not keys:
        sums = sums.withColumn("_far", F.floor(F.col("_block") / block).cast("long"))
        far = sums.groupBy("_far").agg(F.sum("_sum").alias("_all"))
        far = far.select("_far", F.coalesce(F.sum("_all").over(W.orderBy("_far").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
        near = F.coalesce(F.sum("_sum").over(W.partitionBy("_far").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("_near", near).join(far, "_far")
        before = F.col("_near") + F.col("_ahead")
    base = sums.select(*part, before.alias("_base"))
    frame = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = F.coalesce(F.sum("_value").over(frame), F.lit(0))
    out = cut.withColumn("_local", local).join(base, part)
    return out.select(*df.columns, (F.col("_base") + F.col("_local")).alias(name))


def append(df: DataFrame, order: list[str], payload: str = "payload", content_type: Column | None = None, schema_id: Column | None = None, next_seq: int = 0, offsets: bool = False) -> DataFrame:
    """Rows as single frames of a log: seq_no, flags, content_type, schema_id, payload_length and frame_bytes; with offsets
    also log_offset, the bytes of all these frames before."""
    length = F.octet_length(payload).cast("long")
    out = sequence(df, order, next_seq, total=("log_offset", length + S.FRAME_OVERHEAD) if offsets else None)
    return out.withColumns(
        {
            "flags": F.lit(0).cast("short"),
            "content_type": (F.lit(S.CONTENT_TYPES["unknown"]) if content_type is None else content_type).cast("short"),
            "schema_id": (F.lit(0) if schema_id is None else schema_id).cast("long"),
            "payload_length": length,
            "frame_bytes": length + S.FRAME_OVERHEAD,
        }
    )


def too_large(df: DataFrame, max_segment_bytes: int) -> DataFrame:
    """Rows whose frame cannot fit a segment: an append of them is refused."""
    return df.where(F.col("frame_bytes") > max_segment_bytes)
