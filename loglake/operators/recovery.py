"""What a start after a crash keeps: the records before the first bad one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_prefix(frames: DataFrame, checkpoint: tuple[int, int] | None = None) -> DataFrame:
    """Frames (segment_id, byte_offset, error_code, ...) before the first bad one; those before the checkpoint's place
    are taken as good. One aggregate finds the first bad place, a filter does the rest: no ordering of the log."""
    place = F.struct("segment_id", "byte_offset")
    bad = F.col("error_code").isNotNull()
    if checkpoint is not None:
        bad = bad & (place >= F.struct(F.lit(checkpoint[0]), F.lit(checkpoint[1]).cast("long")))
    first = frames.where(bad).agg(F.min(place).alias("first_bad"))
    return frames.crossJoin(F.broadcast(first)).where(F.col("first_bad").isNull() | (place < F.col("first_bad"))).drop("first_bad")  # one row


def next_seq(valid: DataFrame, checkpoint_seq: int | None = None) -> DataFrame:
    """The number the next record gets: after the last valid one, else after the checkpoint's, else 0."""
    after = F.lit(None).cast("long") if checkpoint_seq is None else F.lit(checkpoint_seq + 1).cast("long")
    return valid.agg(F.coalesce(F.max("seq_no") + 1, after, F.lit(0)).cast("long").alias("next_seq"))


def truncated_bytes(frames: DataFrame, checkpoint: tuple[int, int] | None = None) -> DataFrame:
    """For each segment its bytes, those that recovery keeps, and those it would cut off."""
    kept = valid_prefix(frames, checkpoint).groupBy("segment_id").agg(F.sum("frame_bytes").alias("valid_bytes"))
    whole = frames.groupBy("segment_id").agg(F.sum("frame_bytes").alias("file_bytes"))
    valid = F.coalesce("valid_bytes", F.lit(0)).cast("long")
    return whole.join(kept, "segment_id", "left").select("segment_id", F.col("file_bytes").cast("long"), valid.alias("valid_bytes"), (F.col("file_bytes") - valid).cast("long").alias("truncated_bytes"))
