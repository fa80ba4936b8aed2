"""Which segments retention deletes; the active one never goes. Segments are few: one for each max_segment_bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _with_active(segments: DataFrame) -> DataFrame:
    return segments.crossJoin(F.broadcast(segments.agg(F.max("segment_id").alias("active"))))  # one row


def consumer_gated(segments: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Segments that every consumer (consumer, segment_id) has passed; none without consumers."""
    least = watermarks.agg(F.min("segment_id").alias("least"))
    return _with_active(segments).crossJoin(F.broadcast(least)).where("segment_id < least and segment_id < active").select(*segments.columns)  # one row


def time_based(segments: DataFrame, now: Column, max_age: Column) -> DataFrame:
    """Segments last written before now - max_age."""
    return _with_active(segments).where((F.col("last_write") < now - max_age) & (F.col("segment_id") < F.col("active"))).select(*segments.columns)


def size_based(segments: DataFrame, max_bytes: int) -> DataFrame:
    """The oldest segments, until what is left (the active one included) is at most max_bytes."""
    before = F.coalesce(F.sum("bytes").over(W.orderBy("segment_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = segments.agg(F.sum("bytes").alias("total"))
    counted = _with_active(segments).crossJoin(F.broadcast(total)).withColumn("before", before)  # one row
    return counted.where((F.col("total") - F.col("before") > max_bytes) & (F.col("segment_id") < F.col("active"))).select(*segments.columns)
