"""Counters, gauges and histograms of a log as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_totals(entries: DataFrame, payload: str = "payload") -> DataFrame:
    """Records and payload bytes written; a block counts its entries."""
    return entries.agg(F.count("*").alias("records_total"), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("bytes_total"))


def segment_totals(segments: DataFrame) -> DataFrame:
    """Segment files, their bytes, and rollovers of the run that wrote them."""
    return segments.agg(F.count("*").alias("segment_count"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("segment_bytes"), F.coalesce(F.max("segment_id") - F.min("segment_id"), F.lit(0)).cast("long").alias("rollovers"))


def batch_sizes(log: DataFrame, batch: str) -> DataFrame:
    """Histogram of records per flush; a block counts as one."""
    sizes = log.groupBy(batch).agg(F.count("*").alias("batch_size"))
    return sizes.groupBy("batch_size").agg(F.count("*").alias("batches"))


def lane_depth(routed: DataFrame, delivered: DataFrame) -> DataFrame:
    """Rows of each sink that wait in its lane."""
    out = routed.groupBy("sink").agg(F.count("*").alias("routed")).join(delivered.groupBy("sink").agg(F.count("*").alias("done")), "sink", "left")
    return out.select("sink", (F.col("routed") - F.coalesce("done", F.lit(0))).alias("lane_depth"))


def progress(query) -> dict:
    """Live figures of a streaming query: flushes, rows, and milliseconds of the last batch."""
    last = query.lastProgress or {}
    return {"flushes": last.get("batchId", -1) + 1, "read_rate": last.get("numInputRows", 0), "fsync_duration": dict(last.get("durationMs", {})).get("walCommit", 0)}
