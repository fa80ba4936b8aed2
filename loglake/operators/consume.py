"""Pull consumers as predicates over the log: pages, seeks, cursors and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.errors import SeekBelowFloor


def page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The next `limit` frames past a cursor's seq_no; an empty result is the end of the log. Blocks stay whole."""
    return log.where(F.col("seq_no") > after).orderBy("seq_no").limit(limit)


def seek(segments: DataFrame, log: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (consumer, target): status ok, empty, beyond_tail or below_floor, the seq_no sought out, its segment, and
    the earliest there is. Segments are pruned by their first and last numbers before records are looked at."""
    bounds = segments.where("records > 0").agg(F.min("first_seq").alias("earliest"), F.max("last_seq").alias("tail"))
    asked = targets.crossJoin(F.broadcast(bounds))  # one row
    status = F.when(F.col("earliest").isNull(), "empty").when(F.col("target") > F.col("tail"), "beyond_tail").when(F.col("target") < F.col("earliest"), "below_floor").otherwise("ok")
    asked = asked.withColumn("status", status)
    live = F.broadcast(asked.where("status = 'ok'"))  # a row for each consumer asked for
    held = segments.select("segment_id", "last_seq").join(live, F.col("last_seq") >= F.col("target")).groupBy("consumer", "target").agg(F.min("segment_id").alias("segment_id"))
    found = log.join(F.broadcast(held), "segment_id").where("seq_no >= target").groupBy("consumer", "target", "segment_id").agg(F.min("seq_no").alias("seq_no"))
    return asked.join(found, ["consumer", "target"], "left").select("consumer", "target", "status", "segment_id", "seq_no", "earliest")


def seek_one(segments: DataFrame, target: int) -> int:
    """The segment a seek lands in; raises as the log does when the target is out of range."""
    r = segments.where("records > 0").agg(F.min("first_seq").alias("lo"), F.max("last_seq").alias("hi")).first()
    if r["lo"] is None or target > r["hi"]:
        raise IndexError(f"sequence number {target} is past the end of the log")
    if target < r["lo"]:
        raise SeekBelowFloor(target, r["lo"])
    return segments.where(F.col("last_seq") >= target).agg(F.min("segment_id")).first()[0]


def reset(segments: DataFrame, consumers: DataFrame) -> DataFrame:
    """Each consumer at the first record of the oldest segment; at zero in an empty log."""
    oldest = segments.where("records > 0").agg(F.min(F.struct("segment_id", "first_seq")).alias("o"))
    at = oldest.select(F.coalesce("o.segment_id", F.lit(0)).alias("segment_id"), F.coalesce("o.first_seq", F.lit(0)).alias("seq_no"))
    return consumers.select("consumer").crossJoin(F.broadcast(at)).withColumn("byte_offset", F.lit(0).cast("long"))  # one row


def _position(segment: str, offset: str) -> Column:
    return F.struct(F.col(segment).alias("segment_id"), F.col(offset).alias("byte_offset"))


def start_positions(cursors: DataFrame, consumers: DataFrame, segments: DataFrame, policy: Column) -> DataFrame:
    """Where each consumer starts: at its valid cursor, moved back to the tail if past it; without one at the oldest
    segment (policy from_beginning) or at the tail (from_tail)."""
    tail = segments.agg(F.max(F.struct("segment_id", "bytes")).alias("t"), F.min("segment_id").alias("oldest"))
    tail = tail.select(F.coalesce("t.segment_id", F.lit(0)).alias("tail_segment"), F.coalesce("t.bytes", F.lit(0)).cast("long").alias("tail_offset"), F.coalesce("oldest", F.lit(0)).alias("oldest"))
    held = cursors.select("consumer", F.struct("segment_id", "byte_offset").alias("held"))
    joined = consumers.join(held, "consumer", "left").crossJoin(F.broadcast(tail))  # one row
    end = _position("tail_segment", "tail_offset")
    fresh = F.when(policy == "from_tail", end).otherwise(F.struct(F.col("oldest").alias("segment_id"), F.lit(0).cast("long").alias("byte_offset")))
    at = F.when(F.col("held").isNull(), fresh).when(F.col("held") > end, end).otherwise(F.col("held"))
    return joined.withColumn("_at", at).select("consumer", F.col("_at.segment_id").alias("segment_id"), F.col("_at.byte_offset").alias("byte_offset"), F.col("held").isNotNull().alias("resumed"))


def flush_points(reads: DataFrame, every: int) -> DataFrame:
    """Reads (consumer, nth from 1, seq_no) after which the cursor is written, by the count of reads alone."""
    return reads.where(F.col("nth") % every == 0)


def lag(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records between each consumer's last read and the tail; consumers that have read nothing are left out."""
    tail = log.agg(F.max("seq_no").alias("tail"))
    return cursors.where("seq_no is not null").crossJoin(F.broadcast(tail)).select("consumer", F.greatest(F.lit(0), F.coalesce("tail", F.lit(0)) - F.col("seq_no")).cast("long").alias("lag"))  # one row
