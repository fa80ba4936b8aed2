"""What lanes of bounded capacity do with a batch: a deterministic model over routed rows (sink, batch, seq_no, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lane_positions(routed: DataFrame) -> DataFrame:
    """routed with position: the rank of a row in its lane and batch, from 1. A batch is bounded by the source."""
    return routed.withColumn("position", F.row_number().over(W.partitionBy("sink", "batch").orderBy("seq_no", "block_pos")))


def kept(routed: DataFrame, capacity: int) -> DataFrame:
    """Policy drop: the first `capacity` rows of each lane and batch."""
    return lane_positions(routed).where(F.col("position") <= capacity)


def dropped(routed: DataFrame, capacity: int) -> DataFrame:
    """Policy drop: how many rows each sink lost."""
    return lane_positions(routed).where(F.col("position") > capacity).groupBy("sink").agg(F.count("*").alias("dropped"))


def spilled(routed: DataFrame, capacity: int) -> DataFrame:
    """Policy spill: all rows, those past the first overflow of their lane marked as spilled. Delivery order within a
    lane stays that of (seq_no, block_pos): once a lane spills, later rows wait behind."""
    marked = lane_positions(routed)
    first = marked.where(F.col("position") > capacity).groupBy("sink", "batch").agg(F.min(F.struct("seq_no", "block_pos")).alias("_first"))
    return marked.join(first, ["sink", "batch"], "left").withColumn("spilled", F.coalesce(F.struct("seq_no", "block_pos") >= F.col("_first"), F.lit(False))).drop("_first", "position")


def orphans(spill_files: DataFrame, registered: DataFrame) -> DataFrame:
    """Spill files (consumer, sink) of sinks that are not registered; they are deleted at start."""
    return spill_files.join(registered.select("consumer", "sink"), ["consumer", "sink"], "left_anti")


def deduplicated(delivered: DataFrame) -> DataFrame:
    """At-least-once deliveries as exactly once: one row for each sink and entry."""
    return delivered.dropDuplicates(["sink", "seq_no", "block_pos"])
