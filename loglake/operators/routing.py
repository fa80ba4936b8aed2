"""Routing records to the lanes of a consumer's sinks: no shuffle, only expressions over each row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake.functions.header import lane

UNROUTED = "*"


def broadcast(log: DataFrame, sinks: list[str]) -> DataFrame:
    """Every record to every sink."""
    return log.withColumn("sink", F.explode(F.array(*map(F.lit, sinks)).cast("array<string>")))


def _wanted(filters: Mapping[str, int | None]) -> Column:
    """The sinks of a row: those without a content type, and those whose content type it has."""
    each = [F.when(F.lit(True) if kind is None else F.col("content_type") == kind, F.lit(sink)) for sink, kind in filters.items()]
    return F.filter(F.array(*each).cast("array<string>"), lambda s: s.isNotNull())


def by_content_type(log: DataFrame, filters: Mapping[str, int | None]) -> DataFrame:
    """Each record to the sinks whose content type it has (None: any)."""
    return log.withColumn("sink", F.explode(_wanted(filters)))


def unrouted(log: DataFrame, filters: Mapping[str, int | None]) -> DataFrame:
    """Records that no sink wants; they count as dropped at UNROUTED."""
    return log.where(F.size(_wanted(filters)) == 0).withColumn("sink", F.lit(UNROUTED))


def by_hash(log: DataFrame, sinks: list[str], key: Column) -> DataFrame:
    """Each record to the sink numbered key modulo their count, never negative; nothing without sinks."""
    if not sinks:
        return log.withColumn("sink", F.lit(None).cast("string")).limit(0)
    return log.withColumn("sink", F.element_at(F.array(*map(F.lit, sinks)), lane(key, len(sinks)) + 1))
