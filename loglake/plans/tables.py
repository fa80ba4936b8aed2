"""The driver's tables as logs, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.operators.append import append

KINDS = {"purchase": 1, "click": 2, "signup": 3, "error": 255}
LOG_SQL = """log AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS seq_no, event_id, user_id, event_type, props, ts, value,
    CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 255 ELSE 0 END AS SMALLINT) AS content_type,
    user_id AS schema_id, CAST(strlen(props) AS BIGINT) AS payload_length, CAST(strlen(props) + 28 AS BIGINT) AS frame_bytes
  FROM events)"""
TEXT_SQL = """texts AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_no, doc_id, text, CAST(strlen(text) AS BIGINT) AS payload_length, CAST(strlen(text) + 28 AS BIGINT) AS frame_bytes
  FROM documents)"""


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


CREDIT = ("purchase", "signup", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_kind() -> Column:
    out = F.lit(0)
    for name, kind in KINDS.items():
        out = F.when(F.col("event_type") == name, kind).otherwise(out)
    return out


def event_log(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    """Events in time order as a log; the payload is props."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", "ts", "value")
    return append(e, ["ts", "event_id"], "props", event_kind(), F.col("user_id"), offsets=offsets)


def text_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by id as a log of payloads of very different sizes."""
    return append(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")


def segments_sql(source: str, cap: int) -> str:
    """CTEs placed (seq_no, frame_bytes, segment_id, byte_offset) and segments, by jumps from one segment to the next."""
    return f"""offs AS (SELECT *, CAST(sum(frame_bytes) OVER (ORDER BY seq_no) - frame_bytes AS BIGINT) AS log_offset FROM {source}),
chain(segment_id, opened) AS (
  SELECT 0, CAST(0 AS BIGINT) UNION ALL
  SELECT * FROM (SELECT c.segment_id + 1 AS segment_id, (SELECT min(o.log_offset) FROM offs o WHERE o.log_offset >= c.opened + {cap}) AS opened FROM chain c) WHERE opened IS NOT NULL
), placed AS (
  SELECT o.*, c.segment_id, o.log_offset - c.opened AS byte_offset FROM offs o ASOF JOIN chain c ON o.log_offset >= c.opened
), segments AS (
  SELECT segment_id, min(seq_no) AS first_seq, max(seq_no) AS last_seq, CAST(sum(frame_bytes) AS BIGINT) AS bytes, count(*) AS records FROM placed GROUP BY segment_id
)"""
