"""Tables of a log as Spark schemas, the wire format's fixed values, and settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Fixed values of the wire format (little-endian).
RECORD_MAGIC = 0x4C434550
CHECKPOINT_MAGIC = 0x504B4843
CURSOR_MAGIC = 0x53525543
VERSION = 1
HEADER_BYTES, FOOTER_BYTES = 24, 4
FRAME_OVERHEAD = HEADER_BYTES + FOOTER_BYTES
FLAG_BLOCK, FLAG_COMPRESSED, ALGORITHM_MASK, ALGORITHM_SHIFT = 1, 2, 12, 2
ALGORITHMS = {"none": 0, "brotli": 1}
CONTENT_TYPES = {"unknown": 0, "json": 1, "message_pack": 2, "protobuf": 3, "custom": 255}
ERRORS = ("TruncatedHeader", "InvalidMagic", "InvalidVersion", "PayloadTooLarge", "TruncatedPayload", "TruncatedFooter", "CrcMismatch", "DecompressionFailed")
MAX_PAYLOAD = 2**31 - 1
MAX_SEGMENT_ID = 999_999
MAX_NAME_BYTES = 256

FRAME = T.StructType(
    [
        T.StructField("segment_id", T.IntegerType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("seq_no", T.LongType()),
        T.StructField("version", T.ShortType()),
        T.StructField("flags", T.ShortType()),
        T.StructField("content_type", T.ShortType()),
        T.StructField("schema_id", T.LongType()),
        T.StructField("payload_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("frame_bytes", T.LongType()),
        T.StructField("error_code", T.StringType()),
    ]
)
CURSOR = T.StructType([T.StructField("consumer", T.StringType()), T.StructField("segment_id", T.IntegerType()), T.StructField("byte_offset", T.LongType()), T.StructField("seq_no", T.LongType())])


@dataclass(frozen=True)
class Settings:
    """What a log runs with; check() holds at start."""

    path: str
    max_segment_bytes: int = 64 << 20
    cursor_flush_records: int = 1_000
    cursor_flush_seconds: float = 5.0
    durability: str = "batched"
    fsync_interval_ms: int = 100
    lane_capacity: int = 4_096
    max_batch_bytes: int = 64 << 20
    backpressure: str = "block"
    drain_timeout_ms: int = 30_000
    retention: str = "consumer_gated"
    retention_max_age_ms: int = 7 * 24 * 3_600_000
    retention_max_bytes: int = 1 << 30
    gc_interval_ms: int = 60_000
    gc_stop_timeout_ms: int = 5_000
    meter: str = "loglake"
    compression: str = "none"
    missing_cursor: str = "from_beginning"

    def check(self) -> Settings:
        choices = {"durability": ("none", "batched", "strict"), "backpressure": ("block", "drop", "spill"), "retention": ("consumer_gated", "time_based", "size_based"), "compression": tuple(ALGORITHMS), "missing_cursor": ("from_beginning", "from_tail")}
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is {getattr(self, name)!r}; choose one of {', '.join(allowed)}")
        least = {f.name: 0 if f.name in ("drain_timeout_ms", "cursor_flush_seconds") else 1 for f in fields(self) if f.type in ("int", "float")}
        for name, low in least.items():
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be {low} or more")
        if not self.path:
            raise ValueError("path is required")
        return self
