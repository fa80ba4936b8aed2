"""Header arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglake import schema as S


def is_block(flags: Column) -> Column:
    return flags.bitwiseAND(S.FLAG_BLOCK) != 0


def is_compressed(flags: Column) -> Column:
    return flags.bitwiseAND(S.FLAG_COMPRESSED) != 0


def algorithm(flags: Column) -> Column:
    """The algorithm's number, 0 for frames that are not compressed."""
    return F.when(is_compressed(flags), F.shiftright(flags.bitwiseAND(S.ALGORITHM_MASK), S.ALGORITHM_SHIFT)).otherwise(0)


def frame_bytes(payload_length: Column) -> Column:
    return payload_length.cast("long") + S.FRAME_OVERHEAD


def lane(key: Column, lanes: int) -> Column:
    """Floor modulo: negative keys go to a lane, too. Null without lanes."""
    return F.pmod(key, F.lit(lanes)).cast("int") if lanes else F.lit(None).cast("int")


def crc_valid(header: Column, payload: Column, crc: Column) -> Column:
    """Whether a frame's checksum (over header and stored payload) holds."""
    return F.crc32(F.concat(header, payload)) == crc


def error_code(size: Column, magic: Column, version: Column, payload_length: Column, crc_ok: Column, readable: Column) -> Column:
    """The first check a frame fails, in the reader's order; size: bytes that are left for it."""
    need = S.HEADER_BYTES + payload_length
    return (
        F.when(size < S.HEADER_BYTES, "TruncatedHeader")
        .when(magic != S.RECORD_MAGIC, "InvalidMagic")
        .when(version != S.VERSION, "InvalidVersion")
        .when(payload_length > S.MAX_PAYLOAD, "PayloadTooLarge")
        .when(size < need, "TruncatedPayload")
        .when(size < need + S.FOOTER_BYTES, "TruncatedFooter")
        .when(~crc_ok, "CrcMismatch")
        .when(~readable, "DecompressionFailed")
    )
