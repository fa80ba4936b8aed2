"""Blocks: many entries in one frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglake import schema as S


def payload_bytes(entries: Column) -> Column:
    """Size of a block's payload: a count, and each entry with its length."""
    return F.aggregate(entries, F.lit(4).cast("long"), lambda n, e: n + 4 + F.octet_length(e))


def pack(df: DataFrame, block: str, position: str, entry: str, inherited: tuple[str, ...] = ()) -> DataFrame:
    """One row a block: its entries in the order of position, how many, and the payload's size; `inherited` columns are
    the first entry's. A block is bounded by the frame it has to fit."""
    kept = F.struct(F.col(position), F.col(entry), *inherited)
    packed = df.groupBy(block).agg(F.array_sort(F.collect_list(kept)).alias("_all"))
    entries = F.transform("_all", lambda e: e[entry])
    return packed.select(block, entries.alias("entries"), *(F.col("_all")[0][c].alias(c) for c in inherited)).select("*", F.size("entries").cast("long").alias("entry_count"), payload_bytes(F.col("entries")).alias("payload_length"))


def explode(frames: DataFrame, entries: str = "entries") -> DataFrame:
    """A row for each entry, with its block_pos; flags are cleared and payload_length is the entry's own."""
    others = [c for c in frames.columns if c not in (entries, "flags", "payload", "payload_length", "entry_count")]
    out = frames.select(*others, F.posexplode(entries).alias("block_pos", "payload"))
    return out.withColumns({"flags": F.lit(0).cast("short"), "payload_length": F.octet_length("payload").cast("long")})


def decoded(payload: Column) -> Column:
    """Entries of a block's binary payload in SQL alone: stops at the first that is malformed."""
    size = F.octet_length(payload)

    def number(at: Column) -> Column:
        byte = lambda i: F.conv(F.hex(F.substring(payload, at + i + 1, F.lit(1))), 16, 10).cast("long")
        return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216

    start = F.struct(F.lit(4).cast("int").alias("at"), F.array().cast("array<binary>").alias("found"), F.lit(True).alias("ok"))

    def step(state: Column, _: Column) -> Column:
        n = number(state["at"])
        fits = state["ok"] & (state["at"] + 4 <= size) & (n <= S.MAX_PAYLOAD) & (state["at"] + 4 + n <= size)
        taken = F.array_append(state["found"], F.substring(payload, state["at"] + 5, n.cast("int")))
        return F.when(fits, F.struct((state["at"] + 4 + n).cast("int").alias("at"), taken.alias("found"), F.lit(True).alias("ok"))).otherwise(F.struct(state["at"].alias("at"), state["found"].alias("found"), F.lit(False).alias("ok")))

    count = F.when((size >= 4) & (number(F.lit(0)) <= S.MAX_PAYLOAD), F.least(number(F.lit(0)), F.floor((size - 4) / 4))).otherwise(0)
    turns = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(turns, start, step, lambda s: s["found"])
