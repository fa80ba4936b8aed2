import random

import pytest
from pyspark.sql import functions as F

from loglake.errors import SeekBelowFloor
from loglake.functions import wire
from loglake.operators import append, backpressure, blocks, consume, ledger, recovery, retention, routing, segments


def log_of(spark, sizes):
    return spark.createDataFrame([(i, s + 28) for i, s in enumerate(sizes)], "seq_no long, frame_bytes long").repartition(3)


def ids(df):
    return [r["segment_id"] for r in df.orderBy("seq_no").collect()]


def fold(sizes, cap):
    out, segment, used = [], 0, 0
    for s in sizes:
        if used >= cap:
            segment, used = segment + 1, 0
        out.append((segment, used))
        used += s + 28
    return out


@pytest.mark.parametrize("sizes, cap, want", [([4] * 3, 35, [0, 0, 1]), ([5] * 5, 35, [0, 0, 1, 1, 2]), ([4] * 4, 32, [0, 1, 2, 3]), ([4] * 6, 96, [0, 0, 0, 1, 1, 1])])
def test_soft_cap(spark, sizes, cap, want):
    assert ids(segments.assign(log_of(spark, sizes), cap)) == want


@pytest.mark.parametrize("chunk_caps", [1, 2, 16])
def test_segments_equal_the_fold(spark, chunk_caps):
    r = random.Random(chunk_caps)
    sizes = [r.choice([0, 3, 50, 400, 5000]) for _ in range(700)]
    got = segments.assign(log_of(spark, sizes), 900, chunk_bytes=900 * chunk_caps).orderBy("seq_no").collect()
    assert [(x["segment_id"], x["byte_offset"]) for x in got] == fold(sizes, 900)


def test_segments_of_an_empty_log(spark):
    assert segments.assign(log_of(spark, [1]).where("seq_no < 0"), 100).count() == 0


def test_sequence_with_ties_nulls_and_start(spark):
    rows = [(random.Random(i).choice([None, 1, 1, 1, 2, 9]), i) for i in range(500)]
    got = append.sequence(spark.createDataFrame(rows, "k int, id int").repartition(5), ["k", "id"], start=10).orderBy("seq_no").collect()
    assert [r["seq_no"] for r in got] == list(range(10, 510))
    assert [(r["k"], r["id"]) for r in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_sequence_of_nothing(spark):
    assert append.sequence(spark.createDataFrame([], "k int"), ["k"]).count() == 0


def test_running_total_over_blocks_and_null_keys(spark):
    rows = [(i, random.Random(i).choice(["a", "a", "a", None, "b"]), i % 7) for i in range(300)]
    got = append.running_total(spark.createDataFrame(rows, "seq_no long, k string, v long"), F.col("v"), "t", keys=("k",), block=16).orderBy("seq_no").collect()
    seen: dict = {}
    for r, (_, k, v) in zip(got, rows):
        seen[k] = seen.get(k, 0) + v
        assert r["t"] == seen[k]


def test_blocks_in_sql(spark):
    entries = [b"hello", b"", b"\xff" * 300]
    data = wire.encode_block(entries)
    rows = [(data,), (b"\x01",), (data[:-1],), (None,), (b"\xff\xff\xff\xff\0\0\0\0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p binary").select(blocks.decoded(F.col("p")).alias("e")).collect()]
    assert [[bytes(x) for x in e] if e is not None else None for e in got] == [entries, [], entries[:2], [], []]


def test_explode_inherits(spark):
    f = spark.createDataFrame([(5, 1, 1, 42, [b"x", b"yy"])], "seq_no long, flags short, content_type short, schema_id long, entries array<binary>").withColumn("payload_length", F.lit(15))
    got = blocks.explode(f).orderBy("block_pos").collect()
    assert [(r["seq_no"], r["block_pos"], r["flags"], r["content_type"], r["schema_id"], r["payload_length"]) for r in got] == [(5, 0, 0, 1, 42, 1), (5, 1, 0, 1, 42, 2)]


def test_routes(spark):
    log = spark.createDataFrame([(-1, 1), (0, 3), (1, 2), (7, None)], "key int, content_type int")
    assert {r["key"]: r["sink"] for r in routing.by_hash(log, ["a", "b", "c"], F.col("key")).collect()} == {-1: "c", 0: "a", 1: "b", 7: "b"}
    assert routing.by_hash(log, [], F.col("key")).count() == 0
    assert sorted((r["key"], r["sink"]) for r in routing.by_content_type(log, {"j": 1, "any": None}).collect()) == [(-1, "any"), (-1, "j"), (0, "any"), (1, "any"), (7, "any")]
    assert sorted(r["key"] for r in routing.unrouted(log, {"j": 1}).collect()) == [0, 1, 7]
    assert routing.broadcast(log, ["x", "y"]).count() == 8


def test_seek(spark):
    log = segments.assign(log_of(spark, [4] * 20), 96)
    table = segments.statistics(log)
    assert consume.seek_one(table, 10) == 3
    with pytest.raises(IndexError):
        consume.seek_one(table, 9999)
    with pytest.raises(SeekBelowFloor) as e:
        consume.seek_one(table.where("segment_id > 0"), 0)
    assert e.value.earliest == 3
    got = consume.seek(table.where("segment_id > 99"), log, spark.createDataFrame([("a", 1)], "consumer string, target long")).first()
    assert (got["status"], got["seq_no"]) == ("empty", None)


def test_retention(spark):
    table = spark.createDataFrame([(i, 100) for i in range(4)], "segment_id int, bytes long")
    gone = lambda df: sorted(r["segment_id"] for r in df.collect())
    marks = lambda *xs: spark.createDataFrame([(str(i), x) for i, x in enumerate(xs)], "consumer string, segment_id int")
    assert gone(retention.consumer_gated(table, marks(3, 0))) == []
    assert gone(retention.consumer_gated(table, marks(3, 9))) == [0, 1, 2]
    assert gone(retention.consumer_gated(table, marks())) == []
    assert gone(retention.size_based(table, 250)) == [0, 1] and gone(retention.size_based(table, 0)) == [0, 1, 2]


def test_recovery(spark):
    rows = [(0, 0, 0, 40, None), (0, 40, 1, 40, "CrcMismatch"), (1, 0, 2, 40, None)]
    frames = spark.createDataFrame(rows, "segment_id int, byte_offset long, seq_no long, frame_bytes long, error_code string")
    assert [r["seq_no"] for r in recovery.valid_prefix(frames).collect()] == [0]
    assert recovery.valid_prefix(frames, (1, 0)).count() == 3
    assert recovery.next_seq(recovery.valid_prefix(frames)).first()[0] == 1
    assert recovery.next_seq(frames.where("false"), 6).first()[0] == 7 and recovery.next_seq(frames.where("false")).first()[0] == 0


def test_spill_keeps_order(spark):
    routed = spark.createDataFrame([("s", 0, i, 0) for i in range(6)], "sink string, batch int, seq_no int, block_pos int")
    assert [r["spilled"] for r in backpressure.spilled(routed, 4).orderBy("seq_no").collect()] == [False] * 4 + [True] * 2
    assert backpressure.kept(routed, 4).count() == 4 and backpressure.dropped(routed, 4).first()["dropped"] == 2


def test_ledger_payload(spark):
    log = spark.createDataFrame([(0, b'{"accountId":"ACC-001","amount":10.25,"entryType":"CR","reference":"r","postedAt":"2026-01-01T00:00:00Z"}')], "seq_no long, payload binary")
    r = ledger.decoded(log).first()
    assert (r["accountId"], str(r["amount"]), r["entryType"]) == ("ACC-001", "10.25", "CR")
