import os
import random

import pytest
from pyspark.sql import functions as F

from loglake.errors import DrainFailed, InvalidState
from loglake.functions import wire
from loglake.operators import segments
from loglake.schema import Settings
from loglake.sources import segments as source
from loglake.streaming.pipeline import LogPipeline


def rows(spark, n, kind=1, start=0):
    return spark.createDataFrame([(f"{start + i:04d}".encode(), kind if kind is not None else i % 3, start + i) for i in range(n)], "payload binary, content_type int, schema_id long")


def filled(spark, path, n=20, cap=96):
    with LogPipeline(spark, Settings(str(path), max_segment_bytes=cap, fsync_interval_ms=50)) as p:
        p.start()
        p.append(rows(spark, n, None), ["schema_id"])
    return Settings(str(path), max_segment_bytes=cap, fsync_interval_ms=50)


class Collected:
    def __init__(self):
        self.rows = []

    def __call__(self, batch, batch_id):
        self.rows += [(r["seq_no"], r["block_pos"], bytes(r["payload"])) for r in batch.collect()]


def test_append_scan_and_go_on(spark, tmp_path):
    s = filled(spark, tmp_path)
    with LogPipeline(spark, s) as p:
        p.start()
        p.append(rows(spark, 5, start=20), ["schema_id"])
        got = p.frames().orderBy("seq_no").collect()
    assert [r["seq_no"] for r in got] == list(range(25)) and all(r["error_code"] is None for r in got)
    assert bytes(got[24]["payload"]) == b"0024" and [r["segment_id"] for r in got] == [i // 3 for i in range(25)]


def test_small_segments_share_a_partition():
    spans = [source.Span(i, "", 0, n) for i, n in enumerate([100] * 50 + [source.PACK_BYTES * 2, 100])]
    got = [p.value for p in source.packed(spans)]
    assert [x for p in got for x in p] == spans and source.packed([])[0].value == []
    assert [len(p) for p in got] == [31, 19, 1, 1]


def test_bisection_keeps_what_reading_every_first_number_keeps():
    r = random.Random(5)
    for _ in range(2000):
        firsts = sorted(r.sample(range(1, 60), r.randrange(0, 12)))
        seen = [None if r.random() < 0.3 else n for n in firsts]
        reader = source.SegmentReader({"path": "/"})
        reader._first_seq = lambda _, file: seen[file]
        reader.low, reader.high = r.randrange(-1, 62), r.randrange(-1, 62)
        kept = [i for i, *_ in reader._within([(i, i, 1) for i in range(len(seen))])]
        nexts = firsts[1:] + [1 << 62]
        need = {i for i, (a, b) in enumerate(zip(firsts, nexts)) if a <= reader.high and b > reader.low and reader.low <= reader.high}
        assert need <= set(kept)
        if None not in seen and need:
            assert need == set(kept)


def test_source_prunes_and_reports_corruption(spark, tmp_path):
    filled(spark, tmp_path)
    frames = spark.read.format("loglake").option("path", str(tmp_path)).load()
    assert [r["seq_no"] for r in frames.where("seq_no >= 17").orderBy("seq_no").collect()] == [17, 18, 19]
    reader = source.SegmentReader({"path": str(tmp_path)})
    reader.low = 17
    assert [x.segment for p in reader.partitions() for x in p.value] == [5, 6]
    files = source.list_segments(str(tmp_path))
    with open(files[-1][1], "r+b") as f:
        f.seek(-4, os.SEEK_END)
        f.write(b"\xde\xad\xbe\xef")
    with open(files[0][1], "ab") as f:
        f.write(wire.encode_frame(b"x", 1)[:5])
    errors = {(r["segment_id"], r["error_code"]) for r in frames.where("error_code is not null").collect()}
    assert errors == {(0, "TruncatedHeader"), (6, "CrcMismatch")}
    (tmp_path / "segments" / "notes.txt").write_text("x")
    assert len(source.list_segments(str(tmp_path))) == len(files)


def test_push_consumers(spark, tmp_path):
    s = filled(spark, tmp_path)
    sinks = {k: Collected() for k in ("b0", "b1", "j", "p", "h0", "h1")}
    with LogPipeline(spark, s) as p:
        p.register_consumer("all")
        p.add_sink("all", "b0", sinks["b0"])
        p.add_sink("all", "b1", sinks["b1"])
        p.register_consumer("kinds")
        p.add_sink("kinds", "j", sinks["j"], content_type=1)
        p.add_sink("kinds", "p", sinks["p"], content_type=3)
        p.register_consumer("hashed")
        p.add_sink("hashed", "h0", sinks["h0"], key=F.col("seq_no"))
        p.add_sink("hashed", "h1", sinks["h1"], key=F.lit(0))
        with pytest.raises(InvalidState):
            p.add_sink("all", "x", sinks["j"], content_type=1)
        with pytest.raises(InvalidState):
            p.register_consumer("all")
        p.start()
        with pytest.raises(InvalidState):
            p.register_consumer("late")
        p.stop()
        assert p.state == "stopped" and p.dropped["kinds", "*"] == 13
    seqs = {k: [x[0] for x in v.rows] for k, v in sinks.items()}
    assert seqs["b0"] == seqs["b1"] == list(range(20))
    assert seqs["j"] == [i for i in range(20) if i % 3 == 1] and seqs["p"] == []
    assert seqs["h0"] == list(range(0, 20, 2)) and seqs["h1"] == list(range(1, 20, 2))


def test_consumers_resume_and_see_only_what_is_new(spark, tmp_path):
    s = filled(spark, tmp_path, 6)
    for want in (list(range(6)), [6, 7]):
        got = Collected()
        with LogPipeline(spark, s) as p:
            p.register_consumer("c")
            p.add_sink("c", "s", got)
            p.start()
            if want[0]:
                p.append(rows(spark, 2, start=6), ["schema_id"])
            p.stop()
        assert [x[0] for x in got.rows] == want


def test_blocks_are_exploded_for_push_and_whole_for_pull(spark, tmp_path):
    got = Collected()
    s = Settings(str(tmp_path), fsync_interval_ms=50)
    with LogPipeline(spark, s) as p:
        p.register_consumer("pull")
        p.register_consumer("push")
        p.add_sink("push", "s", got)
        p.start()
        p.append(rows(spark, 5).withColumn("block", F.floor(F.col("schema_id") / 3)), ["schema_id"], block="block")
        pulled = p.read_next("pull", 9)
        p.stop()
    assert got.rows == [(0, 0, b"0000"), (0, 1, b"0001"), (0, 2, b"0002"), (1, 0, b"0003"), (1, 1, b"0004")]
    assert [wire.decode_block(bytes(r["payload"])) for r in pulled] == [[b"0000", b"0001", b"0002"], [b"0003", b"0004"]]


def test_pull_seek_and_reset(spark, tmp_path):
    s = filled(spark, tmp_path, 10)
    with LogPipeline(spark, s) as p:
        p.register_consumer("slow")
        p.start()
        assert [r["seq_no"] for r in p.read_next("slow", 2)] == [0, 1]
        p.stop()
        p.register_consumer("slow")
        p.start()
        assert [r["seq_no"] for r in p.read_next("slow", 1)] == [2]
        p.stop()
        with pytest.raises(InvalidState):
            p.seek_consumer("slow", 8)
        p.register_consumer("slow")
        p.seek_consumer("slow", 8)
        with pytest.raises(IndexError):
            p.seek_consumer("slow", 9999)
        p.start()
        assert [r["seq_no"] for r in p.read_next("slow", 5)] == [8, 9] and p.read_next("slow") == []
        p.stop()
        p.register_consumer("slow")
        p.reset_consumer("slow")
        p.start()
        assert [r["seq_no"] for r in p.read_next("slow", 1)] == [0]


def test_missing_cursor_from_tail(spark, tmp_path):
    filled(spark, tmp_path, 5)
    s = Settings(str(tmp_path), max_segment_bytes=96, missing_cursor="from_tail")
    with LogPipeline(spark, s) as p:
        p.register_consumer("c")
        p.start()
        assert p.read_next("c") == []
        p.append(rows(spark, 3, start=5), ["schema_id"])
        assert [r["seq_no"] for r in p.read_next("c", 9)] == [5, 6, 7]


def test_failing_sink_puts_the_log_in_error(spark, tmp_path):
    s = filled(spark, tmp_path, 3)

    def broken(batch, batch_id):
        raise RuntimeError("no")

    p = LogPipeline(spark, s)
    p.register_consumer("c")
    p.add_sink("c", "s", broken)
    p.start()
    with pytest.raises(DrainFailed):
        p.stop()
    assert p.state == "error"
    with pytest.raises(InvalidState):
        p.start()


def test_oversized_record_is_refused(spark, tmp_path):
    with LogPipeline(spark, Settings(str(tmp_path), max_segment_bytes=30)) as p:
        p.start()
        with pytest.raises(ValueError):
            p.append(rows(spark, 1), ["schema_id"])


def test_checkpoint_and_cursor_files(spark, tmp_path):
    path = str(tmp_path)
    assert source.read_checkpoint(path) == (None, "CheckpointMissing") and source.read_cursor(path, "c") == (None, "CursorMissing")
    source.write_checkpoint(path, 1, 2, 3, 4)
    source.write_cursor(path, "c", 1, 2, 3)
    assert source.read_checkpoint(path) == ((1, 2, 3, 4), None) and source.read_cursor(path, "c") == ((1, 2, 3), None)


def test_binary_and_table_agree(spark, tmp_path):
    log = spark.range(50).select(F.col("id").alias("seq_no"), F.repeat(F.lit("ab"), F.col("id").cast("int")).cast("binary").alias("payload"))
    log = segments.assign(log.withColumn("frame_bytes", F.octet_length("payload").cast("long") + 28), 300)
    source.write_log(log, str(tmp_path))
    back = spark.read.format("loglake").option("path", str(tmp_path)).load()
    key = lambda df: [tuple(r) for r in df.select("seq_no", "segment_id", F.col("byte_offset").cast("long"), "payload").orderBy("seq_no").collect()]
    assert key(back) == key(log)


def test_garbage_collection(spark, tmp_path):
    filled(spark, tmp_path, 20)
    s = Settings(str(tmp_path), max_segment_bytes=96)
    with LogPipeline(spark, s) as p:
        p.register_consumer("slow")
        p.register_consumer("fast")
        p.add_sink("fast", "s", Collected())
        p.start()
        p.queries["fast"].processAllAvailable()
        assert p.collect_garbage() == []  # slow has read nothing
        assert [r["seq_no"] for r in p.read_next("slow", 7)] == list(range(7))
        assert p.collect_garbage() == [0, 1]
        p.stop()
    with LogPipeline(spark, s) as p:
        p.start()
        assert p.collect_garbage() == []  # no consumers
    by_size = Settings(str(tmp_path), max_segment_bytes=96, retention="size_based", retention_max_bytes=200)
    assert LogPipeline(spark, by_size).collect_garbage() == [2, 3, 4]
    by_age = Settings(str(tmp_path), max_segment_bytes=96, retention="time_based", retention_max_age_ms=1000)
    assert LogPipeline(spark, by_age).collect_garbage() in ([], [5])
    assert LogPipeline(spark, by_age).collect_garbage(now=4e9) in ([5], [])
    assert len(source.list_segments(str(tmp_path))) == 1


def test_recovery_after_a_cut_tail(spark, tmp_path):
    s = filled(spark, tmp_path, 6, cap=1 << 20)
    last = source.list_segments(str(tmp_path))[-1]
    with open(last[1], "r+b") as f:
        f.truncate(last[2] - 3)
    with LogPipeline(spark, s) as p:
        os.remove(tmp_path / "checkpoint.dat")
        assert p.recovered() == {"segment": 0, "offset": 160, "next_seq": 5, "truncated_bytes": 29}
        p.start()
        assert p.meter.gauge("recovery.truncated_bytes") == 29 and p.meter.count("recovery.count") == 1 and p.meter.gauge("recovery.duration") > 0
        p.append(rows(spark, 2, start=50), ["schema_id"])
        assert [(r["seq_no"], r["error_code"]) for r in p.frames().orderBy("seq_no").collect()] == [(i, None) for i in range(7)]


def test_drain_timeout(spark, tmp_path):
    import time

    from loglake.errors import DrainTimeout

    filled(spark, tmp_path, 3)
    p = LogPipeline(spark, Settings(str(tmp_path), drain_timeout_ms=300))
    p.register_consumer("c")
    p.add_sink("c", "s", lambda batch, batch_id: time.sleep(8))
    p.start()
    with pytest.raises(DrainTimeout):
        p.stop()


def test_full_lanes_drop(spark, tmp_path):
    filled(spark, tmp_path, 10)
    got = Collected()
    with LogPipeline(spark, Settings(str(tmp_path), backpressure="drop", lane_capacity=4)) as p:
        p.register_consumer("c")
        p.add_sink("c", "s", got)
        p.start()
        p.stop()
        assert [x[0] for x in got.rows] == [0, 1, 2, 3] and p.dropped == {("c", "s"): 6} and p.meter.count("sink.dropped_total", sink="s") == 6


def test_full_lanes_spill_and_keep_their_order(spark, tmp_path):
    filled(spark, tmp_path, 10)
    (tmp_path / "spill" / "gone-s").mkdir(parents=True)
    got, seen = Collected(), []

    def sink(batch, batch_id):
        seen.append(os.listdir(tmp_path / "spill"))
        got(batch, batch_id)

    with LogPipeline(spark, Settings(str(tmp_path), backpressure="spill", lane_capacity=4)) as p:
        p.register_consumer("c")
        p.add_sink("c", "s", sink)
        p.start()
        p.stop()
        assert [x[0] for x in got.rows] == list(range(10)) and p.meter.count("sink.spilled_total", sink="s") == 6
    assert seen == [["c-s"]] and os.listdir(tmp_path / "spill") == []


def test_batches_are_bounded_and_go_on_after_a_restart(spark, tmp_path):
    filled(spark, tmp_path, 20)
    sizes, got = [], Collected()

    def sink(batch, batch_id):
        sizes.append(batch.count())
        got(batch, batch_id)

    for n in (20, 7):
        with LogPipeline(spark, Settings(str(tmp_path), max_segment_bytes=96, max_batch_bytes=200, fsync_interval_ms=20)) as p:
            p.register_consumer("c")
            p.add_sink("c", "s", sink)
            p.start()
            if n == 7:
                p.append(rows(spark, 7, start=20), ["schema_id"])
            p.stop()
    assert [x[0] for x in got.rows] == list(range(27)) and max(sizes) <= 6


def test_checkpoint_resume_and_flush(spark, tmp_path):
    """A start reads past the checkpoint alone: damage before it is not looked at; strict flushes each append."""
    s = Settings(str(tmp_path), durability="strict")
    with LogPipeline(spark, s) as p:
        p.start()
        p.append(rows(spark, 5), ["schema_id"])
        assert source.read_checkpoint(str(tmp_path)) == ((0, 160, 4, 0), None) and p.meter.count("flushes") == 1
        p.append(rows(spark, 3, start=5), ["schema_id"])
        assert source.read_checkpoint(str(tmp_path))[0] == (0, 256, 7, 0)
        m = p.metrics()
        assert (m["loglake.write.records_total"], m["loglake.write.bytes_total"], m["loglake.segment.count"], m["loglake.segment.bytes"]) == (8, 32, 1, 256)
        assert m["loglake.write.batch_size"] == {"count": 2, "sum": 8, "<8": 1, "<4": 1} and m["loglake.write.fsync_duration"]["count"] == 2
    (_, file, _), = source.list_segments(str(tmp_path))
    with open(file, "r+b") as f:
        f.seek(30)
        f.write(b"\xff\xff")
    with LogPipeline(spark, s) as p:
        p.start()
        assert p.tail == (0, 256, 8) and p.meter.gauge("recovery.truncated_bytes") == 0
        p.append(rows(spark, 1, start=8), ["schema_id"])
        assert p.frames((0, 256)).first()["seq_no"] == 8
        p.force_stop()
    (tmp_path / "checkpoint.dat").write_bytes(b"broken")
    with LogPipeline(spark, s) as p:  # without a checkpoint everything is read
        p.start()
        assert p.meter.gauge("recovery.truncated_bytes") == 288 and p.tail[2] == 9


def test_durability_none_flushes_at_the_stop(spark, tmp_path):
    with LogPipeline(spark, Settings(str(tmp_path), durability="none")) as p:
        p.start()
        p.append(rows(spark, 2), ["schema_id"])
        assert source.read_checkpoint(str(tmp_path))[1] == "CheckpointMissing"
        p.flush()
        assert source.read_checkpoint(str(tmp_path))[0] == (0, 64, 1, 0)


def test_a_cursor_past_the_tail_is_moved_back(spark, tmp_path):
    s = filled(spark, tmp_path, 4)
    source.write_cursor(str(tmp_path), "c", 99, 0, 5000)
    with LogPipeline(spark, s) as p:
        p.register_consumer("c")
        p.start()
        assert p.read_next("c", 9) == []
        p.append(rows(spark, 2, start=4), ["schema_id"])
        assert [r["seq_no"] for r in p.read_next("c", 9)] == [4, 5] and p.metrics()["loglake.consumer.lag{consumer=c}"] == 0


def test_push_consumers_seek_and_reset(spark, tmp_path):
    s = filled(spark, tmp_path, 10)
    for place, want in ((None, 0), (lambda p: p.seek_consumer("c", 7), 7), (lambda p: p.reset_consumer("c"), 0)):
        got = Collected()
        with LogPipeline(spark, s) as p:
            p.register_consumer("c")
            p.add_sink("c", "s", got)
            if place:
                place(p)
            p.start()
            p.stop()
        assert [x[0] for x in got.rows] == list(range(want, 10))


def test_a_router_of_ones_own(spark, tmp_path):
    s = filled(spark, tmp_path, 6)
    low, high = Collected(), Collected()
    halves = lambda batch, sinks: batch.withColumn("sink", F.when(F.col("seq_no") < 2, sinks[0]).otherwise(sinks[1]))
    with LogPipeline(spark, s) as p:
        p.register_consumer("c")
        p.add_sink("c", "low", low, router=halves)
        p.add_sink("c", "high", high, router=halves)
        with pytest.raises(InvalidState):
            p.add_sink("c", "x", low)
        p.start()
        p.stop()
    assert [x[0] for x in low.rows] == [0, 1] and [x[0] for x in high.rows] == [2, 3, 4, 5]


def test_garbage_is_collected_by_the_clock_and_dispose_is_idempotent(spark, tmp_path):
    import time

    filled(spark, tmp_path, 20)
    p = LogPipeline(spark, Settings(str(tmp_path), max_segment_bytes=96, retention="size_based", retention_max_bytes=200, gc_interval_ms=100))
    p.start()
    until = time.time() + 30
    while p.meter.count("segment.deleted") < 5 and time.time() < until:
        time.sleep(0.2)
    assert len(source.list_segments(str(tmp_path))) == 2 and p.meter.count("gc.failed") == 0
    p.dispose()
    p.dispose()
    with pytest.raises(InvalidState):
        p.start()


def test_cursor_flush_policy():
    now, written = [0.0], []
    from loglake.streaming.cursors import HeldCursor

    held = HeldCursor(lambda *at: written.append(at), 3, 5.0, clock=lambda: now[0])
    assert [held.advance(0, i, i) for i in range(4)] == [False, False, True, False] and written == [(0, 2, 2)]
    now[0] = 6.0
    assert held.advance(0, 9, 9) and not held.flush() and written[-1] == (0, 9, 9)
    held.advance(1, 0, 10)
    assert held.flush() and written[-1] == (1, 0, 10)


def test_force_stop_keeps_the_written_cursor(spark, tmp_path):
    s = filled(spark, tmp_path, 6)
    with LogPipeline(spark, s) as p:
        for stop, want in ((p.force_stop, [0, 1]), (p.stop, [0, 1]), (p.stop, [2, 3])):
            p.register_consumer("c")
            p.start()
            assert [r["seq_no"] for r in p.read_next("c", 2)] == want
            stop()
