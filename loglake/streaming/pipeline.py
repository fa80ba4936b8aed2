"""A running log: consumers with sinks (pushed, a streaming query each) and without (pulled, through cursors).

Each push consumer has a checkpoint folder of its own, so consumers resume and fail alone. A micro-batch is routed once
and handed to each sink as (DataFrame, batch_id); a sink that raises fails the batch, which is delivered again: at least
once, and exactly once for sinks that are idempotent in batch_id. Batches are bounded by max_batch_bytes.

The start recovers: it reads what lies behind the checkpoint, and appends go on in the last segment after its last good
frame. A flush writes the checkpoint and the pull cursors; durability says when appends flush: each (strict), once
fsync_interval_ms have passed (batched), or with a new segment and at the stop only (none). A timer collects garbage.
"""

from __future__ import annotations

import ast
import functools
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake import schema as S
from loglake.errors import DrainFailed, DrainTimeout, InvalidState
from loglake.functions import wire
from loglake.operators import backpressure, blocks, consume, recovery, retention, routing, segments
from loglake.schema import Settings
from loglake.sources import segments as source
from loglake.scratch import temporaries
from loglake.streaming.cursors import HeldCursor
from loglake.streaming.meter import Meter

Sink = Callable[[DataFrame, int], None]
#: Adds the column `sink` to a batch, given the names of the sinks.
Router = Callable[[DataFrame, list[str]], DataFrame]


def entries(frames: DataFrame) -> DataFrame:
    """Good frames as push consumers get them: blocks exploded (flags cleared, own lengths), single records at 0."""
    good = frames.where("error_code is null").drop("error_code")
    block = F.col("flags").bitwiseAND(S.FLAG_BLOCK) != 0
    whole = F.when(block, blocks.decoded(F.col("payload"))).otherwise(F.array("payload"))
    cleared = F.when(block, F.lit(0)).otherwise(F.col("flags")).cast("short")
    out = good.withColumn("_flags", cleared).withColumn("entries", whole)
    return blocks.explode(out).withColumn("flags", F.col("_flags")).drop("_flags")


@dataclass
class Consumer:
    name: str
    sinks: dict[str, Sink] = field(default_factory=dict)
    strategy: str | None = None
    kinds: dict[str, int | None] = field(default_factory=dict)
    key: Column | None = None
    router: Router | None = None

    def routed(self, batch: DataFrame) -> DataFrame:
        if self.strategy == "custom":
            return self.router(batch, list(self.sinks))
        if self.strategy == "content_type":
            return routing.by_content_type(batch, self.kinds)
        if self.strategy == "hash":
            return routing.by_hash(batch, list(self.sinks), self.key)
        return routing.broadcast(batch, list(self.sinks))


class LogPipeline:
    """States: stopped, starting, running, draining, error (for good)."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings, self.state = spark, settings.check(), "stopped"
        self.consumers: dict[str, Consumer] = {}
        self.queries: dict[str, object] = {}
        self.cursors: dict[str, HeldCursor] = {}
        self.dropped: dict[tuple[str, str], int] = {}
        self.meter = Meter(settings.meter)
        self.tail = (0, 0, 0)  # segment, offset there, next number
        self.unflushed, self.flushed_at = 0, time.monotonic()
        self.last_read: dict[str, int] = {}
        self.disposed = False
        self._ending, self._collector = threading.Event(), None
        source.register(spark)

    def __enter__(self) -> LogPipeline:
        return self

    def __exit__(self, *_):
        self.dispose()

    def dispose(self) -> None:
        """Stops the log if it runs; a consumer's failure to drain is passed over. Again, it does nothing."""
        if self.state == "running":
            try:
                self.stop()
            except DrainFailed:
                pass
        self.disposed = True

    # ---- set-up ----

    def _only(self, state: str) -> None:
        if self.disposed:
            raise InvalidState("the log is disposed of")
        if self.state != state:
            raise InvalidState(f"the log is {self.state}, not {state}")

    def register_consumer(self, name: str) -> None:
        self._only("stopped")
        wire.check_name(name)
        if name in self.consumers:
            raise InvalidState(f"consumer {name} is registered already")
        self.consumers[name] = Consumer(name)

    def add_sink(self, consumer: str, name: str, sink: Sink, content_type: int | None = None, key: Column | None = None, router: Router | None = None) -> None:
        """Broadcast by default; with content_type, key or a router of one's own, routed by these. A consumer has one
        strategy; the key or router of the first sink holds for all."""
        self._only("stopped")
        wire.check_name(name)
        c = self.consumers.get(consumer)
        if c is None:
            raise InvalidState(f"consumer {consumer} is not registered")
        strategy = "custom" if router is not None else "content_type" if content_type is not None else "hash" if key is not None else "broadcast"
        if c.strategy not in (None, strategy):
            raise InvalidState(f"consumer {consumer} routes by {c.strategy}")
        if name in c.sinks:
            raise InvalidState(f"consumer {consumer} has a sink {name} already")
        c.strategy = strategy
        c.sinks[name] = sink
        c.kinds[name] = content_type
        c.key = key if c.key is None else c.key
        c.router = c.router or router

    # ---- the log as tables ----

    def frames(self, start: tuple[int, int] = (0, 0)) -> DataFrame:
        """All frames from a place (segment, offset) on."""
        return self.spark.read.format("loglake").option("path", self.settings.path).option("start_segment", start[0]).option("start_offset", start[1]).load()

    def append(self, rows: DataFrame, order: list[str], block: str | None = None) -> None:
        """Appends rows (payload, content_type, schema_id) in the order given; with `block`, rows of one block are one
        frame. Numbers go on from the last one, in the last segment until it is full."""
        from loglake.operators.append import append, sequence

        self._only("running")
        cap, (segment, used, start) = self.settings.max_segment_bytes, self.tail
        with temporaries(self.spark):
            if block is not None:
                numbered = sequence(rows, order, name="_at")
                packed = blocks.pack(numbered.withColumn("_first", F.col("_at")), block, "_at", "payload", ("content_type", "schema_id", "_first"))
                raw = F.concat(_le32(F.size("entries")), F.aggregate("entries", F.lit(b""), lambda a, e: F.concat(a, _le32(F.octet_length(e)), e)))
                rows = packed.select(raw.alias("payload"), "content_type", "schema_id", F.lit(S.FLAG_BLOCK).cast("short").alias("flags"), "_first", F.col("entry_count").alias("_entries"), (F.col("payload_length") - 4 - 4 * F.col("entry_count")).alias("_bytes"))
                order = ["_first"]
            else:
                rows = rows.withColumns({"flags": F.lit(0).cast("short"), "_entries": F.lit(1), "_bytes": F.octet_length("payload")})
            log = append(rows.withColumnRenamed("flags", "_flags"), order, "payload", F.col("content_type"), F.col("schema_id"), start, offsets=True).drop("flags").withColumnRenamed("_flags", "flags")
            sums = log.agg(F.max("frame_bytes").alias("most"), F.count("*").alias("frames"), F.sum("_entries").alias("entries"), F.sum("_bytes").alias("bytes")).first()
            if not sums["frames"]:
                return
            if sums["most"] > cap:
                raise ValueError(f"a record of {sums['most']} bytes does not fit a segment of {cap}")
            placed = segments.assign(log, cap, first_id=segment, used=used)
            source.write_log(placed, self.settings.path, "append", self.settings.compression, (segment, used) if used else None)
        last, _, size = source.list_segments(self.settings.path)[-1]
        self.tail = (last, size, start + sums["frames"])
        self.meter.add("write.records_total", sums["entries"])
        self.meter.add("write.bytes_total", sums["bytes"])
        self.meter.add("segment.rollovers", last - segment)
        self.unflushed += sums["frames"]
        waited = 1000 * (time.monotonic() - self.flushed_at)
        if last > segment or self.settings.durability == "strict" or (self.settings.durability == "batched" and waited >= self.settings.fsync_interval_ms):
            self.flush()

    def flush(self) -> None:
        """Writes the checkpoint and the pull cursors. The records themselves lie in their files since their append."""
        self._only("running")
        self._flush()

    def _flush(self) -> None:
        began = time.monotonic()
        segment, offset, following = self.tail
        if following:
            source.write_checkpoint(self.settings.path, segment, offset, following - 1, segment)
        for held in self.cursors.values():
            held.flush()
        self.meter.add("flushes")
        self.meter.record("write.fsync_duration", 1000 * (time.monotonic() - began))
        if self.unflushed:
            self.meter.record("write.batch_size", self.unflushed)
        self.unflushed, self.flushed_at = 0, time.monotonic()

    def recovered(self) -> dict:
        """What a start finds: the last segment, the place in it after its last good frame, the next number, and the bytes
        behind the first bad frame. Frames before the checkpoint's place are taken as good and not read; without a readable
        checkpoint all are. An append cuts a bad end off the last segment; damage before that stays, and is passed over."""
        found = source.list_segments(self.settings.path)
        checkpoint, _ = source.read_checkpoint(self.settings.path)
        if not found:
            return {"segment": 0, "offset": 0, "next_seq": checkpoint[2] + 1 if checkpoint else 0, "truncated_bytes": 0}
        place = (checkpoint[0], checkpoint[1]) if checkpoint and checkpoint[0] >= found[0][0] else (found[0][0], 0)
        frames = self.frames(place)
        bad = F.col("error_code").isNotNull()
        at = F.struct("segment_id", "byte_offset")
        r = frames.agg(F.min(F.when(bad, at)).alias("bad"), F.max(F.when(~bad, F.col("seq_no"))).alias("last")).first()
        last, _, size = found[-1]
        sizes = {n: b for n, _, b in found}
        cut = sizes[r["bad"]["segment_id"]] - r["bad"]["byte_offset"] if r["bad"] else 0
        end = r["bad"]["byte_offset"] if r["bad"] and r["bad"]["segment_id"] == last else size
        newest = r["last"] if r["last"] is not None else checkpoint[2] if checkpoint else -1  # numbers behind damage stay used
        return {"segment": last, "offset": end, "next_seq": newest + 1, "truncated_bytes": cut}

    def _recover(self) -> None:
        began = time.monotonic()
        r = self.recovered()
        self.tail = (r["segment"], r["offset"], r["next_seq"])
        self.meter.add("recovery.count")
        self.meter.put("recovery.truncated_bytes", r["truncated_bytes"])
        self.meter.put("recovery.duration", 1000 * (time.monotonic() - began))

    def metrics(self) -> dict:
        """Counters, gauges and histograms of this run; lag of consumers that have read something."""
        found = source.list_segments(self.settings.path)
        self.meter.put("segment.count", len(found))
        self.meter.put("segment.bytes", sum(size for *_, size in found))
        for name, last in self.last_read.items():
            self.meter.put(f"consumer.lag{{consumer={name}}}", max(0, self.tail[2] - 1 - last))
        return self.meter.snapshot()

    def collect_garbage(self, now: float | None = None) -> list[int]:
        """Deletes the segments that the retention policy gives up; returns their ids."""
        s = self.settings
        found = source.list_segments(s.path)
        if not found:
            return []
        written = source.last_written(s.path)
        rows = [(n, size, written[n]) for n, _, size in found]
        table = self.spark.createDataFrame(rows, "segment_id int, bytes long, last_write double")
        if s.retention == "time_based":
            gone = retention.time_based(table, F.lit(time.time() if now is None else now), F.lit(s.retention_max_age_ms / 1000))
        elif s.retention == "size_based":
            gone = retention.size_based(table, s.retention_max_bytes)
        else:
            marks = [(c.name, self._watermark(c)) for c in self.consumers.values()]
            gone = retention.consumer_gated(table, self.spark.createDataFrame(marks, "consumer string, segment_id int"))
        ids = sorted(r["segment_id"] for r in gone.select("segment_id").collect())  # a row for each file
        source.delete_segments(s.path, ids)
        self.meter.add("segment.deleted", len(ids))
        return ids

    def _collect_by_the_clock(self) -> None:
        """Collects garbage every gc_interval_ms; a failure is counted and waits for the next time."""
        while not self._ending.wait(self.settings.gc_interval_ms / 1000):
            try:
                self.collect_garbage()
            except Exception:
                self.meter.add("gc.failed")

    def _watermark(self, c: Consumer) -> int:
        """The segment a consumer is in: of its cursor, or of the last batch its query has committed."""
        if not c.sinks:
            known = self.cursors.get(c.name)
            if known and known.place:
                return known.place[0]
            held, error = source.read_cursor(self.settings.path, c.name)
            return held[0] if error is None else 0
        q = self.queries.get(c.name)
        progress = (q.lastProgress if q else None) or {}
        ends = [ast.literal_eval(x["endOffset"]) if isinstance(x["endOffset"], str) else x["endOffset"] for x in progress.get("sources", []) if x.get("endOffset")]
        return min((e["segment"] for e in ends), default=0)

    # ---- pull ----

    def read_next(self, consumer: str, limit: int = 1) -> list:
        """The next frames of a pull consumer, blocks whole; an empty list at the end of the log. Moves its cursor."""
        self._only("running")
        c = self.consumers[consumer]
        if c.sinks:
            raise InvalidState(f"consumer {consumer} is pushed to")
        after, place = self._cursor(consumer)
        rows = consume.page(self.frames(place).where("error_code is null"), after, limit).collect()
        if rows:
            r = rows[-1]
            self._held(consumer).advance(r["segment_id"], r["byte_offset"] + r["frame_bytes"], r["seq_no"] + 1, len(rows))
            self.last_read[consumer] = r["seq_no"]
            self.meter.add("consumer.read_rate", len(rows))
        return rows

    def _held(self, consumer: str) -> HeldCursor:
        if consumer not in self.cursors:
            write = functools.partial(source.write_cursor, self.settings.path, consumer)
            self.cursors[consumer] = HeldCursor(write, self.settings.cursor_flush_records, self.settings.cursor_flush_seconds)
        return self.cursors[consumer]

    def _cursor(self, consumer: str) -> tuple[int, tuple[int, int]]:
        """The last seq_no read, and the place to read on from; a cursor file has the next number, which a seek sets as well.
        A cursor past the tail is moved back to it."""
        known = self.cursors.get(consumer)
        if known and known.place:
            return known.place[2] - 1, known.place[:2]
        held, error = source.read_cursor(self.settings.path, consumer)
        segment, offset, following = self.tail
        if error is None and held[:2] <= (segment, offset):
            return held[2] - 1, held[:2]
        if error is None or self.settings.missing_cursor == "from_tail":
            source.write_cursor(self.settings.path, consumer, segment, offset, following)
            return following - 1, (segment, offset)
        return -1, (0, 0)

    def _place_consumer(self, consumer: str, segment: int, offset: int, seq_no: int) -> None:
        """Sets where a consumer starts: its cursor, and for a push consumer a fresh query, which begins there."""
        source.write_cursor(self.settings.path, consumer, segment, offset, seq_no)
        source.delete_folder(self.settings.path, f"checkpoints/{consumer}")

    def _registered(self, consumer: str) -> None:
        self._only("stopped")
        if consumer not in self.consumers:
            raise InvalidState(f"consumer {consumer} is not registered")

    def seek_consumer(self, consumer: str, seq_no: int) -> None:
        """Sets a consumer, pulling or pushed to, to the first record numbered seq_no or more."""
        self._registered(consumer)
        good = self.frames().where("error_code is null")
        segment = consume.seek_one(segments.statistics(good), seq_no)
        at = good.where((F.col("segment_id") >= segment) & (F.col("seq_no") >= seq_no)).agg(F.min(F.struct("segment_id", "byte_offset")).alias("at")).first()["at"]
        self._place_consumer(consumer, at["segment_id"], at["byte_offset"], seq_no)

    def reset_consumer(self, consumer: str) -> None:
        """Sets a consumer to the first record of the oldest segment."""
        self._registered(consumer)
        found = source.list_segments(self.settings.path)
        first = found[0][0] if found else 0
        r = self.frames().where((F.col("segment_id") == first) & F.col("error_code").isNull()).agg(F.min("seq_no")).first()
        self._place_consumer(consumer, first, 0, r[0] or 0)

    # ---- push ----

    def start(self) -> None:
        self._only("stopped")
        self.state = "starting"
        for name in source.folders(self.settings.path, "spill"):  # what a batch spilled comes again with the batch
            source.delete_folder(self.settings.path, f"spill/{name}")
        self._recover()
        for c in self.consumers.values():
            if c.sinks:
                self.queries[c.name] = self._run(c)
        self._ending.clear()
        self._collector = threading.Thread(target=self._collect_by_the_clock, daemon=True)
        self._collector.start()
        self.state = "running"

    def _run(self, c: Consumer):
        checkpoint = f"checkpoints/{c.name}"
        fresh = not source.folders(self.settings.path, checkpoint)
        reader = self.spark.readStream.format("loglake").option("path", self.settings.path)
        reader = reader.option("startingOffsets", "latest" if self.settings.missing_cursor == "from_tail" else "earliest")
        reader = reader.option("maxBytesPerTrigger", self.settings.max_batch_bytes).option("checkpoint", f"{self.settings.path}/{checkpoint}")
        held, error = source.read_cursor(self.settings.path, c.name)
        if fresh and error is None:  # sought
            reader = reader.option("start_segment", held[0]).option("start_offset", held[1])

        def deliver(batch: DataFrame, batch_id: int) -> None:
            held = entries(batch).persist()
            try:
                if c.strategy == "content_type":
                    self._count_dropped(c.name, routing.UNROUTED, routing.unrouted(held, c.kinds).count())
                routed = c.routed(held).withColumn("batch", F.lit(batch_id))
                if self.settings.backpressure == "drop":
                    for r in backpressure.dropped(routed, self.settings.lane_capacity).collect():  # a row for each sink
                        self._count_dropped(c.name, r["sink"], r["dropped"])
                    routed = backpressure.kept(routed, self.settings.lane_capacity).drop("position")
                for name, sink in c.sinks.items():
                    lane = routed.where(F.col("sink") == name)
                    if self.settings.backpressure == "spill":
                        lane = self._spilled(c.name, name, lane)
                    sink(lane.drop("batch").orderBy("seq_no", "block_pos"), batch_id)
                    source.delete_folder(self.settings.path, f"spill/{c.name}-{name}")
                if last := held.agg(F.max("seq_no")).first()[0]:
                    self.last_read[c.name] = last
            finally:
                held.unpersist()

        return reader.load().writeStream.queryName(f"{self.settings.meter}-{c.name}").foreachBatch(deliver).option("checkpointLocation", f"{self.settings.path}/{checkpoint}").trigger(processingTime=self._interval()).start()

    def _count_dropped(self, consumer: str, sink: str, n: int) -> None:
        self.dropped[consumer, sink] = self.dropped.get((consumer, sink), 0) + n
        self.meter.add("sink.dropped_total", n, sink=sink)

    def _spilled(self, consumer: str, sink: str, lane: DataFrame) -> DataFrame:
        """A lane of which what passes its capacity, and all behind that, waits in a spill table; the sink gets both in order.
        The table goes when the sink has taken the batch, or at the next start, as the batch then comes again."""
        marked = backpressure.spilled(lane, self.settings.lane_capacity)
        over = marked.where("spilled").drop("spilled")
        n = over.count()
        if not n:
            return lane
        at = f"{self.settings.path}/spill/{consumer}-{sink}"
        over.write.mode("overwrite").parquet(at)
        self.meter.add("sink.spilled_total", n, sink=sink)
        return marked.where("not spilled").drop("spilled").unionByName(self.spark.read.schema(over.schema).parquet(at))

    def _interval(self) -> str:
        """How often a batch is looked for: batched by the interval set; none and strict as soon as there is something. A
        record on its own is never synced: the append is the unit of durability."""
        return f"{self.settings.fsync_interval_ms if self.settings.durability == 'batched' else 0} milliseconds"

    def stop(self) -> None:
        """Drains every consumer to the tail within the time set in all, then stops; a failed one puts the log in error."""
        self._only("running")
        self.state = "draining"
        limit = time.monotonic() + self.settings.drain_timeout_ms / 1000 if self.settings.drain_timeout_ms else None
        failed: DrainFailed | None = None
        for name, q in self.queries.items():
            try:
                self._drain(name, q, limit)
            except DrainFailed as e:
                failed = failed or e
            finally:
                q.stop()
        self._flush()
        self._clear("error" if failed else "stopped")
        if failed:
            raise failed

    def _drain(self, name: str, q, limit: float | None) -> None:
        """Waits until the query has handled all there is, at most until the limit, which all consumers share."""
        found: list[BaseException] = []

        def wait() -> None:
            try:
                q.processAllAvailable()
            except Exception as e:  # the query's own failure
                found.append(e)

        waiting = threading.Thread(target=wait, daemon=True)
        waiting.start()
        waiting.join(None if limit is None else max(0.0, limit - time.monotonic()))
        if waiting.is_alive():
            raise DrainTimeout(name, self.settings.drain_timeout_ms)
        if found or q.exception() is not None:
            raise DrainFailed(name, found[0] if found else q.exception())

    def force_stop(self) -> None:
        """Stops without draining; consumers go on from their last committed batch or written cursor."""
        for q in self.queries.values():
            q.stop()
        self._clear("stopped")

    def _clear(self, state: str) -> None:
        self._ending.set()
        if self._collector is not None:
            self._collector.join(self.settings.gc_stop_timeout_ms / 1000)
        self.last_read.clear()
        self.queries.clear()
        self.cursors.clear()
        self.consumers.clear()
        self.state = state


def _le32(n: Column) -> Column:
    """A count as four bytes, low byte first."""
    h = F.lpad(F.hex(n.cast("int")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))
