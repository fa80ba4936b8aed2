"""One registered query for each operator of the log, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.functions import header
from loglake.operators import backpressure, blocks, consume, ledger, metrics, recovery, retention, routing, segments
from loglake.operators.append import running_total, sequence, too_large
from loglake.plans.catalog import register
from loglake.plans.tables import CREDIT, LOG_SQL, TEXT_SQL, cents, event_log, segments_sql, table, text_log
from loglake.scratch import fresh_path

CAP = 8_192
BLOCK = 16
SINKS = ["s0", "s1", "s2"]
FILTERS = {"json": 1, "msgpack": 2, "protobuf": 3}
CURSORS = (("fast", 9_000), ("slow", 1_200), ("late", 400), ("new", None))
SIGNED = "CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 1 ELSE -1 END * CAST(round(value * 100) AS BIGINT)"
WITH = f"WITH RECURSIVE {LOG_SQL}"
SEGMENTED = f"{WITH}, {segments_sql('log', CAP)}"
VALUES = ", ".join(f"('{n}', CAST({'NULL' if s is None else s} AS BIGINT))" for n, s in CURSORS)
#: Frames that the recovery queries take as corrupt.
BAD = "event_id % 401 = 400"


def amount():
    return ledger.signed(cents(F.col("value")), F.col("event_type").isin(*CREDIT))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.assign(event_log(spark, sf_dir, offsets=True), CAP)


def cursors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURSORS, "consumer string, seq_no long")


@register("ledger_running_balance", f"{WITH} SELECT seq_no, user_id, {SIGNED} AS amount_cents, CAST(sum({SIGNED}) OVER (PARTITION BY user_id ORDER BY seq_no) AS BIGINT) AS balance_cents FROM log")
def ledger_running_balance(spark, sf_dir):
    out = ledger.running_balance(event_log(spark, sf_dir), "user_id", amount())
    return out.select("seq_no", "user_id", amount().alias("amount_cents"), F.col("balance").cast("long").alias("balance_cents"))


@register("append_sequence", f"{WITH} SELECT seq_no, event_id, content_type, schema_id, payload_length FROM log")
def append_sequence(spark, sf_dir):
    return event_log(spark, sf_dir).select("seq_no", "event_id", "content_type", "schema_id", "payload_length")


@register("append_lineitem_sequence", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq_no, l_orderkey, l_linenumber FROM lineitem")
def append_lineitem_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sequence(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("seq_no", "l_orderkey", "l_linenumber")


@register("append_too_large", f"WITH {TEXT_SQL} SELECT seq_no, doc_id, frame_bytes FROM texts WHERE frame_bytes > 16384")
def append_too_large(spark, sf_dir):
    return too_large(text_log(spark, sf_dir), 16_384).select("seq_no", "doc_id", "frame_bytes")


@register("frame_layout", f"{WITH} SELECT seq_no, frame_bytes, CAST(sum(frame_bytes) OVER (ORDER BY seq_no) - frame_bytes AS BIGINT) AS log_offset FROM log")
def frame_layout(spark, sf_dir):
    return segments.with_offsets(event_log(spark, sf_dir)).select("seq_no", "frame_bytes", F.col("log_offset").cast("long"))


@register("flag_decode", f"{WITH} SELECT seq_no, CAST(f AS INTEGER) AS flags, f & 1 = 1 AS is_block, f & 2 = 2 AS is_compressed, CAST(CASE WHEN f & 2 = 2 THEN (f & 12) >> 2 ELSE 0 END AS INTEGER) AS algorithm FROM (SELECT seq_no, CAST(event_id % 256 AS INTEGER) AS f FROM log)")
def flag_decode(spark, sf_dir):
    f = F.col("flags")
    rows = event_log(spark, sf_dir).select("seq_no", (F.col("event_id") % 256).cast("int").alias("flags"))
    return rows.select("seq_no", "flags", header.is_block(f).alias("is_block"), header.is_compressed(f).alias("is_compressed"), header.algorithm(f).cast("int").alias("algorithm"))


@register("error_codes", f"""{WITH} SELECT seq_no, CASE WHEN size < 24 THEN 'TruncatedHeader' WHEN k = 1 THEN 'InvalidMagic' WHEN k = 2 THEN 'InvalidVersion' WHEN n > 2147483647 THEN 'PayloadTooLarge'
  WHEN size < 24 + n THEN 'TruncatedPayload' WHEN size < 28 + n THEN 'TruncatedFooter' WHEN k = 3 THEN 'CrcMismatch' WHEN k = 4 THEN 'DecompressionFailed' END AS error_code
  FROM (SELECT seq_no, event_id % 11 AS k, CASE WHEN event_id % 13 = 5 THEN 3000000000 ELSE payload_length END AS n, frame_bytes - event_id % 37 * (event_id % 3) AS size FROM log)""")
def error_codes(spark, sf_dir):
    k = F.col("event_id") % 11
    n = F.when(F.col("event_id") % 13 == 5, F.lit(3_000_000_000)).otherwise(F.col("payload_length"))
    size = F.col("frame_bytes") - F.col("event_id") % 37 * (F.col("event_id") % 3)
    code = header.error_code(size, F.when(k == 1, 0).otherwise(0x4C434550), F.when(k == 2, 9).otherwise(1), n, k != 3, k != 4)
    return event_log(spark, sf_dir).select("seq_no", code.alias("error_code"))


@register("segment_assign", f"{SEGMENTED} SELECT seq_no, segment_id, byte_offset FROM placed")
def segment_assign(spark, sf_dir):
    return segmented(spark, sf_dir).select("seq_no", "segment_id", F.col("byte_offset").cast("long"))


@register("segment_assign_variable", f"WITH RECURSIVE {TEXT_SQL}, {segments_sql('texts', 20_000)} SELECT seq_no, segment_id, byte_offset FROM placed")
def segment_assign_variable(spark, sf_dir):
    return segments.assign(text_log(spark, sf_dir).drop("text"), 20_000).select("seq_no", "segment_id", F.col("byte_offset").cast("long"))


@register("segment_stats", f"{SEGMENTED} SELECT *, segment_id = max(segment_id) OVER () AS is_active FROM segments")
def segment_stats(spark, sf_dir):
    return segments.statistics(segmented(spark, sf_dir))


BLOCKS_SQL = f"blocks AS (SELECT seq_no // {BLOCK} AS block_id, seq_no % {BLOCK} AS pos, props, content_type, schema_id FROM log)"


def packed(spark, sf_dir) -> DataFrame:
    log = event_log(spark, sf_dir).select(F.floor(F.col("seq_no") / BLOCK).alias("block_id"), (F.col("seq_no") % BLOCK).alias("pos"), "props", "content_type", "schema_id")
    return blocks.pack(log, "block_id", "pos", "props", ("content_type", "schema_id"))


@register("block_pack", f"{WITH}, {BLOCKS_SQL} SELECT block_id, count(*) AS entry_count, string_agg(props, '|' ORDER BY pos) AS entries, CAST(4 + sum(4 + strlen(props)) AS BIGINT) AS payload_length FROM blocks GROUP BY block_id")
def block_pack(spark, sf_dir):
    return packed(spark, sf_dir).select("block_id", "entry_count", F.array_join("entries", "|").alias("entries"), "payload_length")


@register("block_sizes", f"{WITH}, {BLOCKS_SQL} SELECT block_id, CAST(4 + sum(4 + strlen(props)) AS BIGINT) AS payload_bytes, CAST(32 + sum(4 + strlen(props)) AS BIGINT) AS frame_bytes FROM blocks GROUP BY block_id")
def block_sizes(spark, sf_dir):
    return packed(spark, sf_dir).select("block_id", blocks.payload_bytes(F.col("entries")).alias("payload_bytes"), header.frame_bytes(F.col("payload_length")).alias("frame_bytes"))


@register("block_explode", f"{WITH}, {BLOCKS_SQL} SELECT block_id AS seq_no, CAST(pos AS INTEGER) AS block_pos, props AS payload, CAST(strlen(props) AS BIGINT) AS payload_length, CAST(0 AS SMALLINT) AS flags, first(content_type) OVER w AS content_type, first(schema_id) OVER w AS schema_id FROM blocks WINDOW w AS (PARTITION BY block_id ORDER BY pos)")
def block_explode(spark, sf_dir):
    frames = packed(spark, sf_dir).withColumnRenamed("block_id", "seq_no").withColumn("flags", F.lit(1).cast("short"))
    return blocks.explode(frames).select("seq_no", "block_pos", "payload", "payload_length", "flags", "content_type", "schema_id")


@register("route_broadcast", f"{WITH} SELECT seq_no, event_id, sink FROM log, (VALUES ('s0'), ('s1'), ('s2')) t(sink)")
def route_broadcast(spark, sf_dir):
    return routing.broadcast(event_log(spark, sf_dir), SINKS).select("seq_no", "event_id", "sink")


FILTERS_SQL = "(VALUES ('json', 1), ('msgpack', 2), ('protobuf', 3)) f(sink, kind)"


@register("route_content_type", f"{WITH} SELECT seq_no, content_type, sink FROM log JOIN {FILTERS_SQL} ON kind = content_type")
def route_content_type(spark, sf_dir):
    return routing.by_content_type(event_log(spark, sf_dir), FILTERS).select("seq_no", "content_type", "sink")


@register("route_content_type_unfiltered", f"{WITH} SELECT seq_no, sink FROM log JOIN (VALUES ('json', 1), ('all', NULL)) f(sink, kind) ON kind IS NULL OR kind = content_type")
def route_content_type_unfiltered(spark, sf_dir):
    return routing.by_content_type(event_log(spark, sf_dir), {"json": 1, "all": None}).select("seq_no", "sink")


@register("route_content_type_dropped", f"{WITH} SELECT content_type, '*' AS sink, count(*) AS dropped FROM log WHERE content_type NOT IN (1, 2, 3) GROUP BY content_type")
def route_content_type_dropped(spark, sf_dir):
    return routing.unrouted(event_log(spark, sf_dir), FILTERS).groupBy("content_type", "sink").agg(F.count("*").alias("dropped"))


@register("route_hash", f"{WITH} SELECT seq_no, k AS key, 's' || ((k % 3 + 3) % 3) AS sink FROM (SELECT seq_no, user_id - 50 AS k FROM log)")
def route_hash(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("key", F.col("user_id") - 50)
    return routing.by_hash(log, SINKS, F.col("key")).select("seq_no", "key", "sink")


@register("pull_page", f"{WITH} SELECT seq_no, event_id, payload_length FROM log WHERE seq_no > 500 ORDER BY seq_no LIMIT 100")
def pull_page(spark, sf_dir):
    return consume.page(event_log(spark, sf_dir), 500, 100).select("seq_no", "event_id", "payload_length")


@register("pull_end_of_log", f"{WITH} SELECT seq_no FROM log WHERE seq_no > (SELECT max(seq_no) FROM log)")
def pull_end_of_log(spark, sf_dir):
    log = event_log(spark, sf_dir)
    tail = log.agg(F.max("seq_no")).first()[0]
    return consume.page(log, tail, 100).select("seq_no")


@register("seek_lower_bound", f"{WITH} SELECT seq_no, event_id FROM log WHERE seq_no >= 700")
def seek_lower_bound(spark, sf_dir):
    return event_log(spark, sf_dir).where("seq_no >= 700").select("seq_no", "event_id")


TARGETS = (("a", 0), ("b", 777), ("c", 10**9), ("d", 5))


@register("seek_consumer", f"""{SEGMENTED}, kept AS (SELECT * FROM segments WHERE segment_id > 0), bounds AS (SELECT min(first_seq) AS earliest, max(last_seq) AS tail FROM kept),
asked AS (SELECT *, CASE WHEN earliest IS NULL THEN 'empty' WHEN target > tail THEN 'beyond_tail' WHEN target < earliest THEN 'below_floor' ELSE 'ok' END AS status FROM bounds, (VALUES ('a', 0), ('b', 777), ('c', 1000000000), ('d', 5), ('e', 1800)) t(consumer, target))
SELECT consumer, CAST(target AS BIGINT) AS target, status, CASE status WHEN 'ok' THEN (SELECT min(segment_id) FROM kept WHERE last_seq >= target) END AS segment_id, CASE status WHEN 'ok' THEN (SELECT min(seq_no) FROM placed WHERE seq_no >= target) END AS seq_no, earliest FROM asked""")
def seek_consumer(spark, sf_dir):
    log = segmented(spark, sf_dir).where("segment_id > 0")  # the first segment is gone
    targets = spark.createDataFrame((*TARGETS, ("e", 1800)), "consumer string, target long")
    return consume.seek(segments.statistics(log), log, targets)


@register("reset_consumer", f"""{SEGMENTED}, oldest AS (SELECT * FROM segments WHERE segment_id > 0 ORDER BY segment_id LIMIT 1)
SELECT consumer, coalesce((SELECT segment_id FROM oldest), 0) AS segment_id, coalesce((SELECT first_seq FROM oldest), 0) AS seq_no, CAST(0 AS BIGINT) AS byte_offset FROM (VALUES {VALUES}) c(consumer, read)""")
def reset_consumer(spark, sf_dir):
    return consume.reset(segments.statistics(segmented(spark, sf_dir)).where("segment_id > 0"), cursors(spark))


PLACES = (("past", 10**6, 0), ("inside", 1, 4_000), ("over", 0, 10**9))


@register("missing_cursor", f"""{SEGMENTED}, tail AS (SELECT max(segment_id) AS s, max_by(bytes, segment_id) AS b, min(segment_id) AS oldest FROM segments), held AS (SELECT * FROM (VALUES ('past', 1000000, 0), ('inside', 1, 4000), ('over', 0, 1000000000)) h(consumer, hs, hb))
SELECT consumer, CAST(CASE WHEN hs IS NULL THEN CASE policy WHEN 'from_tail' THEN s ELSE oldest END WHEN hs > s OR hs = s AND hb > b THEN s ELSE hs END AS INTEGER) AS segment_id,
CAST(CASE WHEN hs IS NULL THEN CASE policy WHEN 'from_tail' THEN b ELSE 0 END WHEN hs > s OR hs = s AND hb > b THEN b ELSE hb END AS BIGINT) AS byte_offset, hs IS NOT NULL AS resumed
FROM (VALUES ('past', 'from_tail'), ('inside', 'from_tail'), ('over', 'from_beginning'), ('new', 'from_beginning'), ('newer', 'from_tail')) c(consumer, policy) LEFT JOIN held USING (consumer), tail""")
def missing_cursor(spark, sf_dir):
    held = spark.createDataFrame(PLACES, "consumer string, segment_id int, byte_offset long")
    wanted = (("past", "from_tail"), ("inside", "from_tail"), ("over", "from_beginning"), ("new", "from_beginning"), ("newer", "from_tail"))
    return consume.start_positions(held, spark.createDataFrame(wanted, "consumer string, policy string"), segments.statistics(segmented(spark, sf_dir)), F.col("policy"))


@register("cursor_flush_points", f"{WITH} SELECT 'c' || (user_id % 3) AS consumer, seq_no, n AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 3 ORDER BY seq_no) AS n FROM log) WHERE n % 100 = 0")
def cursor_flush_points(spark, sf_dir):
    reads = event_log(spark, sf_dir).select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("consumer"), "seq_no")
    nth = running_total(reads, F.lit(1).cast("long"), "nth", keys=("consumer",))
    return consume.flush_points(nth, 100).select("consumer", "seq_no", F.col("nth").cast("long"))


@register("independent_cursors", f"{WITH} SELECT consumer, count(l.seq_no) AS pending, min(l.seq_no) AS next_seq FROM (VALUES {VALUES}) c(consumer, done) LEFT JOIN log l ON l.seq_no > coalesce(done, -1) GROUP BY consumer")
def independent_cursors(spark, sf_dir):
    at = [F.sum((F.col("seq_no") > (-1 if s is None else s)).cast("long")).alias(f"n{i}") for i, (_, s) in enumerate(CURSORS)]
    first = [F.min(F.when(F.col("seq_no") > (-1 if s is None else s), F.col("seq_no"))).alias(f"f{i}") for i, (_, s) in enumerate(CURSORS)]
    one = event_log(spark, sf_dir).agg(*at, *first)
    rows = F.array(*(F.struct(F.lit(n).alias("consumer"), F.coalesce(f"n{i}", F.lit(0)).cast("long").alias("pending"), F.col(f"f{i}").alias("next_seq")) for i, (n, _) in enumerate(CURSORS)))
    return one.select(F.inline(rows))


@register("consumer_lag", f"{WITH} SELECT consumer, greatest(0, (SELECT max(seq_no) FROM log) - done) AS lag FROM (VALUES {VALUES}) c(consumer, done) WHERE done IS NOT NULL")
def consumer_lag(spark, sf_dir):
    return consume.lag(event_log(spark, sf_dir), cursors(spark))


@register("retention_consumer_gated", f"{SEGMENTED} SELECT segment_id, bytes FROM segments WHERE segment_id < 3 AND segment_id < (SELECT max(segment_id) FROM segments)")
def retention_consumer_gated(spark, sf_dir):
    marks = spark.createDataFrame([("a", 3), ("b", 7)], "consumer string, segment_id int")
    return retention.consumer_gated(segments.statistics(segmented(spark, sf_dir)), marks).select("segment_id", "bytes")


@register("retention_no_consumers", f"{SEGMENTED} SELECT segment_id FROM segments WHERE false")
def retention_no_consumers(spark, sf_dir):
    return retention.consumer_gated(segments.statistics(segmented(spark, sf_dir)), spark.createDataFrame([], "consumer string, segment_id int")).select("segment_id")


@register("retention_time", f"{SEGMENTED}, written AS (SELECT segment_id, max(ts) AS last_write FROM placed GROUP BY segment_id) SELECT segment_id, last_write FROM written WHERE last_write < (SELECT max(ts) FROM log) - INTERVAL 7 DAY AND segment_id < (SELECT max(segment_id) FROM segments)")
def retention_time(spark, sf_dir):
    log = segmented(spark, sf_dir)
    now = log.agg(F.max("ts").alias("now"))
    table_ = segments.statistics(log, F.col("ts")).crossJoin(F.broadcast(now))  # one row
    return retention.time_based(table_, F.col("now"), F.expr("interval 7 days")).select("segment_id", "last_write")


@register("retention_size", f"{SEGMENTED}, counted AS (SELECT *, sum(bytes) OVER () AS total, coalesce(sum(bytes) OVER (ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM segments) SELECT segment_id, bytes FROM counted WHERE total - gone > 30000 AND segment_id < (SELECT max(segment_id) FROM segments)")
def retention_size(spark, sf_dir):
    return retention.size_based(segments.statistics(segmented(spark, sf_dir)), 30_000).select("segment_id", "bytes")


def damaged(spark, sf_dir) -> DataFrame:
    return segmented(spark, sf_dir).withColumn("error_code", F.expr(f"CASE WHEN {BAD} THEN 'CrcMismatch' END"))


@register("recovery_valid_prefix", f"{SEGMENTED} SELECT seq_no, segment_id FROM placed WHERE seq_no < coalesce((SELECT min(seq_no) FROM placed WHERE {BAD}), 9223372036854775807)")
def recovery_valid_prefix(spark, sf_dir):
    return recovery.valid_prefix(damaged(spark, sf_dir)).select("seq_no", "segment_id")


@register("recovery_from_checkpoint", f"{SEGMENTED} SELECT count(*) AS records, max(seq_no) AS last_seq FROM placed WHERE seq_no < coalesce((SELECT min(seq_no) FROM placed WHERE {BAD} AND segment_id >= 4), 9223372036854775807)")
def recovery_from_checkpoint(spark, sf_dir):
    return recovery.valid_prefix(damaged(spark, sf_dir), (4, 0)).agg(F.count("*").alias("records"), F.max("seq_no").alias("last_seq"))


@register("recovery_next_seq", f"{SEGMENTED} SELECT coalesce(max(seq_no) + 1, 42, 0) AS next_seq FROM placed WHERE seq_no < coalesce((SELECT min(seq_no) FROM placed WHERE {BAD}), 9223372036854775807)")
def recovery_next_seq(spark, sf_dir):
    return recovery.next_seq(recovery.valid_prefix(damaged(spark, sf_dir)), 41)


@register("recovery_truncated_bytes", f"""{SEGMENTED}, bad AS (SELECT coalesce(min(seq_no), 9223372036854775807) AS b FROM placed WHERE {BAD})
SELECT segment_id, CAST(sum(frame_bytes) AS BIGINT) AS file_bytes, CAST(coalesce(sum(frame_bytes) FILTER (WHERE seq_no < b), 0) AS BIGINT) AS valid_bytes, CAST(coalesce(sum(frame_bytes) FILTER (WHERE seq_no >= b), 0) AS BIGINT) AS truncated_bytes FROM placed, bad GROUP BY segment_id""")
def recovery_truncated_bytes(spark, sf_dir):
    return recovery.truncated_bytes(damaged(spark, sf_dir))


@register("cursor_clamp", f"""{SEGMENTED}, tail AS (SELECT max(segment_id) AS s, max_by(bytes, segment_id) AS b FROM segments)
SELECT consumer, CAST(CASE WHEN seg > s OR seg = s AND pos > b THEN s ELSE seg END AS INTEGER) AS segment_id, CAST(CASE WHEN seg > s OR seg = s AND pos > b THEN b ELSE pos END AS BIGINT) AS byte_offset
FROM tail, (SELECT user_id % 50 AS consumer, max(segment_id) + user_id % 50 % 3 AS seg, max_by(byte_offset, seq_no) * (1 + user_id % 50 % 2 * 1000) AS pos FROM placed GROUP BY user_id % 50)""")
def cursor_clamp(spark, sf_dir):
    """Cursors of fifty consumers, some of them past the tail in their segment, some in a segment that is not there."""
    log = segmented(spark, sf_dir).withColumn("consumer", F.col("user_id") % 50)
    last = log.groupBy("consumer").agg(F.max("segment_id").alias("s"), F.max_by("byte_offset", "seq_no").alias("b"))
    held = last.select("consumer", (F.col("s") + F.col("consumer") % 3).cast("int").alias("segment_id"), (F.col("b") * (1 + F.col("consumer") % 2 * 1000)).cast("long").alias("byte_offset"))
    return consume.start_positions(held, held.select("consumer"), segments.statistics(log), F.lit("from_beginning")).drop("resumed")


@register("checkpoint_resume", f"""{SEGMENTED} SELECT segment_id, byte_offset, seq_no, props AS payload FROM placed WHERE segment_id > 1 OR segment_id = 1 AND byte_offset >= (SELECT max(byte_offset) FROM placed WHERE segment_id = 1 AND byte_offset <= 2000)""")
def checkpoint_resume(spark, sf_dir):
    """The log written in two appends, the second going on in the middle of the segment the first left, then read from the
    place of the checkpoint between them."""
    from loglake.sources.segments import read_checkpoint, write_checkpoint, write_log

    log = segmented(spark, sf_dir).select("segment_id", "byte_offset", "seq_no", F.col("props").cast("binary").alias("payload"), "content_type", "schema_id")
    path = fresh_path(spark, "log")
    cut = log.where("segment_id = 1 and byte_offset <= 2000").agg(F.max(F.struct("byte_offset", "seq_no")).alias("at")).first()["at"]
    before = F.col("seq_no") < cut["seq_no"]
    write_log(log.where(before), path)
    write_checkpoint(path, 1, cut["byte_offset"], cut["seq_no"] - 1, 1)
    write_log(log.where(~before), path, "append", resume=(1, cut["byte_offset"]))
    (segment, offset, *_), _ = read_checkpoint(path)
    frames = spark.read.format("loglake").option("path", path).option("start_segment", segment).option("start_offset", offset).load()
    return frames.where("error_code is null").select("segment_id", "byte_offset", "seq_no", F.col("payload").cast("string").alias("payload"))


@register("recovery_of_damaged_files", f"""{SEGMENTED}, bad AS (SELECT seq_no FROM placed WHERE segment_id = 3 ORDER BY seq_no LIMIT 1 OFFSET 5) SELECT p.seq_no, segment_id FROM placed p, bad WHERE p.seq_no < bad.seq_no""")
def recovery_of_damaged_files(spark, sf_dir):
    """The frames before the first bad one, read from files of which one had a byte changed."""
    from loglake.sources.segments import list_segments, patch

    path = _written(spark, sf_dir)
    frames = spark.read.format("loglake").option("path", path).load()
    fifth = frames.where("segment_id = 3").orderBy("seq_no").offset(5).select("byte_offset").first()[0]
    patch(list_segments(path)[3][1], fifth + 24, path)
    return recovery.valid_prefix(frames).select("seq_no", "segment_id")


@register("metrics_totals", "SELECT count(*) AS records_total, CAST(sum(strlen(props)) AS BIGINT) AS bytes_total FROM events")
def metrics_totals(spark, sf_dir):
    return metrics.write_totals(event_log(spark, sf_dir), "props")


@register("metrics_segments", f"{SEGMENTED} SELECT count(*) AS segment_count, CAST(sum(bytes) AS BIGINT) AS segment_bytes, CAST(max(segment_id) - min(segment_id) AS BIGINT) AS rollovers FROM segments")
def metrics_segments(spark, sf_dir):
    return metrics.segment_totals(segments.statistics(segmented(spark, sf_dir)))


@register("batch_size_hist", f"{WITH} SELECT batch_size, count(*) AS batches FROM (SELECT date_trunc('minute', ts) AS minute, count(*) AS batch_size FROM log GROUP BY 1) GROUP BY 1")
def batch_size_hist(spark, sf_dir):
    return metrics.batch_sizes(event_log(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts")), "minute")


ROUTED_SQL = "routed AS (SELECT 's' || (user_id % 3) AS sink, seq_no // 256 AS batch, seq_no, row_number() OVER (PARTITION BY user_id % 3, seq_no // 256 ORDER BY seq_no) AS position FROM log)"


def routed(spark, sf_dir) -> DataFrame:
    out = routing.by_hash(event_log(spark, sf_dir), SINKS, F.col("user_id"))
    return out.select("sink", F.floor(F.col("seq_no") / 256).alias("batch"), "seq_no", F.lit(0).alias("block_pos"))


@register("backpressure_kept", f"{WITH}, {ROUTED_SQL} SELECT sink, batch, seq_no FROM routed WHERE position <= 64")
def backpressure_kept(spark, sf_dir):
    return backpressure.kept(routed(spark, sf_dir), 64).select("sink", "batch", "seq_no")


@register("sink_dropped", f"{WITH}, {ROUTED_SQL} SELECT sink, count(*) AS dropped FROM routed WHERE position > 64 GROUP BY sink")
def sink_dropped(spark, sf_dir):
    return backpressure.dropped(routed(spark, sf_dir), 64)


@register("spill_replay_order", f"{WITH}, {ROUTED_SQL} SELECT sink, seq_no, row_number() OVER (PARTITION BY sink ORDER BY seq_no) AS delivery, position > 64 AS spilled FROM routed")
def spill_replay_order(spark, sf_dir):
    marked = backpressure.spilled(routed(spark, sf_dir), 64)
    out = running_total(marked, F.lit(1).cast("long"), "delivery", keys=("sink",))
    return out.select("sink", "seq_no", F.col("delivery").cast("long"), "spilled")


@register("spill_orphans", f"{WITH}, {ROUTED_SQL} SELECT DISTINCT 'c' || (batch % 5) AS consumer, sink FROM routed WHERE position > 64 AND NOT (batch % 5 < 3 AND sink <> 's1')")
def spill_orphans(spark, sf_dir):
    """Spill files of lanes that overflowed, of five consumers; three of them are registered still, without one sink."""
    over = backpressure.lane_positions(routed(spark, sf_dir)).where("position > 64")
    files = over.select(F.concat(F.lit("c"), F.col("batch") % 5).alias("consumer"), "sink").distinct()
    registered = spark.createDataFrame([(f"c{i}", s) for i in range(3) for s in ("s0", "s2")], "consumer string, sink string")
    return backpressure.orphans(files, registered)


@register("lane_depth", f"{WITH}, {ROUTED_SQL} SELECT sink, count(*) FILTER (WHERE position > 64) AS lane_depth FROM routed GROUP BY sink")
def lane_depth(spark, sf_dir):
    r = routed(spark, sf_dir)
    return metrics.lane_depth(r, backpressure.kept(r, 64))


@register("dedupe_at_least_once", f"{WITH} SELECT 's0' AS sink, seq_no, event_id FROM log")
def dedupe_at_least_once(spark, sf_dir):
    log = event_log(spark, sf_dir).select(F.lit("s0").alias("sink"), "seq_no", F.lit(0).alias("block_pos"), "event_id")
    return backpressure.deduplicated(log.union(log.where("seq_no >= 300"))).select("sink", "seq_no", "event_id")


@register("ledger_audit", f"{WITH} SELECT seq_no, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS amount_cents FROM log ORDER BY seq_no")
def ledger_audit(spark, sf_dir):
    return event_log(spark, sf_dir).select("seq_no", "event_id", "event_type", cents(F.col("value")).alias("amount_cents")).orderBy("seq_no")


@register("ledger_account_filter", f"{WITH} SELECT seq_no, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM log WHERE user_id = 7")
def ledger_account_filter(spark, sf_dir):
    entry = F.from_json("props", "k long")
    return event_log(spark, sf_dir).where("user_id = 7").select("seq_no", entry["k"].alias("k"))


@register("ledger_reconciliation", f"{WITH}, cents AS (SELECT CAST(round(value * 100) AS BIGINT) AS c, event_type IN ('purchase', 'signup', 'click') AS credit FROM log) SELECT CAST(coalesce(sum(c) FILTER (WHERE credit), 0) AS BIGINT) AS credits, CAST(coalesce(sum(c) FILTER (WHERE NOT credit), 0) AS BIGINT) AS debits, CAST(coalesce(sum(c) FILTER (WHERE credit), 0) - coalesce(sum(c) FILTER (WHERE NOT credit), 0) AS BIGINT) AS net FROM cents")
def ledger_reconciliation(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("cents", cents(F.col("value")))
    return ledger.reconciliation(log, "cents", F.col("event_type").isin(*CREDIT))


@register("ledger_resume_delta", f"{WITH} SELECT * FROM (SELECT seq_no, user_id, CAST(sum({SIGNED}) OVER (PARTITION BY user_id ORDER BY seq_no) AS BIGINT) AS balance_cents FROM log) WHERE seq_no > 600")
def ledger_resume_delta(spark, sf_dir):
    return ledger.resumed(event_log(spark, sf_dir), "user_id", amount(), 600).select("seq_no", "user_id", F.col("balance").cast("long").alias("balance_cents"))


@register("ledger_seek_replay", f"{WITH} SELECT seq_no, event_id FROM log WHERE seq_no >= 4 ORDER BY seq_no LIMIT 1000")
def ledger_seek_replay(spark, sf_dir):
    return consume.page(event_log(spark, sf_dir), 3, 1000).select("seq_no", "event_id")


def _written(spark: SparkSession, sf_dir: str) -> str:
    from loglake.sources.segments import write_log

    path = fresh_path(spark, "log")
    log = segmented(spark, sf_dir).withColumn("payload", F.col("props").cast("binary"))
    write_log(log.select("segment_id", "seq_no", "payload", "content_type", "schema_id"), path)
    return path


@register("binary_scan", f"{SEGMENTED} SELECT segment_id, byte_offset, seq_no, content_type, schema_id, payload_length, props AS payload, frame_bytes, CAST(NULL AS VARCHAR) AS error_code FROM placed")
def binary_scan(spark, sf_dir):
    frames = spark.read.format("loglake").option("path", _written(spark, sf_dir)).load()
    return frames.select("segment_id", "byte_offset", "seq_no", "content_type", "schema_id", "payload_length", F.col("payload").cast("string").alias("payload"), "frame_bytes", "error_code")


@register("binary_seek", f"{SEGMENTED} SELECT segment_id, seq_no, props AS payload FROM placed WHERE seq_no >= 900")
def binary_seek(spark, sf_dir):
    frames = spark.read.format("loglake").option("path", _written(spark, sf_dir)).load()
    return frames.where("seq_no >= 900").select("segment_id", "seq_no", F.col("payload").cast("string").alias("payload"))


@register("crc_valid", f"{WITH} SELECT seq_no, event_id % 7 <> 3 AND NOT (event_id % 11 = 5 AND strlen(props) > 0) AS valid FROM log")
def crc_valid(spark, sf_dir):
    """Every seventh frame has another number in its header than the one its checksum was made of, every eleventh a changed byte
    in its payload."""
    log = event_log(spark, sf_dir)
    four = lambda n: _le(n, 8)
    head = lambda seq: F.concat(F.unhex(F.lit("5045434C")), F.unhex(F.lit("0100")), F.unhex(F.lpad(F.hex(F.col("content_type").cast("int")), 2, "0")), F.unhex(F.lit("00")), four(F.col("schema_id")), _le(seq, 16), four(F.col("payload_length")))
    payload = F.col("props").cast("binary")
    flip = F.when(F.substring(payload, 1, 1) == F.unhex(F.lit("00")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    found = F.when((F.col("event_id") % 11 == 5) & (F.octet_length(payload) > 0), F.concat(flip, F.substring(payload, 2, 1 << 30))).otherwise(payload)
    seq = F.when(F.col("event_id") % 7 == 3, F.col("seq_no") + 1).otherwise(F.col("seq_no"))
    made = log.select("seq_no", head(seq).alias("head"), found.alias("payload"), F.crc32(F.concat(head(F.col("seq_no")), payload)).alias("crc"))
    return made.select("seq_no", header.crc_valid(F.col("head"), F.col("payload"), F.col("crc")).alias("valid"))


def _le(n, digits: int):
    h = F.lpad(F.hex(n.cast("long")), digits, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in range(digits - 1, 0, -2))))


def _delivered(spark, sf_dir, route) -> DataFrame:
    """A push consumer run to the tail over the binary log: what its sinks got."""
    from loglake.streaming.pipeline import entries

    path, out = _written(spark, sf_dir), fresh_path(spark, "delivered")
    frames = spark.readStream.format("loglake").option("path", path).load()
    routed_ = route(entries(frames)).select("sink", "seq_no", "block_pos", "content_type", F.col("payload").cast("string").alias("payload"))
    q = routed_.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoints/c").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(routed_.schema).parquet(out)


@register("stream_broadcast", f"{WITH} SELECT sink, seq_no, CAST(0 AS INTEGER) AS block_pos, content_type, props AS payload FROM log, (VALUES ('s0'), ('s1'), ('s2')) t(sink)")
def stream_broadcast(spark, sf_dir):
    return _delivered(spark, sf_dir, lambda e: routing.broadcast(e, SINKS))


@register("stream_content_type", f"{WITH} SELECT sink, seq_no, CAST(0 AS INTEGER) AS block_pos, content_type, props AS payload FROM log JOIN {FILTERS_SQL} ON kind = content_type")
def stream_content_type(spark, sf_dir):
    return _delivered(spark, sf_dir, lambda e: routing.by_content_type(e, FILTERS))


@register("stream_hash", f"{WITH} SELECT 's' || (seq_no % 3) AS sink, seq_no, CAST(0 AS INTEGER) AS block_pos, content_type, props AS payload FROM log")
def stream_hash(spark, sf_dir):
    return _delivered(spark, sf_dir, lambda e: routing.by_hash(e, SINKS, F.col("seq_no")))
