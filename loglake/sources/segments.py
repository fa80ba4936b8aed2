"""The binary segment files as a Spark data source: spark.read / readStream / write .format("loglake").

Options: path (of the log; segments lie in its folder `segments`), and for reading start_segment and start_offset. A
partition is one segment, or several small ones on end (of PACK_BYTES at most, counting OPEN_BYTES for the opening of each).
A stream's offset is a place (segment, offset) that ends on a complete frame, so the partial
tail of a segment that is being written is left for later; startingOffsets is earliest or latest; maxBytesPerTrigger bounds
a batch, for which a restarted query needs `checkpoint`, its checkpoint folder (not for availableNow, which asks for the end
once). Filters on seq_no skip segments by their first frame, found by bisection. A write may go on in a segment that is there (resume_segment,
resume_offset). Files are reached through Arrow's file systems, by any uri these know.
"""

from __future__ import annotations

import functools
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from loglake import schema as S
from loglake.functions import wire

BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20
PACK_BYTES = 128 << 20
OPEN_BYTES = 4 << 20
READ_BYTES = 1 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def list_segments(path: str) -> list[tuple[int, str, int]]:
    """(id, path, bytes) of the segment files, by id; files of other names are passed over."""
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/segments", allow_not_found=True))
    return sorted((n, f.path, f.size) for f in found if f.is_file and (n := wire.segment_id(f.base_name)) is not None)


@dataclass
class Span:
    segment: int
    file: str
    start: int
    end: int


def packed(spans: list[Span]) -> list[InputPartition]:
    """Partitions of spans on end; one without any for an empty read."""
    out, size = [[]], 0
    for x in spans:
        cost = x.end - x.start + OPEN_BYTES
        if out[-1] and size + cost > PACK_BYTES:
            out.append([])
            size = 0
        out[-1].append(x)
        size += cost
    return [InputPartition(x) for x in out]


def _row(segment: int, f: wire.Frame) -> tuple:
    return (segment, f.offset, f.seq_no, f.version, f.flags, f.content_type, f.schema_id, f.payload_length, f.payload, f.size, f.error)


def _batches(path: str, spans: list[Span], keep) -> Iterator:
    """Arrow batches of the spans' frames, bounded by rows and bytes."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(S.FRAME)
    system, _ = _open(path)
    rows, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    for span in spans:
        with io.BufferedReader(system.open_input_file(span.file), READ_BYTES) as f:
            for x in wire.frames(f, span.start, span.end):
                if x.error or keep(x.seq_no):
                    rows.append(_row(span.segment, x))
                    size += x.size
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = (int(options.get("start_segment", 0)), int(options.get("start_offset", 0)))
        self.low, self.high = 0, (1 << 63) - 1

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("seq_no",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f  # Spark checks it again: frames with errors pass here

    def _first_seq(self, system, file: str) -> int | None:
        with system.open_input_file(file) as f:
            head = f.read(S.HEADER_BYTES)
        if len(head) < S.HEADER_BYTES:
            return None
        magic, version, *_, seq, _n = wire.HEADER.unpack(head)
        return seq if magic == S.RECORD_MAGIC and version == S.VERSION else None

    def _within(self, found: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """The segments that may have numbers from low to high. Their first numbers rise; one that cannot be read tells
        nothing, and its segment stays unless those around it rule it out."""
        system, _ = _open(self.path)
        first = functools.cache(lambda i: self._first_seq(system, found[i][1]))

        def last_upto(bound: int) -> int:
            best, low, high = -1, 0, len(found)
            while low < high:
                at = middle = (low + high) // 2
                while at >= low and first(at) is None:
                    at -= 1
                if at >= low and first(at) > bound:
                    high = at
                else:
                    best, low = max(best, at if at >= low else -1), middle + 1
            return best

        begin, end = max(last_upto(self.low), 0), last_upto(self.high) + 1
        while end < len(found) and first(end) is None:
            end += 1
        return found[begin:end]

    def partitions(self):
        found = [x for x in list_segments(self.path) if x[0] >= self.start[0] and x[2]]
        if self.low > 0 or self.high < (1 << 63) - 1:
            found = self._within(found)
        return packed([Span(n, f, self.start[1] if n == self.start[0] else 0, size) for n, f, size in found])

    def read(self, partition):
        return _batches(self.path, partition.value, lambda seq: seq is not None and self.low <= seq <= self.high)


class SegmentStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.latest = options["path"], options.get("startingOffsets", "earliest") == "latest"
        self.start = (int(options["start_segment"]), int(options.get("start_offset", 0))) if "start_segment" in options else None
        self.most, self.checkpoint = int(options.get("maxBytesPerTrigger", 0)), options.get("checkpoint")
        self.known: tuple[int, int] = (0, 0)
        self.given: tuple[int, int] | None = None

    def _tail(self) -> tuple[int, int]:
        """The end of the last complete frame; frames that were seen before are not read again."""
        found = list_segments(self.path)
        if not found:
            return 0, 0
        segment, file, size = found[-1]
        system, _ = _open(self.path)
        with system.open_input_file(file) as f:
            self.known = (segment, wire.last_end(f, self.known[1] if self.known[0] == segment else 0, size))
        return self.known

    def _logged(self) -> tuple[int, int] | None:
        """The last end in the query's own offset log: where a restarted query goes on."""
        from pyarrow import fs

        system, root = _open(self.checkpoint)
        found = system.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
        names = [int(x.base_name) for x in found if x.base_name.isdigit()]
        if not names:
            return None
        with system.open_input_file(f"{root}/offsets/{max(names)}") as f:
            at = json.loads(f.read().decode().splitlines()[-1])
        at = json.loads(at) if isinstance(at, str) else at
        return at["segment"], at["offset"]

    def _bounded(self, start: tuple[int, int], tail: tuple[int, int]) -> tuple[int, int]:
        """As far from start towards the tail as maxBytesPerTrigger goes, a frame at least."""
        system, _ = _open(self.path)
        at, left = start, self.most
        for n, file, size in list_segments(self.path):
            if not start[0] <= n <= tail[0]:
                continue
            low, high = start[1] if n == start[0] else 0, tail[1] if n == tail[0] else size
            if high - low <= left:
                at, left = (n, high), left - (high - low)
                continue
            if at == start or left > 0:
                with system.open_input_file(file) as f:
                    to = wire.last_end(f, low, high, left)
                if at == start or to - low <= left:
                    at = (n, to if to > low else high)  # nothing readable is passed as a whole
            break
        return max(at, start)

    def initialOffset(self) -> dict:
        found = list_segments(self.path)
        first = found[0][0] if found else 0
        self.given = self._tail() if self.latest and self.start is None else max(self.start or (first, 0), (first, 0))
        return {"segment": self.given[0], "offset": self.given[1]}

    def latestOffset(self) -> dict:
        tail = self._tail()
        if self.most:
            if self.given is None:
                if self.checkpoint is None:
                    raise ValueError("maxBytesPerTrigger needs the option checkpoint to go on after a restart")
                self.given = self._logged() or (0, 0)
            tail = self.given = max(self._bounded(self.given, tail), self.given)
        return {"segment": tail[0], "offset": tail[1]}

    def partitions(self, start: dict, end: dict):
        a, b = (start["segment"], start["offset"]), (end["segment"], end["offset"])
        spans = []
        for n, file, size in list_segments(self.path):
            if a[0] <= n <= b[0]:
                low, high = a[1] if n == a[0] else 0, b[1] if n == b[0] else size
                if low < high:
                    spans.append(Span(n, file, low, high))
        return packed(spans)

    def read(self, partition):
        return _batches(self.path, partition.value, lambda seq: seq is not None)


@dataclass
class Written(WriterCommitMessage):
    files: list


class SegmentWriter(DataSourceArrowWriter):
    """Rows (segment_id, seq_no, payload, content_type, schema_id, flags), each segment within one task in seq order:
    see write_log(). Files get their names when all tasks are done; old ones of an overwrite go last, so that a crash on the
    way leaves either log with its first segments whole. The segment that a write goes on in is copied up to that place."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.names = options["path"], schema.fieldNames()
        self.compression = options.get("compression", "none")
        self.resume = (int(options.get("resume_segment", -1)), int(options.get("resume_offset", 0)))
        self.overwrite = overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = _open(self.path)
        system.create_dir(f"{root}/segments")
        files, out, current, last = [], None, None, -1
        suffix = f".{TaskContext.get().taskAttemptId()}.tmp"
        try:
            for batch in iterator:
                cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
                given = dict(zip(batch.schema.names, cols))
                none = [0] * batch.num_rows
                for segment, seq, payload, kind, schema, flags in zip(given["segment_id"], given["seq_no"], given["payload"], *(given.get(c, none) for c in ("content_type", "schema_id", "flags"))):
                    if segment != current:
                        if out:
                            out.close()
                        current, last = segment, -1
                        name = f"{root}/segments/{wire.segment_name(current)}"
                        out = system.open_output_stream(name + suffix)
                        files.append((name + suffix, name))
                        if current == self.resume[0]:
                            _copy(system, name, out, self.resume[1])
                    if seq <= last:
                        raise ValueError(f"segment {current}: {seq} comes after {last}")
                    last = seq
                    out.write(wire.encode_frame(payload, last, kind or 0, schema or 0, (flags or 0) & S.FLAG_BLOCK, self.compression))
        except BaseException:
            if out:
                out.close()
            for temporary, _ in files:
                system.delete_file(temporary)
            raise
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, _ = _open(self.path)
        before = list_segments(self.path) if self.overwrite else []
        fresh = {name: temporary for m in messages if m for temporary, name in m.files}
        for name in sorted(fresh):
            system.move(fresh[name], name)
        for _, file, _ in reversed(before):
            if file not in fresh:
                system.delete_file(file)

    def abort(self, messages):
        system, _ = _open(self.path)
        for m in messages:
            for temporary, _ in m.files if m else ():
                system.delete_file(temporary)


def _copy(system, name: str, out, size: int) -> None:
    with system.open_input_stream(name) as f:
        while size and (part := f.read(min(size, BATCH_BYTES))):
            out.write(part)
            size -= len(part)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loglake"

    def schema(self) -> StructType:
        return S.FRAME

    def reader(self, schema):
        return SegmentReader(self.options)

    def streamReader(self, schema):
        return SegmentStreamReader(self.options)

    def writer(self, schema, overwrite):
        return SegmentWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)


def write_log(log: DataFrame, path: str, mode: str = "overwrite", compression: str = "none", resume: tuple[int, int] | None = None) -> None:
    """Writes a log with segment_id as segment files: a segment is written by one task, in seq order. resume: a segment that
    is there, and the place in it after which its new records come."""
    register(log.sparkSession)
    columns = [c for c in ("segment_id", "seq_no", "payload", "content_type", "schema_id", "flags") if c in log.columns]
    dealt = log.select(*columns).repartition("segment_id").sortWithinPartitions("segment_id", "seq_no")
    w = dealt.write.format("loglake").mode(mode).option("path", path).option("compression", compression)
    if resume is not None:
        w = w.option("resume_segment", resume[0]).option("resume_offset", resume[1])
    w.save()


def read_checkpoint(path: str) -> tuple[tuple[int, int, int, int] | None, str | None]:
    return wire.decode_checkpoint(_bytes(path, "checkpoint.dat"))


def read_cursor(path: str, consumer: str) -> tuple[tuple[int, int, int] | None, str | None]:
    return wire.decode_cursor(_bytes(path, f"cursors/{wire.check_name(consumer)}.cur"), consumer)


def write_checkpoint(path: str, last_segment: int, last_offset: int, last_seq: int, active: int) -> None:
    _replace(path, "checkpoint.dat", wire.encode_checkpoint(last_segment, last_offset, last_seq, active))


def write_cursor(path: str, consumer: str, segment: int, offset: int, seq_no: int) -> None:
    _replace(path, f"cursors/{consumer}.cur", wire.encode_cursor(consumer, segment, offset, seq_no))


def _bytes(path: str, name: str) -> bytes | None:
    system, root = _open(path)
    try:
        with system.open_input_file(f"{root}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def delete_folder(path: str, name: str) -> None:
    """Deletes a folder of the log; one that is not there is no failure."""
    system, root = _open(path)
    try:
        system.delete_dir(f"{root}/{name}")
    except FileNotFoundError:
        pass


def folders(path: str, name: str) -> list[str]:
    """The names of the folders in a folder of the log."""
    from pyarrow import fs

    system, root = _open(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/{name}", allow_not_found=True)) if not f.is_file)


def patch(file: str, at: int, path: str) -> None:
    """Turns over the bits of one byte of a segment file: for tests of what damage does."""
    system, _ = _open(path)
    with system.open_input_file(file) as f:
        data = bytearray(f.read())
    data[at] ^= 0xFF
    with system.open_output_stream(file) as f:
        f.write(bytes(data))


def _replace(path: str, name: str, data: bytes) -> None:
    """Written beside, then renamed: a reader sees the old file or the new one."""
    system, root = _open(path)
    system.create_dir(f"{root}/{name}".rpartition("/")[0])
    with system.open_output_stream(f"{root}/{name}.tmp") as f:
        f.write(data)
    system.move(f"{root}/{name}.tmp", f"{root}/{name}")


def last_written(path: str) -> dict[int, float]:
    """When each segment file was last written, in seconds since 1970."""
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/segments", allow_not_found=True))
    return {n: f.mtime_ns / 1e9 for f in found if f.is_file and (n := wire.segment_id(f.base_name)) is not None}


def delete_segments(path: str, ids: list[int]) -> None:
    """Deletes segment files; one that is gone already is no failure."""
    system, root = _open(path)
    for n in ids:
        try:
            system.delete_file(f"{root}/segments/{wire.segment_name(n)}")
        except FileNotFoundError:
            pass
