"""Streaming O19: text logs that are still being written, as a Python Data
Source of records.

The offset of a stream is, for each file, the byte up to which its records are
complete: where its last record starts, as more lines may still follow that
one. A micro-batch reads each file from its old offset to its new one, in
ranges of ``partition_bytes``: a range's task skips to the first record that
starts in the range and reads on past the range's end until its last record
ends, so a large log is read by many tasks and no record is cut or read twice.

The driver only looks for the last record's start: it reads a file's end
backwards, a block at a time, and not what it has looked at before. (A file
without any record is so read through once.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parley.sources import logtext

FORMAT = "parley_log"
SCHEMA = "file string, start long, is_record boolean, body string"
PARTITION_BYTES = 64 << 20
BLOCK = 1 << 20
_START = re.compile(logtext.RECORD_START.encode(), re.M)  # after a line feed only


@dataclass
class LogRange(InputPartition):
    """The records of ``file`` that start in ``[lo, hi)``; the batch has its
    bytes ``[first, end)``, which are whole records."""

    file: str
    first: int
    lo: int
    hi: int
    end: int


def _file_system(path: str):
    """The file system that ``path`` names and the path in it."""
    from pyarrow import fs as pafs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_under(path: str) -> dict[str, int]:
    """Sizes of the files at ``path``: itself, or all below it whose names (and
    folders) don't start with ``_`` or ``.``."""
    from pyarrow import fs as pafs
    fs, root = _file_system(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return {root: info.size}
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "_." for x in p[len(root):].strip("/").split("/"))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and not hidden(f.path)}


def opened(root: str, file: str):
    """A random-access file of the file system that ``root`` names."""
    return _file_system(root)[0].open_input_file(file)


def last_start(f, size: int, seen: int = 0, block: int = BLOCK) -> int | None:
    """Where the last record that starts in the first ``size`` bytes starts, if
    that is at ``seen`` or later."""
    hi, tail = size, b""
    while hi > seen:
        lo = max(seen, hi - block)
        data = f.read_at(hi - lo, lo) + tail
        at = 0 if lo == 0 or f.read_at(1, lo - 1) == b"\n" else data.find(b"\n") + 1
        if at or lo == 0 or f.read_at(1, lo - 1) == b"\n":
            marks = [m.start() for m in _START.finditer(data, at)]
            if marks:
                return lo + marks[-1]
            tail = data[:at]  # a line that starts before this block
        else:
            tail = data
        hi = lo
    return None


def records_in(f, part: LogRange, block: int = BLOCK) -> Iterator[tuple[int, bool, bytes]]:
    """``start, is_record, body`` of a range: its records, without their last
    line feed. Lines before the first record of all that the batch has of the
    file are a row each, told by the range that starts there."""
    pos = part.lo
    if part.lo > part.first:  # go to the first line that starts at lo or later
        pos = part.lo - 1
        while pos < part.end:
            data = f.read_at(min(block, part.end - pos), pos)
            at = data.find(b"\n")
            if at >= 0:
                pos += at + 1
                break
            pos += len(data)
    lone = part.lo == part.first
    held, begun = [], -1  # the open record
    rest: list[bytes] = []  # an unfinished line
    base = pos  # where rest starts
    while pos < part.end:
        data = f.read_at(min(block, part.end - pos), pos)
        if not data:
            break
        pos += len(data)
        cut = len(data) if pos >= part.end else data.rfind(b"\n") + 1
        if not cut:
            rest.append(data)
            continue
        lines = b"".join([*rest, data[:cut]])
        marks = [m.start() for m in _START.finditer(lines)]
        head = lines[:marks[0]] if marks else lines
        if head and begun >= 0:
            held.append(head)
        elif head and lone:
            at = base
            for line in head.removesuffix(b"\n").split(b"\n"):
                yield at, False, line
                at += len(line) + 1
        for m, end in zip(marks, [*marks, len(lines)][1:], strict=True):
            if begun >= 0:
                yield begun, True, b"".join(held).removesuffix(b"\n")
            if base + m >= part.hi:
                return
            held, begun = [lines[m:end]], base + m
        base, rest = base + len(lines), [data[cut:]] if cut < len(data) else []
        if begun < 0 and not lone and base >= part.hi:
            return  # all of the range belongs to a record that starts before it
    if begun >= 0:
        yield begun, True, b"".join(held).removesuffix(b"\n")


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.drain = str(options.get("drain", "false")).lower() == "true"
        self.seen: dict[str, tuple[int, int]] = {}  # of a file: bytes looked at, last start

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes = files_under(self.path)
        if self.drain:
            return sizes
        now = {}
        for file, size in sizes.items():
            looked, start = self.seen.get(file, (0, 0))
            if size < looked:
                looked, start = 0, 0
            if size > looked:
                with opened(self.path, file) as f:
                    # A line that was unfinished then may start a record now.
                    found = last_start(f, size, start)
                start = start if found is None else found
                self.seen[file] = (size, start)
            now[file] = start
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for file, to in sorted(end.items()):
            at = start.get(file, 0)
            if to < at:
                if files_under(self.path).get(file, 0) >= at:
                    raise ValueError(f"{file} was drained up to byte {at} and went on with lines of no record")
                at = 0  # written anew
            parts += [LogRange(file, at, lo, min(lo + self.size, to), to) for lo in range(at, to, self.size)]
        return parts

    def read(self, partition: LogRange) -> Iterator:
        import pyarrow as pa
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("is_record", pa.bool_()), ("body", pa.string())])
        rows, size = [], 0

        def batch():
            start, is_record, body = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.file] * len(rows)), pa.array(start, pa.int64()), pa.array(is_record, pa.bool_()),
                 pa.array([b.decode("utf-8", "replace") for b in body], pa.string())], schema=schema)

        with opened(self.path, partition.file) as f:
            for row in records_in(f, partition):
                rows.append(row)
                size += len(row[2])
                if len(rows) >= 10_000 or size >= 4 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


def stream_growing_log(spark: SparkSession, path: str, *, drain: bool = False,
                       partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Streaming O19 for logs that grow, and for large ones: records ``file,
    start, ts, level, message``. ``start`` is the record's byte in its file, so
    it orders the records of a file as the batch reader's ``rec`` does. Lines
    before a file's first record are rows of their own with NULL ts and level.

    A file's last record is told when the next one starts; the last ones of all
    files are told by a run with ``drain`` (same checkpoint), which takes files
    to be finished: one that goes on afterwards must go on with a record, else
    the stream fails. A file that is shorter than before was written anew and is
    read from its start. Bytes that are no UTF-8 become U+FFFD. ``path`` is a
    file or folder that pyarrow can open on the driver and all executors.
    """
    spark.dataSource.register(LogSource)
    raw = (spark.readStream.format(FORMAT).option("path", path).option("drain", str(drain).lower())
           .option("partitionBytes", str(partition_bytes)).load())
    lines = F.split(F.col("body"), "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return raw.select("file", "start", *logtext._parsed(F.element_at(lines, 1), rest, F.col("is_record")))
