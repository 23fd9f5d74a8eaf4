"""Growing logs of lines as a data source with offsets of file and byte, for batch and for streams: `spark.read.format("tail")`, `spark.readStream.format("tail")` after `register(spark)`.

Rows are (path, offset, line, complete): the line's file, the byte at which it begins, the line without its end, and whether all lines before it in this file were read as well. Bytes that are not UTF-8 become replacement characters.

Options: `path`, a folder or file that driver and executors share (local or any that pyarrow opens); `glob` for names in a folder, `*.jsonl` by default; `firstLook`, the bytes at the end of a file that is seen for the first time, 200,000 by default, or `all`; `maxBytes`, the bytes of a task, and of a file in one trigger of a stream, 8 MB by default; `since` (batch only), an ISO time: files of at least 8 MB whose lines are in order of their `timestamp` are entered near the first line of that time, found by halving, less 4 MB for lines that are slightly out of order.

A stream ends every span at a line's end, so a line that is still being written waits, and comes once, whole. What is behind the last trigger's end comes with the next one. A file that has become shorter was rotated, and is looked at as a new one. A longer line than maxBytes is read whole. In a batch a last line without an end is a line; in a batch firstLook is `all` unless it is given.
After a restart the first trigger takes all that has come meanwhile, in tasks of maxBytes. Empty files and folders have no rows; files that are gone are forgotten.
"""

from __future__ import annotations

import fnmatch
import re
import sys
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, line string, complete boolean"
FIRST_LOOK, MAX_BYTES, SINCE_LEAST, BACK_OFF = 200_000, 8 << 20, 8 << 20, 4 << 20
STEP, LINES = 1 << 16, 10_000
STAMP = re.compile(rb'"(?:timestamp|ts)"\s*:\s*"([^"]+)"')


class Span(InputPartition):
    """Lines that begin in a range of bytes of a file."""

    def __init__(self, path: str, start: int, end: int, complete: bool) -> None:
        self.path, self.start, self.end, self.complete = path, start, end, complete


def located(path: str) -> tuple[pa.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), path) if path.startswith("/") else pa.fs.FileSystem.from_uri(path)


def sizes(path: str, glob: str) -> dict[str, int]:
    """The files of a folder whose names fit, or one file, with their sizes."""
    fs, where = located(path)
    info = fs.get_file_info(where)
    if info.type == pa.fs.FileType.NotFound:
        return {}
    found = [info] if info.type == pa.fs.FileType.File else [f for f in fs.get_file_info(pa.fs.FileSelector(where, recursive=True)) if f.type == pa.fs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob)]
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path)}


def line_start(file: pa.NativeFile, at: int, size: int) -> int:
    """The first place from `at` on at which a line begins; `size` if there is none."""
    if at <= 0:
        return 0
    at -= 1
    while at < size:
        part = file.read_at(min(STEP, size - at), at)
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return size


def last_end(file: pa.NativeFile, least: int, size: int) -> int:
    """The place behind the last line's end between two places; the first of them if there is none."""
    while size > least:
        at = max(least, size - STEP)
        found = file.read_at(size - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        size = at
    return least


def span_end(file: pa.NativeFile, start: int, size: int, most: int) -> int:
    """Where a span from a line's start ends: at the last line's end within `most` bytes, or behind the first line if that is longer and whole."""
    end = last_end(file, start, min(size, start + most))
    if end == start and size > start + most:
        following = line_start(file, start + most, size)
        end = following if following < size or file.read_at(1, size - 1) == b"\n" else start
    return end


def moment(stamp: str) -> datetime | None:
    try:
        t = datetime.fromisoformat(stamp)
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def first_since(file: pa.NativeFile, size: int, since: datetime) -> int:
    """A line's start before which no line is of that time, if lines are in order up to BACK_OFF bytes."""
    low, high = 0, size
    while high - low > STEP:
        middle = line_start(file, (low + high) // 2, size)
        stamps = STAMP.search(file.read_at(min(STEP * 4, size - middle), middle))
        seen = moment(stamps[1].decode("utf-8", "replace")) if stamps else None
        if seen is None or middle >= high:
            high = (low + high) // 2  # no time there: rather too early
        elif seen < since:
            low = middle
        else:
            high = (low + high) // 2
    return line_start(file, max(0, low - BACK_OFF), size)


def lines_of(span: Span) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a span, read some at a time; the last one goes on behind it."""
    fs, path = located(span.path)
    with fs.open_input_file(path) as file:
        size = file.size()
        at = line_start(file, span.start, size)
        held, begins, where, rest = [], at, at, b""

        def batch(lines: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([span.path] * len(lines)), pa.array([o for o, _ in lines], pa.int64()), pa.array([x.rstrip(b"\r\n").decode("utf-8", "replace") for _, x in lines]), pa.array([span.complete] * len(lines))], ["path", "offset", "line", "complete"])

        while begins < span.end:
            part = file.read_at(min(1 << 20, size - where), where) if where < size else b""
            where += len(part)
            pieces = (rest + part).split(b"\n")
            rest = pieces.pop()
            for x in pieces:
                if begins >= span.end:
                    break
                held.append((begins, x))
                begins += len(x) + 1
                if len(held) == LINES:
                    yield batch(held)
                    held = []
            if not part:
                if rest and begins < span.end:
                    held.append((begins, rest))
                break
        if held:
            yield batch(held)


def cut(path: str, start: int, end: int, most: int, complete: bool) -> list[Span]:
    return [Span(path, lo, min(end, lo + most), complete) for lo in range(start, end, most)]


class Options:
    def __init__(self, options: dict[str, str], look: str) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        given = options.get("firstLook", look)
        self.look = None if given == "all" else int(given)
        self.most = int(options.get("maxBytes", MAX_BYTES))
        self.since = moment(options["since"]) if options.get("since") else None

    def first(self, file: pa.NativeFile, size: int) -> int:
        """Where a file that is seen for the first time is entered."""
        return 0 if self.look is None or size <= self.look else line_start(file, size - self.look, size)


class TailReader(DataSourceReader):
    def __init__(self, options: Options) -> None:
        self.options = options

    def partitions(self) -> list[Span]:
        out: list[Span] = []
        for path, size in sizes(self.options.path, self.options.glob).items():
            fs, where = located(path)
            with fs.open_input_file(where) as file:
                start = self.options.first(file, size)
                if self.options.since and size >= SINCE_LEAST:
                    start = max(start, first_since(file, size, self.options.since))
            out += cut(path, start, size, self.options.most, start == 0)
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return lines_of(partition) if partition else iter(())


class TailStreamReader(DataSourceStreamReader):
    """Offsets: of each file its end so far, and of how many bytes at its begin a first look left out."""

    def __init__(self, options: Options) -> None:
        self.options, self.now = options, None

    def initialOffset(self) -> dict:
        self.now = {}
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, size in sizes(self.options.path, self.options.glob).items():
            fs, where = located(path)
            with fs.open_input_file(where) as file:
                known = (self.now or {}).get(path)
                if known and known["end"] <= size:
                    out[path] = {"end": span_end(file, known["end"], size, self.options.most), "skipped": known["skipped"], "from": known["from"]}
                else:  # new, rotated, or after a restart
                    end = last_end(file, 0, size)
                    start = self.options.first(file, end)
                    end = end if self.now is None else span_end(file, start, size, max(self.options.most, self.options.look or 0))
                    out[path] = {"end": end, "skipped": start, "from": start}
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out: list[Span] = []
        for path, to in end.items():
            known = start.get(path)
            on = known and known["end"] <= to["end"]
            begin = known["end"] if on else to["from"]
            if on:
                to["skipped"] = known["skipped"]
            out += cut(path, begin, to["end"], self.options.most, to["skipped"] == 0)
        self.now = end
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        self.now = end


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TailReader:
        return TailReader(Options(self.options, "all"))

    def streamReader(self, schema: object) -> TailStreamReader:
        return TailStreamReader(Options(self.options, str(FIRST_LOOK)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The module goes to executors by value, so a cluster needs no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Tail)
