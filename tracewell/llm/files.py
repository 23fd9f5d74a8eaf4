"""Flat files in the folder that driver and executors share, written and read by executors at byte offsets.

A task names its files itself and hands their names on as rows, which Spark commits once for each task: files of an attempt that was lost or repeated are never named.
"""

from __future__ import annotations

import contextlib
import math
import re
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from .common import shared_dir

#: Bytes that a task reads or writes, and the most tasks that are asked for.
TASK_BYTES, MOST_TASKS = 64 << 20, 20_000


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a name with or without a scheme."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (pa.fs.LocalFileSystem(), uri) if uri.startswith("/") else pa.fs.FileSystem.from_uri(uri)


def create(where: str, name: str, end: str = ".bin") -> tuple[str, pa.NativeFile]:
    """A new file of this attempt in a folder: its name and its stream."""
    fs, path = located(where)
    fs.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}{end}"
    return f"{where}/{file}", fs.open_output_stream(f"{path}/{file}", compression=None)


def remove(where: str) -> None:
    """Deletes a folder with its files, if there is one."""
    fs, path = located(where)
    with contextlib.suppress(OSError):  # none was written, or an attempt that was lost still writes there
        fs.delete_dir(path)


class Replaced:
    """A file of a fixed name, which appears whole when it is done: an attempt that is repeated writes the same again."""

    def __init__(self, name: str) -> None:
        self.fs, self.path = located(name)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.own)

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.own, self.path)


class Reader:
    """Reads byte ranges, and keeps the last file open."""

    def __init__(self) -> None:
        self.name, self.file = "", None

    def read(self, name: str, start: int, size: int) -> bytes:
        if name != self.name:
            self.close()
            fs, path = located(name)
            self.name, self.file = name, fs.open_input_file(path)
        got = self.file.read_at(size, start)
        if len(got) != size:
            raise OSError(f"{name} ends before byte {start + size}")
        return got

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = "", None


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks for so many bytes: every core has some, and none of them many bytes until there are MOST_TASKS."""
    return max(2 * spark.sparkContext.defaultParallelism, min(MOST_TASKS, math.ceil(size / TASK_BYTES)))


def spread(rows: DataFrame, size: int, *cols: str) -> DataFrame:
    """Rows that name bytes, dealt to tasks by the bytes that they stand for and not by their own few."""
    return rows.repartition(tasks_for(rows.sparkSession, size), *cols)
