"""Outlines of source files as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.outline import outline

ROWS = "path string, line int, end_line int, depth int, kind string, name string, signature string"
KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
#: Lines that stand for a file without an outline.
FIRST_LINES = 50


def outlines(files: DataFrame) -> DataFrame:
    """(path, line, end_line, depth, kind, name, signature) of what files (path, language, content) define, in Python, JavaScript, TypeScript, Go, Rust, Java, C and C++. Null or empty files and other languages define nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = [(path, *x) for path, language, content in zip(*(b.column(k).slice(lo, 256).to_pylist() for k in range(3)), strict=True) for x in outline(content, language)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], [c.split(" ")[0] for c in ROWS.split(", ")])

    return files.select(F.col("path").cast("string"), F.col("language").cast("string"), F.col("content").cast("string")).mapInArrow(run, ROWS)


def source_outlines(files: DataFrame, found: DataFrame | None = None, most: int = 100) -> DataFrame:
    """(path, outline): a file's signatures, indented by their depth, at most `most` with a note on the rest; the first 50 lines of a file that defines nothing. Paths are unique."""
    found = outlines(files) if found is None else found
    place = Window.partitionBy("path").orderBy("line", "depth", "signature")
    few = found.withColumn("_k", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy("path")))
    few = few.where((F.col("_n") <= most) | (F.col("_k") < most))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.concat(F.repeat(F.lit("    "), F.col("depth")), "signature").alias("s")))), lambda x: x["s"]), "\n")
    note = F.when(F.max("_n") > most, F.format_string("\n... (%d more)", F.max("_n") - (most - 1))).otherwise("")
    lines = few.groupBy("path").agg(F.concat(text, note).alias("_outline"))
    head = F.array_join(F.slice(F.split(F.coalesce("content", F.lit("")), "\n"), 1, FIRST_LINES), "\n")
    return files.select("path", head.alias("_head")).join(lines, "path", "left").select("path", F.coalesce("_outline", "_head").alias("outline"))
