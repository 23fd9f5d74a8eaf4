"""Token counts by a separator scan of flat token files.

A token file is a flat run of ids with an end-of-document id after each document, and no index. Ranges of its bytes, cut without regard to documents, are read at their offsets and searched for that id with one vectorised comparison each; no task holds more than a range, whatever the size of a file.
A range knows the lengths of the documents that lie in it whole. The first one that ends in it began in an earlier range: a prefix scan over the ranges (in groups, so that no task orders more than GROUP of them) carries the tokens, the ends and the place of the last end before each range, and stitches them.

Token files are larger than the compressed table that they are made of. Counts are kept and files are not, so the rows are dealt to ROUNDS by their places in the table: the files of a round are written, searched and deleted before the next, and no more than a round's lie on disk. A row is never split over rounds.

Here documents are tokenised as UTF-8 bytes, ids of 8 bits, and END is 255, which UTF-8 never uses (a byte 255 in a text that is not UTF-8 is written as 254). Files with ids of 16 or 32 bits (little-endian) are read alike.

Nulls: a null or empty text is a document without tokens; a null id is carried along. Rows that repeat are documents of their own. A file without a last end still has its last document; an empty file or table has none. Very long texts are cut over ranges like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, in_pieces, placed_rows, saved
from .files import Reader, create, folder, remove, spread

END, RANGE, GROUP, IDS = 255, 1 << 20, 1 << 12, "<u1"
ROUNDS = 2


def with_ends(column: pa.Array) -> np.ndarray:
    """The tokens of all rows with an end after each."""
    data, off = flat(column)
    out = np.full(len(data) + len(off) - 1, END, IDS)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out[np.arange(len(data)) + row] = np.minimum(data, END - 1)
    return out


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", where: str = "") -> tuple[DataFrame, DataFrame]:
    """(files: file, n_bytes; documents: file, ordinal, id): a flat file for each partition of docs, in a folder, or a new one in the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    where = where or folder(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        ordinal = size = 0

        def row(at: int, n: int | None, ids: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], ["file", "at", "n_bytes", "ids"])

        for b in in_pieces(batches, "t", 4 << 20):
            if stream is None:
                name, stream = create(where, f"{TaskContext.get().partitionId():08d}")
                none = b.column(0).slice(0, 0)
            tokens = with_ends(b.column(1))
            stream.write(tokens.tobytes())
            yield row(ordinal, None, b.column(0))
            ordinal, size = ordinal + b.num_rows, size + tokens.nbytes
        if stream is not None:
            stream.close()
            yield row(ordinal, size, none)

    table = saved(src.mapInArrow(run, f"file string, at long, n_bytes long, ids array<{kind}>"), "tokens")
    names = table.where("n_bytes IS NULL").select("file", "at", F.posexplode("ids").alias("k", id_col)).select("file", (F.col("at") + F.col("k")).alias("ordinal"), id_col)
    return table.where("n_bytes IS NOT NULL").select("file", "n_bytes"), names


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes) of flat files at a path that Spark lists; their content is not read here."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def searched(files: DataFrame, end: int = END, ids: str = IDS, size: int = RANGE) -> DataFrame:
    """(file, block, n, first, last, inner): the ends in each range of files, written as a table; files are not read again. files: file, n_bytes; size: tokens of a range."""
    kind, step = files.schema["file"].dataType.simpleString(), size * np.dtype(ids).itemsize
    files = saved(files.where("n_bytes > 0").select("file", "n_bytes"), "files")
    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / step))).alias("block"))
    ranges = spread(ranges.select("file", "block", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("n_bytes") - F.col("block") * step).cast("long").alias("size")), total, "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                part = b.slice(lo, 16)
                n, first, last, lengths = [], [], [], []
                for name, start, length in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    tokens = np.frombuffer(reader.read(name, start, length), ids)
                    at = np.flatnonzero(tokens == end)
                    n.append(len(tokens))
                    first.append(int(at[0]) if len(at) else None)
                    last.append(int(at[-1]) if len(at) else None)
                    lengths.append(np.diff(at) - 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], ["file", "block", "n", "first", "last", "inner"])
        reader.close()

    return saved(ranges.mapInArrow(search, f"file {kind}, block long, n long, first long, last long, inner array<long>"), "scan")


def stitched(found: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens): the documents of each file in order, from the ends in its ranges."""
    found = found.withColumn("g", F.floor(F.col("block") / GROUP))
    ends = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)

    def before(what, keys, order):
        return what.over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    in_group = found.select("*", F.coalesce(before(F.sum("n"), ["file", "g"], "block"), F.lit(0)).alias("base"), F.coalesce(before(F.sum(ends), ["file", "g"], "block"), F.lit(0)).alias("ends"))
    in_group = in_group.withColumn("before", before(F.max(F.col("base") + F.col("last")), ["file", "g"], "block"))
    groups = in_group.groupBy("file", "g").agg(F.sum("n").alias("gn"), F.sum(ends).alias("ge"), F.max(F.col("base") + F.col("last")).alias("gl"))
    groups = groups.withColumn("gbase", F.coalesce(before(F.sum("gn"), ["file"], "g"), F.lit(0))).withColumn("gends", F.coalesce(before(F.sum("ge"), ["file"], "g"), F.lit(0)))
    groups = groups.withColumn("gbefore", before(F.max(F.col("gbase") + F.col("gl")), ["file"], "g"))
    placed = in_group.join(groups.select("file", "g", "gbase", "gends", "gbefore"), ["file", "g"])
    previous = F.coalesce(F.col("gbase") + F.col("before"), F.col("gbefore"), F.lit(-1))
    opened = F.col("gbase") + F.col("base") + F.col("first") - previous - 1
    whole = placed.where("first IS NOT NULL").select("file", (F.col("gends") + F.col("ends")).alias("o"), F.posexplode(F.concat(F.array(opened), "inner")).alias("k", "n_tokens")).select("file", (F.col("o") + F.col("k")).alias("ordinal"), "n_tokens")
    tail = groups.groupBy("file").agg(F.max(F.col("gbase") + F.col("gn")).alias("n"), F.max(F.col("gends") + F.col("ge")).alias("ordinal"), F.coalesce(F.max(F.col("gbase") + F.col("gl")), F.lit(-1)).alias("last"))
    return whole.unionByName(tail.select("file", "ordinal", (F.col("n") - F.col("last") - 1).alias("n_tokens")).where("n_tokens > 0"))


def scan(files: DataFrame, end: int = END, ids: str = IDS, size: int = RANGE) -> DataFrame:
    """(file, ordinal, n_tokens): the documents of each file in order. files: file, n_bytes; size: tokens of a range."""
    return stitched(searched(files, end, ids, size))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): one row for each row of docs, counted in its token files, which are made and deleted in ROUNDS."""
    rows = placed_rows(docs, {"i": id_col, "t": text_col}).withColumn("round", F.pmod(F.xxhash64("_file", "_row"), F.lit(ROUNDS)))
    rounds = []
    for k in range(ROUNDS):
        where = folder(docs.sparkSession, "tokens")
        files, names = token_files(rows.where(F.col("round") == k), "i", "t", where)
        rounds.append((names, searched(files)))
        remove(where)
    names, found = (reduce(DataFrame.unionByName, parts) for parts in zip(*rounds, strict=True))
    return names.join(stitched(found), ["file", "ordinal"]).select(F.col("i").alias(id_col), "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_tokens FROM documents"
