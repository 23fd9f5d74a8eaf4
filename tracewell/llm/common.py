"""Shared parts: tables in the shared folder, flat byte buffers, rolling hashes, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)  # odd: it has an inverse modulo 2^64
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_scan(df: DataFrame) -> bool:
    """Whether a plan is nothing but a scan of files and projections: each row of the files comes once, and none is left out."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.nodeName().split(" ")[0] in ("LogicalRelation", "Relation")


def placed_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """_file, _row and the columns (new name: old name): each row's place in its Parquet file, the same whenever it is read, and gapless.

    Only a whole scan of Parquet files has such places; what is filtered, exploded, sampled, joined or not read from Parquet is written to the shared folder first, and the rows are placed there.
    """
    own = df.select(*[F.col(old).alias(new) for new, old in columns.items()])
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    if whole_scan(df):
        try:
            return df.select(*at, *[F.col(old).alias(new) for new, old in columns.items()])
        except AnalysisException:  # files of another kind
            pass
    return saved(own, "rows", codec="zstd").select(*at, *columns)


def size_of(df: DataFrame) -> int:
    """Bytes of a saved table as Spark's own statistics have it (files on disk)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def row_key(*cols: str) -> Column:
    """A key of a row's content, the same for nulls in the same places."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols])


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[0] = both
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] covers data[:i]; (h[e] - h[s]) * BASE^-s is the hash of data[s:e]."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64) * GOLD)


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and their n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Returns freed memory to the machine: Python workers stay for the next stage and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20, last: bool = True) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes in the column, or one row if that alone has more."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = flat(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
    if last:  # a task's own input, not a part of it
        give_back()


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component, for the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (nxt := new[new]).tobytes() != new.tobytes():
            new = nxt
        if (new == root).all():
            return root
        root = new


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of equal runs in a sorted array, with its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups from a stream sorted by key: each holds the groups that end in a batch."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not b.num_rows:
            continue
        p = b.to_pandas()
        last = p[key].iloc[-1]
        if p[key].iloc[0] == last and (not rest or rest[-1][key].iloc[-1] == last):
            rest.append(p)
            continue
        cut = int((p[key].to_numpy() == last).argmax())
        yield pd.concat([*rest, p.iloc[:cut]], ignore_index=True)
        rest = [p.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)
    rest.clear()
    give_back()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id that links reach, for every node that an edge names.

    Alternates large-star and small-star, which need a logarithmic number of rounds, and ends when a round changes nothing.
    Each round is written to the shared folder; the minimum of a node's neighbours is a partial aggregate, and Spark can split the joins on a node with many of them.
    """
    now = saved(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = lambda: tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    seen = state()
    for _ in range(60):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = saved(large.distinct(), "large")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        before, seen = seen, state()
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
