"""Training-order materialisation: a keyed Feistel permutation with cycle-walking gives every sequence a global slot; range partitions of slots write fixed-stride shards.

1. Documents are cut into sequences of `length` tokens (UTF-8 bytes as 8-bit ids; END = 255 after each document and PAD = 254 behind a last short sequence, which UTF-8 never uses).
2. Sequences are numbered in the order of the table's files (by hashes of their names) and of the rows in each, so every sequence has an index in 0 .. N-1. Only the rows' numbers of sequences are looked at for that: their sums over units of UNIT rows of a file, a prefix sum over the units, then a flat file for each unit with the index of each row's first sequence, 8 bytes a row. The task that reads the texts reads these at its rows' own places, so no text is moved to be numbered, and no key or copy can be hot.
3. The permutation takes the index to a slot in 0 .. N-1: a balanced Feistel network over the next even number of bits, walked on while it leads outside.
4. Slot s belongs to shard s // per_shard. Ranges of shards are dealt to tasks, which write each shard in order of slots as one flat file in the shared folder. Each record has the same stride: id, sequence number and number of tokens (16 bytes), then the tokens. Record r of a shard is at byte r * stride, so a reader goes on from any slot without an index: earlier shards are not opened, and the shard with the slot is read from its byte on.

The order depends on the key and on the table's files and their names, not on how they are cut into partitions or on executors that are lost. Only a whole scan of Parquet files, with or without projections, is numbered where it lies; a DataFrame that is filtered, sampled, exploded, joined or not read from Parquet is written to the shared folder first, and its order is that of the files written. Nulls: a null or empty text has one sequence with END alone; a null id is written as the largest 64-bit number. Ids are 64-bit numbers; others raise an error. Rows that repeat have sequences of their own. An empty table has no shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLD, flat, in_pieces, mix, placed_rows, saved
from .files import Reader, Replaced, create, folder, spread, tasks_for

END, PAD, LENGTH, PER_SHARD, CHUNK, ROUNDS, UNIT, GROUP = 255, 254, 512, 16_384, 1024, 6, 1 << 20, 4096
NULL_ID = np.iinfo(np.int64).max
HEADER = np.dtype([("id", "<i8"), ("seq", "<i4"), ("n", "<i4")])


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 .. n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * GOLD + np.uint64(key % (1 << 64)))
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        y = x[todo]
        left, right = y >> shift, y & mask
        for k in keys:
            left, right = right, left ^ (mix(right * GOLD + k) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def bases(units: DataFrame) -> DataFrame:
    """(file, unit, base): for (file, unit, n) the sum of n over all earlier units, by file and unit; no task orders more than the units of GROUP files, or more than the groups."""
    files = units.groupBy("file").agg(F.sum("n").alias("n"))
    groups = files.withColumn("g", F.pmod(F.xxhash64("file"), F.lit(GROUP))).groupBy("g").agg(F.sum("n").alias("gn"))
    before = lambda n, by, *order: F.coalesce(F.sum(n).over((Window.partitionBy(*by) if by else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("gbase", before("gn", [], "g"))
    files = files.withColumn("g", F.pmod(F.xxhash64("file"), F.lit(GROUP))).withColumn("fbase", before("n", ["g"], "file")).join(groups, "g")
    return units.withColumn("ubase", before("n", ["file"], "unit")).join(files.select("file", "fbase", "gbase"), "file").select("file", "unit", (F.col("gbase") + F.col("fbase") + F.col("ubase")).alias("base"))


def shards(docs: DataFrame, key: int = 20_240_101, length: int = LENGTH, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, file, first_slot, last_slot): the flat files, written to the shared folder."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be a whole number")
    at = [F.xxhash64("_file").alias("file"), F.floor(F.col("_row") / UNIT).alias("unit"), (F.col("_row") % UNIT).alias("r")]
    src = placed_rows(docs, {"i": id_col, "t": text_col}).select(*at, F.coalesce(F.col("i").cast("long"), F.lit(int(NULL_ID))).alias("i"), "t")
    n_seq = F.floor((F.coalesce(F.octet_length("t"), F.lit(0)) + length) / length)  # with the end
    numbers = src.select("file", "unit", "r", n_seq.alias("k"))
    units = saved(numbers.groupBy("file", "unit").agg(F.sum("k").alias("n")), "units")
    n = units.agg(F.sum("n")).first()[0] or 0
    where = folder(spark, "shards")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first sequence of each row, in a flat file for each unit."""
        now, rows, at, file = None, 0, 0, None

        def done() -> pa.RecordBatch:
            file.done()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([rows], pa.int64())], ["file", "unit", "n"])

        for b in batches:
            for lo in range(0, b.num_rows, 1 << 16):
                name, unit, r, k = (b.column(c).slice(lo, 1 << 16).to_numpy(zero_copy_only=False) for c in range(4))
                cut = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (unit[1:] != unit[:-1]))).tolist()
                for s, e in zip(cut, [*cut[1:], len(k)], strict=True):
                    if (name[s], unit[s]) != now:
                        if file:
                            yield done()
                        now, rows, at, file = (name[s], unit[s]), 0, 0, Replaced(f"{where}/first/{name[s]}-{unit[s]}")
                    if r[s] == -1:  # what comes before this unit
                        at, s = int(k[s]), s + 1
                    if e > s and (r[s] != rows or r[e - 1] - r[s] != e - 1 - s):
                        raise RuntimeError(f"the file lacks row {rows}")
                    file.stream.write((at + np.cumsum(k[s:e]) - k[s:e]).astype("<i8").tobytes())
                    at, rows = at + int(k[s:e].sum()), rows + e - s
        if file:
            yield done()

    before = bases(units).select("file", "unit", F.lit(-1).cast("long").alias("r"), F.col("base").alias("k"))
    saved(numbers.unionByName(before).repartition("file", "unit").sortWithinPartitions("file", "unit", "r").mapInArrow(number, "file long, unit long, n long"), "numbered")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in in_pieces(batches, "t", 2 << 20):
            data, off = flat(b.column(4))
            raw, size = data.tobytes(), np.diff(off)
            file, unit, r, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            first = np.empty(len(r), np.int64)
            cut = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (unit[1:] != unit[:-1]) | (r[1:] != r[:-1] + 1))).tolist()
            for s, e in zip(cut, [*cut[1:], len(r)], strict=True):
                first[s:e] = np.frombuffer(reader.read(f"{where}/first/{file[s]}-{unit[s]}", int(r[s]) * 8, (e - s) * 8), "<i8")
            count = (size + length) // length
            for lo in range(0, len(r), 2000):
                hi = min(len(r), lo + 2000)
                k = count[lo:hi]
                seq = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                start = np.repeat(off[:-1][lo:hi], k) + seq * length
                end = np.minimum(start + length, np.repeat(off[1:][lo:hi], k))
                head = np.zeros(len(seq), HEADER)
                head["id"], head["seq"], head["n"] = np.repeat(ids[lo:hi], k), seq, end - start
                slot = feistel(np.repeat(first[lo:hi], k) + seq, n, key)
                codec, heads = pa.Codec("brotli", compression_level=3), head.tobytes()
                parts = [heads[16 * j : 16 * j + 16] + (codec.compress(raw[x:y], asbytes=True) if y > x else b"") for j, (x, y) in enumerate(zip(start.tolist(), end.tolist(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(parts, pa.binary())], ["slot", "t"])
        reader.close()

    n_shards = -(-n // per_shard)
    each = max(1, -(-n_shards // tasks_for(spark, n * (HEADER.itemsize + length))))  # shards of a task

    cut = src.select("file", "unit", "r", "i", "t").mapInArrow(sequences, "slot long, t binary")  # packed, as much is shuffled
    ranged = cut.repartitionById(max(1, -(-n_shards // each)), F.floor(F.col("slot") / (per_shard * each)).cast("int")).sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name, stream, after = -1, "", None, 0

        def done() -> pa.RecordBatch:
            stream.close()
            if after != min(n, (now + 1) * per_shard):
                raise RuntimeError(f"shard {now} ends at slot {after}")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([name]), pa.array([now * per_shard], pa.int64()), pa.array([after - 1], pa.int64())], ["shard", "file", "first_slot", "last_slot"])

        for b in in_pieces(batches, "t", 1 << 20):
            slot = b.column(0).to_numpy()
            records = laid_out([t.as_py() for t in b.column(1)], length)
            shard = slot // per_shard
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(slot)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if shard[s] != now:
                    if stream is not None:
                        yield done()
                    now = int(shard[s])
                    after = now * per_shard
                    name, stream = create(where, f"{now:010d}")
                if slot[s] != after or slot[e - 1] - slot[s] != e - 1 - s:
                    raise RuntimeError(f"shard {now} lacks slot {after}")
                stream.write(records[s:e].tobytes())
                after = int(slot[e - 1]) + 1
        if stream is not None:
            yield done()

    return saved(ranged.mapInArrow(write, "shard int, file string, first_slot long, last_slot long"), "shards")


def laid_out(packed: list[bytes], length: int) -> np.ndarray:
    """Records of one stride, as rows of bytes, from headers with packed texts behind them."""
    head = np.frombuffer(b"".join([p[: HEADER.itemsize] for p in packed]), HEADER).copy()
    size, codec = head["n"].astype(np.int64), pa.Codec("brotli")
    data = np.frombuffer(b"".join([codec.decompress(p[HEADER.itemsize :], m, asbytes=True) if m else b"" for p, m in zip(packed, size.tolist(), strict=True)]), np.uint8)
    tokens = np.full((len(packed), length), PAD, np.uint8)
    row = np.repeat(np.arange(len(packed)), size)
    tokens[row, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)] = data
    short = np.flatnonzero(size < length)
    tokens[short, size[short]] = END
    head["n"] = np.minimum(size + 1, length)
    return np.concatenate([head.view(np.uint8).reshape(len(packed), -1), tokens], 1)


def read_records(files: DataFrame, length: int = LENGTH, start: int = 0) -> DataFrame:
    """(slot, shard, doc_id, seq, n_tokens, record): the records from a slot on, read at their bytes; earlier ones are not read."""
    stride = HEADER.itemsize + length
    files = files.where(F.col("last_slot") >= start).withColumn("from", F.greatest("first_slot", F.lit(start).cast("long")))
    total = (files.agg(F.sum(F.col("last_slot") - F.col("from") + 1)).first()[0] or 0) * stride
    chunks = files.select("shard", "file", "first_slot", "last_slot", F.explode(F.sequence("from", "last_slot", F.lit(CHUNK).cast("long"))).alias("slot"))
    chunks = spread(chunks.select("shard", "file", "slot", (F.col("slot") - F.col("first_slot")).alias("r"), F.least(F.lit(CHUNK), F.col("last_slot") - F.col("slot") + 1).alias("n")), total, "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            for shard, file, slot, r, n in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                raw = reader.read(file, r * stride, n * stride)
                head = np.frombuffer(raw, np.uint8).reshape(n, stride)[:, : HEADER.itemsize].copy().view(HEADER).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(slot, slot + n)), pa.array([shard] * n, pa.int32()), pa.array(head["id"]), pa.array(head["seq"]), pa.array(head["n"]), pa.array([raw[k : k + stride] for k in range(0, n * stride, stride)], pa.binary())], ["slot", "shard", "doc_id", "seq", "n_tokens", "record"])
        reader.close()

    return chunks.mapInArrow(run, "slot long, shard int, doc_id long, seq int, n_tokens int, record binary")


def digest(records: DataFrame, per_shard: int = PER_SHARD, length: int = LENGTH) -> DataFrame:
    place = ((F.col("slot") % per_shard) * (HEADER.itemsize + length)).alias("at_byte")
    return records.select(F.when(F.col("doc_id") != int(NULL_ID), F.col("doc_id")).alias("doc_id"), "seq", "slot", "shard", place, "n_tokens", F.sha2("record", 256).alias("record_sha256"))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read_records(shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def record_of(text: str | None, doc_id: int | None, seq: int, length: int = LENGTH) -> bytes:
    """A record written plainly, for tests."""
    tokens = [*(text or "").encode(), END][seq * length : (seq + 1) * length]
    head = np.array([(NULL_ID if doc_id is None else doc_id, seq, len(tokens))], HEADER).tobytes()
    return head + bytes(tokens + [PAD] * (length - len(tokens)))


def sha(record: bytes) -> str:
    return hashlib.sha256(record).hexdigest()
