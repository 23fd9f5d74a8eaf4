"""Repeats within the last distinct signatures of a session, and the ledger of compactions that counts them.

A call repeats if its signature is among the `bound` distinct ones used last (an LRU list). That list is a summary that two stretches of a session combine: the later one's last uses, filled up with the earlier one's. So a session is not one task's: calls are cut into blocks by ranges of (session, order); each block's last uses, compactions and calls since the last one are summed up; a fold over these few rows gives every block the list that it begins with; and all blocks are gone through at once, each in one pass with a list of `bound` signatures.

Nulls: a null signature is a signature of its own. Calls of one order in a session have the order of their signatures. A compaction is no call and leaves the list as it is. Rows without a session are one session, rows without an order are left out. Other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Distinct signatures that are remembered, calls after a compaction that are counted, calls of a block.
BOUND, FIRST, ROWS = 400, 40, 200_000
START = "session string, block int, recent array<string>, window long, nth long"


def blocks(calls: DataFrame, session: str, order: str, signature: str, compaction: str, rows: int) -> DataFrame:
    """(session, block, pos, signature, compaction), written, in blocks by ranges."""
    own = calls.select(F.coalesce(F.col(session).cast("string"), F.lit("")).alias("session"), F.col(order).alias("pos"), F.coalesce(F.col(signature), F.lit("\0")).alias("signature"), F.coalesce(F.col(compaction), F.lit(False)).alias("compaction")).where("pos IS NOT NULL")
    n = max(calls.sparkSession.sparkContext.defaultParallelism, -(-calls.count() // rows))
    return written(own.repartitionByRange(n, "session", "pos").withColumn("block", F.spark_partition_id()), "calls")


def starts(ranged: DataFrame, bound: int) -> DataFrame:
    """(session, block, recent, window, nth): what each block begins with; recent from the least to the most recently used."""
    last = ranged.where("NOT compaction").groupBy("session", "block", "signature").agg(F.max("pos").alias("at"))
    place = F.row_number().over(Window.partitionBy("session", "block").orderBy(F.desc("at"), F.desc("signature")))
    uses = last.withColumn("place", place).where(F.col("place") <= bound).groupBy("session", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "signature")), False), lambda x: x["signature"]).alias("recent"))
    latest = ranged.where("compaction").groupBy("session", "block").agg(F.max("pos").alias("latest"), F.count("*").alias("compactions"))
    counted = ranged.join(latest, ["session", "block"], "left").groupBy("session", "block").agg(F.coalesce(F.max("compactions"), F.lit(0)).alias("compactions"), F.sum((~F.col("compaction") & (F.col("latest").isNull() | (F.col("pos") >= F.col("latest")))).cast("long")).alias("since"))
    sums = counted.join(uses, ["session", "block"], "left")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, recent, window, nth = None, OrderedDict(), 0, 0
        for b in batches:
            out = []
            for s, k, compactions, since, uses_ in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if s != now:
                    now, recent, window, nth = s, OrderedDict(), 0, 0
                out.append((s, k, list(recent), window, nth))
                window, nth = window + compactions, since if compactions else nth + since
                for sig in uses_ or ():
                    recent.pop(sig, None)
                    recent[sig] = None
                while len(recent) > bound:
                    recent.popitem(last=False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64()), strict=True)], ["session", "block", "recent", "window", "nth"])

    return sums.select("session", "block", "compactions", "since", "recent").repartition("session").sortWithinPartitions("session", "block").mapInArrow(fold, START)


def repeats(calls: DataFrame, session: str = "session_id", order: str = "pos", signature: str = "signature", compaction: str = "compaction", bound: int = BOUND, rows: int = ROWS) -> DataFrame:
    """(session, pos, signature, window, nth, repeat) of each call: the compactions before it, its place since the last one (from 1), and whether its signature is among the last `bound` distinct ones."""
    ranged = blocks(calls, session, order, signature, compaction, rows)
    kind = ranged.schema["pos"].dataType
    head = starts(ranged, bound).select("session", "block", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("pos"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("compaction"), "recent", "window", "nth")
    body = ranged.select("session", "block", F.lit(1).alias("kind"), "pos", "signature", "compaction", F.lit(None).cast("array<string>").alias("recent"), F.lit(None).cast("long").alias("window"), F.lit(None).cast("long").alias("nth"))
    # a compaction of the same order as calls comes before them
    order_ = ["session", "block", "kind", "pos", F.desc("compaction"), "signature"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, window, nth = OrderedDict(), 0, 0
        names = ["session", "pos", "signature", "window", "nth", "repeat"]
        for b in batches:
            at, windows, places, again = [], [], [], []
            for row, (k, sig, compaction_, first, w, n) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "signature", "compaction", "recent", "window", "nth")), strict=True)):
                if k == 0:
                    recent, window, nth = OrderedDict.fromkeys(first), w, n
                elif compaction_:
                    window, nth = window + 1, 0
                else:
                    nth += 1
                    known = sig in recent
                    if known:
                        recent.move_to_end(sig)
                    else:
                        recent[sig] = None
                        if len(recent) > bound:
                            recent.popitem(last=False)
                    at.append(row)
                    windows.append(window)
                    places.append(nth)
                    again.append(known)
            own = b.select(names[:3]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(windows, pa.int64()), pa.array(places, pa.int64()), pa.array(again, pa.bool_())], names)

    pos = kind.simpleString()
    out = head.unionByName(body).repartition("session", "block").sortWithinPartitions(*order_).mapInArrow(go, f"session string, pos {pos}, signature string, window long, nth long, repeat boolean")
    return out.withColumn("signature", F.when(F.col("signature") != "\0", F.col("signature")))


def compaction_ledger(found: DataFrame, first: int = FIRST) -> DataFrame:
    """(session, window, of, repeats, rate, whole) for each compaction with calls after it: how many of the first `first` repeat; whole once there are so many."""
    some = found.where((F.col("window") > 0) & (F.col("nth") <= first)).groupBy("session", "window")
    out = some.agg(F.count("*").alias("of"), F.sum(F.col("repeat").cast("long")).alias("repeats"))
    return out.withColumn("rate", F.round(F.col("repeats") / F.col("of"), 6)).withColumn("whole", F.col("of") == first)
