"""An append-only log of changes with latest-wins states: idempotent batches, compaction, retention.

A log is a folder. `events/<batch>` holds the rows of one batch; a batch that is there already is not written again, so a repeated one changes nothing. `states/<n>` holds what compaction made of all batches up to then: the latest row of each key; a small text beside it names those batches, which are neither read nor taken again. Both appear whole, by a rename, and nothing that is there is changed, so readers and failed writers don't meet.

A state's columns each come from the latest change that says something of them (not null), by `order` and, where that is equal, by batch; so an update names only what it changes. Nulls: rows without a key are left out, rows without an order come first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _placed(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Writes a table under a name of its own and moves it; False if another writer was first."""
    own = f"{path.rsplit('/', 2)[0]}/writing/{uuid.uuid4().hex}"
    df.write.parquet(own)
    fs, to = _fs(spark, path)
    fs.mkdirs(to.getParent())
    if not fs.exists(to) and fs.rename(_fs(spark, own)[1], to):
        return True
    fs.delete(_fs(spark, own)[1], True)
    return False


def _base(spark: SparkSession, path: str) -> tuple[str | None, set[str]]:
    """The newest state and the batches in it."""
    found = [n for n in _names(spark, f"{path}/states") if n.endswith(".json")]
    if not found:
        return None, set()
    fs, where = _fs(spark, f"{path}/states/{found[-1]}")
    stream = fs.open(where)
    try:
        said = json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
    return said["state"], set(said["batches"])


def append(spark: SparkSession, path: str, rows: DataFrame, batch: int | str) -> bool:
    """Adds a batch of changes; False, and nothing is written, if the log has it. As a stream's sink: `foreachBatch(lambda df, n: append(spark, path, df, n))`."""
    name = f"{batch:020d}" if isinstance(batch, int) else batch
    if name in _base(spark, path)[1] or name in _names(spark, f"{path}/events"):
        return False
    return _placed(spark, rows, f"{path}/events/{name}")


def changes(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows that count, with the batch they came in: the newest state's, and of the batches since."""
    state, merged = _base(spark, path)
    parts = [spark.read.parquet(f"{path}/states/{state}").withColumn("_batch", F.lit(""))] if state else []
    parts += [spark.read.parquet(f"{path}/events/{n}").withColumn("_batch", F.lit(n)) for n in _names(spark, f"{path}/events") if n not in merged]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: of each column the latest value that is not null. Extremes are partial aggregates, so a key with many changes is not one task's."""
    at = F.struct(F.col(order), F.col("_batch")) if "_batch" in rows.columns else F.struct(F.col(order))
    cols = [c for c in rows.columns if c not in (key, order, "_batch")]
    last = [F.max_by(F.when(F.col(c).isNotNull(), F.struct(F.col(c))), F.when(F.col(c).isNotNull(), at))[c].alias(c) for c in cols]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias(order), *last)


def states(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The state of each key now."""
    rows = changes(spark, path)
    if rows is None:
        raise ValueError(f"no log at {path}")
    return latest(rows, key, order)


def compact(spark: SparkSession, path: str, key: str, order: str, keep: int | None = None) -> bool:
    """Makes the states of all batches so far the base of the log; with `keep`, of the newest so many keys alone. False if another writer was first or there is nothing new.

    Columns of a state may come from changes of different orders; the state has the latest of them, so compaction is for logs whose later changes have higher orders.
    """
    state, merged = _base(spark, path)
    fresh = [n for n in _names(spark, f"{path}/events") if n not in merged]
    if not fresh and keep is None:
        return False
    rows = states(spark, path, key, order)
    if keep is not None:
        rows = rows.orderBy(F.desc(order), key).limit(keep)
    number = 1 + max([int(n.split("-")[0]) for n in _names(spark, f"{path}/states") if n.endswith(".json")], default=0)
    name = f"{number:012d}-{uuid.uuid4().hex}"
    _placed(spark, rows, f"{path}/states/{name}")
    fs, where = _fs(spark, f"{path}/states/{number:012d}-.json")
    try:
        stream = fs.create(where, False)  # only one writer can
    except Exception as e:
        if "already exists" not in str(e):
            raise
        return False
    stream.write(bytearray(json.dumps({"state": name, "batches": sorted(merged | set(fresh))}).encode()))
    stream.close()
    return True


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes batches and states that the newest state holds; readers that began before must have ended. Returns how many."""
    state, merged = _base(spark, path)
    old = [f"events/{n}" for n in _names(spark, f"{path}/events") if n in merged]
    old += [f"states/{n}" for n in _names(spark, f"{path}/states") if not n.endswith(".json") and n != state]
    for n in old:
        fs, where = _fs(spark, f"{path}/{n}")
        fs.delete(where, True)
    return len(old)
