"""Choices under a budget: fills that skip what does not fit and go on, and a diverse choice over directories.

What a fill has left depends on every row before, so it is a fold; rows of a group are sorted by the shuffle and streamed through it, and its state is one number, however long the group. The diverse choice is greedy, and its order has a closed form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill(rows: DataFrame, keys: list[str], order: list[str | Column], size: str, budget: int, reserve: int = 0, strict: bool = False, phase: str | None = None, least_left: int = 0) -> DataFrame:
    """All rows with `kept` and `left`, what their group's budget has left behind them: in order, a row that fits is kept, another is skipped, and the next ones are tried.

    reserve is never given out (it is for a notice of what was dropped). strict: a row has to leave something of the budget. phase: a column of whole numbers by which rows are ordered first; where a later phase begins with no more than `least_left`, nothing of it is kept.
    Nulls: a null size fits nothing; a null phase is phase 0; null keys are a group. Rows of equal order are taken in any order: give a whole one.
    """
    num = F.coalesce(F.col(phase), F.lit(0)).cast("int") if phase else F.lit(0)
    group = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    own = rows.select("*", group.alias("_group"), F.to_json(F.struct(*keys)).alias("_key"), num.alias("_phase"), F.col(size).cast("long").alias("_size"))
    names, start = rows.columns, max(0, budget - reserve)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, left, open_ = None, 0, 0, True
        for b in batches:
            kept, rest = [], []
            for k, p, s in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_key", "_phase", "_size")), strict=True):
                if k != key:
                    key, at, left, open_ = k, p, start, True
                if p != at:
                    at, open_ = p, left > least_left
                fits = open_ and s is not None and (s < left if strict else s <= left)
                left -= s if fits else 0
                kept.append(fits)
                rest.append(left)
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(kept, pa.bool_()), pa.array(rest, pa.int64())], [*names, "kept", "left"])

    sorted_ = own.repartition("_group").sortWithinPartitions("_group", "_key", "_phase", *order)
    return sorted_.mapInArrow(go, rows.schema.add("kept", "boolean").add("left", "long"))


def handback(lines: DataFrame, keys: list[str], order: list[str | Column], size: str, budget: int, reserve: int) -> DataFrame:
    """The lines that a fill keeps, each with `dropped`, how many of its group did not fit."""
    filled = fill(lines, keys, order, size, budget, reserve)
    dropped = F.sum((~F.col("kept")).cast("long")).over(Window.partitionBy(*keys))
    return filled.withColumn("dropped", dropped).where("kept").drop("kept")


def diverse(scored: DataFrame, keys: list[str], k: int, per_dir: int = 3, order: list[str | Column] | None = None) -> DataFrame:
    """The first k of each group by a greedy choice, with `value`, `fallback` and `rank`. scored: keys, path, dir, score; `order` is the candidates' own order, by default score and path.

    Each step takes what has the most of 0.7 of the score less 0.045 for each of its directory taken before, of directories with fewer than per_dir; where none is left, the first of all others. A group of no more than k stays whole in its own order.
    As a directory's candidates come by score, the j-th of them is always met with j - 1 taken before: the steps merge the directories' sorted lists, so the whole choice is a sort.
    """
    own = [F.desc("score"), F.asc("path")] if order is None else order
    group, by_dir = Window.partitionBy(*keys), Window.partitionBy(*keys, "dir")
    s = scored.withColumn("_at", F.row_number().over(group.orderBy(*own))).withColumn("_n", F.count("*").over(group))
    s = s.withColumn("_sib", F.row_number().over(by_dir.orderBy(F.desc("score"), "_at")))
    value = F.round(0.7 * F.col("score") - 0.045 * (F.col("_sib") - 1), 9)
    whole, late = F.col("_n") <= k, F.col("_sib") > per_dir
    s = s.withColumn("value", F.when(~whole & ~late, value)).withColumn("fallback", ~whole & late)
    rank = F.row_number().over(group.orderBy(F.asc("fallback"), F.desc_nulls_last("value"), "_at"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).drop("_at", "_n", "_sib")
