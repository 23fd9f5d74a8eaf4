"""Ordered analytics within a session or a file: gaps, islands, frames, compaction windows. All are window functions partitioned by session or file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tier


def before(keys: list[str], order: list[str], rows: int | None = None):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def upto(keys: list[str], order: list[str], rows: int | None = None):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def compaction_windows(events: DataFrame, marker: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds window: how many markers there were up to and with the row."""
    return events.withColumn("window", F.sum(marker.cast("long")).over(upto(keys, order)))


def repeats_across_windows(events: DataFrame, session: str, item: str) -> DataFrame:
    """Rows (session, window, item) that an earlier window of the session had as well; each once."""
    each = events.select(session, "window", item).distinct()
    return each.withColumn("first", F.min("window").over(Window.partitionBy(session, item))).where("window > first").drop("first")


def islands(rows: DataFrame, on: Column, keys: list[str], order: list[str], name: str = "streak") -> DataFrame:
    """Adds the number of consecutive rows on which `on` holds, up to and with the row; 0 where it does not."""
    broken = F.sum((~on).cast("int")).over(upto(keys, order))
    return rows.withColumn("_i", broken).withColumn(name, F.when(on, F.sum(on.cast("long")).over(upto([*keys, "_i"], order))).otherwise(F.lit(0))).drop("_i")


def transitions(scores: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows where the tier differs from the one before: to_hot, to_warm or, for any colder one, to_cold."""
    now, was = tier(F.col("score")), tier(F.coalesce(F.lag("score").over(ordered(keys, order)), F.lit(0.0)))
    kind = F.when(now == "HOT", "to_hot").when(now == "WARM", "to_warm").otherwise("to_cold")
    return scores.withColumns({"tier": now, "was": was}).where("tier <> was").withColumn("transition", kind)


def confidence_trend(turns: DataFrame, keys: list[str], order: list[str], value: str = "confidence") -> DataFrame:
    """Adds the mean of the last ten (from three on), whether the last five were all below 0.4, and the direction against the ones before."""
    w = upto(keys, order, 10)
    last5 = upto(keys, order, 5)
    earlier = F.avg(value).over(before(keys, order, 9))
    t = turns.withColumn("rolling", F.when(F.count("*").over(w) >= 3, F.round(F.avg(value).over(w), 6)))
    t = t.withColumn("alert", (F.count("*").over(last5) == 5) & (F.max(value).over(last5) < 0.4))
    gap = F.col(value) - earlier
    return t.withColumn("trend", F.when(earlier.isNull(), "new").when(gap > 0.05, "up").when(gap < -0.05, "down").otherwise("stable"))


def bounces(rows: DataFrame, keys: list[str], order: list[str], item: str = "path", n: int = 6) -> DataFrame:
    """Rows at which the last n items alternate between two."""
    seen = F.collect_list(item).over(upto(keys, order, n))
    alternating = F.forall(F.sequence(F.lit(2), F.lit(n)), lambda i: F.element_at("seen", i) != F.element_at("seen", i - 1))
    return rows.withColumn("seen", seen).where(F.size("seen") == n).where((F.size(F.array_distinct("seen")) == 2) & alternating).drop("seen")


def velocity(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Turns with edits and reads: an alert where three of the last five edited without reading, or edits exceed three times the reads."""
    w = upto(keys, order, 5)
    blind = F.sum(((F.col("edits") > 0) & (F.col("reads") == 0)).cast("int")).over(w)
    edits, reads = F.sum("edits").over(w), F.sum("reads").over(w)
    return turns.withColumn("alert", (blind >= 3) | ((reads > 0) & (edits / reads > 3.0)))


def compactions(active: DataFrame, keys: list[str], order: list[str], most: int = 5) -> DataFrame:
    """Turns at which the number of active files fell by over a half and by at least three, from at least four, after the second turn; the first `most` of a session."""
    w = ordered(keys, order)
    fell = active.withColumns({"was": F.lag("active").over(w), "turn_no": F.row_number().over(w)})
    fell = fell.where("turn_no > 2 AND was >= 4 AND was - active >= 3 AND was - active > was * 0.5")
    return fell.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


