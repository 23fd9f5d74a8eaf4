"""A second witness of compactions: markers in transcripts against the hooks that should have told of them, joined as two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a hook and its marker may be apart, and how late rows may come.
WITHIN, LATE = "5 minutes", "10 minutes"


def once(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows with a watermark, each key once as long as it may repeat; of a table, each key once with its first time."""
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct("ts", *[c for c in others if c != "ts"])).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def witnessed(hooks: DataFrame, markers: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """(session_id, marker, ts, hook): each marker with each hook of its session within a time of it, or none: a compaction that no hook told of.

    hooks: session_id, hook, ts; markers: session_id, marker, ts. A marker or hook that comes twice counts once. As streams, a marker without a hook is given out once the watermarks say that none can come any more, and state is bounded by them; a row later than that is left out. Null sessions match nothing; null times are left out.
    """
    h = once(hooks.where("ts IS NOT NULL").select("session_id", "hook", "ts"), ["session_id", "hook"], late).select(F.col("session_id").alias("_session"), "hook", F.col("ts").alias("hook_ts"))
    m = once(markers.where("ts IS NOT NULL").select("session_id", "marker", "ts"), ["session_id", "marker"], late)
    gap = F.expr(f"INTERVAL {within}")
    near = (F.col("hook_ts") >= F.col("ts") - gap) & (F.col("hook_ts") <= F.col("ts") + gap)
    # a hook is near markers of three spans of time at most, so a session's rows do not meet all others
    h = h.withColumn("_at", F.explode(F.array(*[span(F.col("hook_ts"), within) + k for k in (-1, 0, 1)])))
    m = m.withColumn("_span", span(F.col("ts"), within))
    return m.join(h, (F.col("session_id") == F.col("_session")) & (F.col("_span") == F.col("_at")) & near, "left_outer").select("session_id", "marker", "ts", "hook")


def span(ts: Column, within: str) -> Column:
    """The number of the span of time, as long as `within`, that a time is in."""
    length = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {within}"))
    return F.floor(F.unix_micros(ts) / length)


def unwitnessed(hooks: DataFrame, markers: DataFrame, within: str = WITHIN) -> DataFrame:
    """(session_id, marker, ts, missed) of tables: each marker and whether no hook is within a time of it, as `missed` has it of all pairs, without them. Of a session's hooks in a span of time the first and the last decide."""
    gap = F.expr(f"INTERVAL {within}")
    ends = hooks.where("ts IS NOT NULL AND session_id IS NOT NULL AND hook IS NOT NULL")
    # of a hook that comes twice the first time counts
    ends = once(ends.select("session_id", "hook", "ts"), ["session_id", "hook"], LATE).groupBy("session_id", span(F.col("ts"), within).alias("_at")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    ends = ends.select("session_id", F.explode(F.array(*[F.col("_at") + k for k in (-1, 0, 1)])).alias("_span"), "first", "last")
    m = once(markers.where("ts IS NOT NULL").select("session_id", "marker", "ts"), ["session_id", "marker"], LATE).withColumn("_span", span(F.col("ts"), within))
    near = lambda c: (F.col(c) >= F.col("ts") - gap) & (F.col(c) <= F.col("ts") + gap)
    each = m.join(ends, ["session_id", "_span"], "left").groupBy("session_id", "marker").agg(F.min("ts").alias("ts"), F.max(F.coalesce(near("first") | near("last"), F.lit(False))).alias("_told"))
    return each.select("session_id", "marker", "ts", (~F.col("_told")).alias("missed"))


def missed(found: DataFrame) -> DataFrame:
    """(session_id, marker, ts, missed, so_far): of each marker whether no hook told of it, and how many the session had missed with it. found: as `witnessed`, of a table or of what a stream wrote."""
    return counted(found.groupBy("session_id", "marker").agg(F.min("ts").alias("ts"), (F.count("hook") == 0).alias("missed")))


def counted(each: DataFrame) -> DataFrame:
    """Adds so_far to (session_id, marker, ts, missed): how many the session had missed with each."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("ts", "marker").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("so_far", F.sum(F.col("missed").cast("long")).over(w))
