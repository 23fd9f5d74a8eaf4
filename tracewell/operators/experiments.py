"""Experiment analytics: contrasts of treated and control sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two-sided 95 percent points of the t distribution by degrees of freedom.
T_VALUES = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 30: 2.042}
#: Units for a token by kind.
UNITS = {"cache_read_tokens": 0.1, "cache_creation_tokens": 1.25, "input_tokens": 1.0, "output_tokens": 5.0}


def units() -> Column:
    return sum((F.coalesce(c, F.lit(0)) * w for c, w in UNITS.items()), F.lit(0.0))


def group_contrast(sessions: DataFrame) -> DataFrame:
    """By group: sessions, units for a turn (a ratio of sums), turns for a window, repeats for a compaction."""
    s = sessions.groupBy("grp").agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("turns", "units", "windows", "compactions", "repeats")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return s.select("grp", "sessions", ratio("units", "turns").alias("units_per_turn"), ratio("turns", "windows").alias("turns_per_window"), ratio("repeats", "compactions").alias("repeats_per_compaction"))


def saving(contrast: DataFrame) -> DataFrame:
    """1 - treated / baseline of the units for a turn; null without either."""
    of = lambda g: F.max(F.when(F.col("grp") == g, F.col("units_per_turn")))
    return contrast.agg(F.round(1 - of("treated") / of("baseline"), 6).alias("saving"))


def bootstrap(sessions: DataFrame, draws: int = 2000, seed: int = 7, least: int = 5) -> DataFrame:
    """(low, high): the 95 percent interval of treated / baseline - 1 over resampled sessions; null with under `least` sessions on a side.

    Poisson bootstrap: in each draw a session counts as often as a digest of (seed, draw, session) says, so the same rows give the same interval on any cluster, and a draw is a sum that needs no list of sessions. Groups are first summed by draw and task.
    """
    sides = sessions.where(F.col("grp").isin("treated", "baseline"))
    u = (F.xxhash64(F.lit(seed), F.col("draw"), F.col("session_id")) / F.lit(float(2**64))) + 0.5
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    times = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    each = sides.select("grp", "session_id", "turns", "units", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", times)
    d = each.groupBy("draw").agg(*[F.sum(F.when(F.col("grp") == g, F.col("w") * F.col(c))).alias(f"{g}_{c}") for g in ("treated", "baseline") for c in ("turns", "units")])
    ratio = F.try_divide(F.try_divide("treated_units", "treated_turns"), F.try_divide("baseline_units", "baseline_turns")) - 1  # a draw without a side says nothing
    q = d.select(ratio.alias("r")).agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))
    n = sides.agg(*[F.sum((F.col("grp") == g).cast("int")).alias(g) for g in ("treated", "baseline")])
    ok = (F.col("treated") >= least) & (F.col("baseline") >= least)
    return q.crossJoin(n).select(F.when(ok, F.col("low")).alias("low"), F.when(ok, F.col("high")).alias("high"))


def t_interval(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, half): the half width of the 95 percent interval with the sample's deviation."""
    n = F.col("n") - 1
    t = F.lit(1.96)
    for df in sorted(T_VALUES, reverse=True):
        t = F.when(n <= df, T_VALUES[df]).otherwise(t)
    a = values.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return a.select(key, "n", F.round("m", 6).alias("mean"), F.when(F.col("n") > 1, F.round(t * F.col("s") / F.sqrt("n"), 6)).alias("half"))


def arm_contrast(decisions: DataFrame) -> DataFrame:
    """By component: mean tokens of each arm's decisions while acting, and what is saved."""
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("tokens")))
    a = decisions.where("acting").groupBy("component").agg(mean("treated").alias("t"), mean("baseline").alias("c"))
    return a.select("component", F.round("t", 6).alias("treated"), F.round("c", 6).alias("control"), F.round(1 - F.col("t") / F.col("c"), 6).alias("saving"))


def session_groups(sessions: DataFrame, stream: DataFrame) -> DataFrame:
    """treated where a session's stream acted, observed where it only looked, baseline without one."""
    flags = stream.groupBy("session_id").agg(F.bool_or("acting").alias("acted"))
    return sessions.join(flags, "session_id", "left").withColumn("grp", F.when(F.col("acted").isNull(), "baseline").when(F.col("acted"), "treated").otherwise("observed")).drop("acted")


def stream_summary(stream: DataFrame) -> DataFrame:
    """By session: whether it acted, tokens saved and that would have been saved."""
    return stream.groupBy("session_id").agg(F.bool_or("acting").alias("acting"), F.sum(F.when(F.col("acting"), F.col("tokens")).otherwise(0)).alias("saved"), F.sum(F.when(~F.col("acting"), F.col("tokens")).otherwise(0)).alias("would_save"))
