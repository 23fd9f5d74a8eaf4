"""Reports over turns, tasks and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import top_n


def cost_statistics(samples: DataFrame, key: str, value: str, order: str, last: int = 50) -> DataFrame:
    """For each kind of task: mean, population deviation, interpolated percentiles of its last samples, confidence by their number; nulls under three."""
    s = top_n(samples, [key], [F.desc(order)], last)
    q = lambda p: F.percentile(F.col(value).cast("double"), F.lit(p))
    agg = s.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *[q(p).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75, 0.95)])
    some = lambda c: F.when(F.col("n") >= 3, F.round(c, 6)).alias(c)
    return agg.select(key, "n", *[some(c) for c in ("mean", "std", "p25", "p50", "p75", "p95")], F.when(F.col("n") >= 20, "high").when(F.col("n") >= 10, "medium").otherwise("low").alias("confidence"))


def waste(turns: DataFrame, key: list[str]) -> DataFrame:
    """Share of notifications, mean waste (where it is known), share of turns without injection, mean and greatest injection."""
    return turns.groupBy(*key).agg(
        F.count("*").alias("turns"),
        F.round(F.avg(F.col("was_notification").cast("int")) * 100, 6).alias("notification_pct"),
        F.round(F.avg(F.when(F.col("waste_ratio") >= 0, F.col("waste_ratio").cast("double"))), 6).alias("waste"),
        F.round(F.avg((F.col("injection_chars") == 0).cast("int")), 6).alias("without"),
        F.round(F.avg("injection_chars"), 6).alias("mean_chars"),
        F.max("injection_chars").alias("max_chars"),
    )


def leaderboard(injected: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """Files by how often they were injected without use."""
    i, u = injected.groupBy("path").agg(F.count("*").alias("injected")), used.groupBy("path").agg(F.count("*").alias("used"))
    j = i.join(u, "path", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return j.withColumn("unused", F.col("injected") - F.col("used")).orderBy(F.desc("unused"), "path").limit(n)


def sessions(turns: DataFrame) -> DataFrame:
    """For each session its turns, minutes from first to last, mean waste, commonest project (ties by name)."""
    modal = turns.groupBy("session_id", "project").count().groupBy("session_id").agg(F.min_by("project", F.struct(-F.col("count"), F.col("project"))).alias("project"))
    minutes = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6
    s = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.round(minutes, 3).alias("minutes"), F.round(F.avg(F.when(F.col("waste_ratio") >= 0, F.col("waste_ratio").cast("double"))), 6).alias("waste"))
    return s.join(modal, "session_id")


def always_hot(turns: DataFrame, key: str, order: str, last: int = 20, least: int = 10, share: float = 0.8) -> DataFrame:
    """Files of at least `share` of a project's last turns."""
    t = top_n(turns, [key], [F.desc(order)], last)
    n = t.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return t.groupBy(key, "path").agg(F.count("*").alias("hot")).join(n, key).where(F.col("hot") >= F.col("n") * share).select(key, "path", "hot", "n")


def phrases(words: DataFrame, n: int = 3, least: int = 3, most: int = 5) -> DataFrame:
    """The commonest runs of n words, with an id from their digest. words: a column of arrays."""
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
    g = words.where(F.size("words") >= n).select(F.explode(grams).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return g.orderBy(F.desc("n"), "phrase").limit(most).select("phrase", "n", F.substring(F.sha2("phrase", 256), 1, 12).alias("id"))


def high_waste(injected: DataFrame, used: DataFrame, least: int = 10, share: float = 0.9) -> DataFrame:
    i = injected.groupBy("path").agg(F.count("*").alias("injected"))
    u = used.groupBy("path").agg(F.count("*").alias("used"))
    j = i.where(F.col("injected") >= least).join(u, "path", "left")
    w = 1 - F.coalesce("used", F.lit(0)) / F.col("injected")
    return j.withColumn("waste", F.round(w, 6)).where(w >= share).select("path", "injected", "waste")


def trend(values: DataFrame, order: str, value: str) -> DataFrame:
    """Values by the greatest one."""
    top = values.agg(F.max(value).alias("top"))  # one row
    return values.crossJoin(F.broadcast(top)).select(order, F.round(F.col(value) / F.col("top"), 6).alias("share"))


def sparkline(values: DataFrame, order: str, value: str, width: int, key: str) -> DataFrame:
    """Means of `width` equal parts of each key's values in order."""
    w = Window.partitionBy(key)
    v = values.withColumns({"i": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})
    return v.groupBy(key, F.floor(F.col("i") * width / F.col("n")).alias("part")).agg(F.round(F.avg(value), 6).alias("mean"))


def projection(total: Column, days: Column) -> Column:
    """What a month costs at the mean of the days."""
    return F.round(total / F.greatest(days, F.lit(1)) * 30, 6)


def optimise_interval(waste_ratio: Column) -> Column:
    return F.when(waste_ratio > 0.7, 10).when(waste_ratio > 0.4, 25).otherwise(50)


def precision_recall(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, precision, recall, f1) from rows (keys, path, predicted, actual)."""
    both = F.sum((F.col("predicted") & F.col("actual")).cast("int"))
    s = hits.groupBy(*keys).agg(both.alias("hit"), F.sum(F.col("predicted").cast("int")).alias("p"), F.sum(F.col("actual").cast("int")).alias("a"))
    prec = F.when(F.col("p") > 0, F.col("hit") / F.col("p")).otherwise(0.0)
    rec = F.when(F.col("a") > 0, F.col("hit") / F.col("a")).otherwise(0.0)
    return s.select(*keys, F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), 6).alias("f1"))
