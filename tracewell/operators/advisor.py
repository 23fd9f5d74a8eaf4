"""Suggestions from a session's turns, and what became of them, as a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import status_log

#: Turns looked at, the least of them, and the rules' bounds.
TURNS, LEAST_TURNS, HOT_TURNS, HOT_SHARE, LEAST_INJECTED, WASTE, LEAST_REPEATS, PHRASES = 50, 10, 20, 0.8, 10, 0.9, 3, 5
SUGGESTION = "id string, type string, subject string, n long, of long"


def last_turns(turns: DataFrame, n: int, order: str = "turn_id") -> DataFrame:
    return turns.orderBy(F.desc(order)).limit(n)


def suggestions(turns: DataFrame, order: str = "turn_id") -> DataFrame:
    """(id, type, subject, n, of) of the last fifty turns; nothing from fewer than ten.

    turns: order, hot (array of files), injected and used (arrays of files), words (array of a prompt's significant words in order). always_hot: files that were hot in at least 80 percent of the last twenty turns; repeated_phrase: the five most frequent runs of three words that occur three times; high_waste: files injected ten times of which at most a tenth was used.
    """
    t = last_turns(turns, TURNS, order)
    enough = t.agg((F.count("*") >= LEAST_TURNS).alias("enough"), F.least(F.count("*"), F.lit(HOT_TURNS)).alias("m"))
    hot = last_turns(t, HOT_TURNS, order).select(F.explode(F.array_distinct("hot")).alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))
    hot = hot.crossJoin(F.broadcast(enough)).where(F.col("n") >= F.col("m") * HOT_SHARE).select(F.concat(F.lit("always_hot_"), "subject").alias("id"), F.lit("always_hot").alias("type"), "subject", "n", F.col("m").cast("long").alias("of"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda k: F.array_join(F.slice("words", k, F.lit(3)), " "))
    said = t.where(F.size("words") >= 3).select(F.explode(runs).alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_REPEATS)
    said = said.orderBy(F.desc("n"), "subject").limit(PHRASES)
    said = said.select(F.concat(F.lit("phrase_"), F.substring(F.sha2("subject", 256), 1, 12)).alias("id"), F.lit("repeated_phrase").alias("type"), "subject", "n", F.lit(None).cast("long").alias("of"))
    each = lambda c, name: t.select(order, F.explode(c).alias("subject")).groupBy("subject").agg(F.count("*").alias(name))
    used = t.select(order, F.explode(F.array_intersect("injected", "used")).alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))
    waste = each("injected", "of").where(F.col("of") >= LEAST_INJECTED).join(used, "subject", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    waste = waste.where(1 - F.col("n") / F.col("of") >= WASTE).select(F.concat(F.lit("high_waste_"), "subject").alias("id"), F.lit("high_waste").alias("type"), "subject", "n", "of")
    return hot.unionByName(said).unionByName(waste).crossJoin(F.broadcast(enough.select("enough"))).where("enough").drop("enough", "m")


def suggest(spark: SparkSession, path: str, turns: DataFrame, batch: int | str, seq: Column, order: str = "turn_id") -> bool:
    """Adds the suggestions that a log does not know yet, of whatever status, as pending; a repeated batch changes nothing."""
    found = suggestions(turns, order).withColumn("status", F.lit("pending")).withColumn("seq", seq)
    known = status_log.changes(spark, path)
    if known is not None:
        found = found.join(known.select("id").distinct(), "id", "left_anti")
    return status_log.append(spark, path, found, batch)


def decide(spark: SparkSession, path: str, decisions: DataFrame, batch: int | str) -> bool:
    """Adds decisions (id, status: applied or dismissed, seq) on suggestions that the log has; others are left out."""
    known = status_log.changes(spark, path)
    if known is None:
        return False
    told = decisions.where(F.col("status").isin("applied", "dismissed")).join(known.select("id").distinct(), "id", "left_semi")
    return status_log.append(spark, path, told.select("id", "status", "seq"), batch)


def listed(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """Suggestions with their last status; of one status, if it is given."""
    now = status_log.states(spark, path, "id", "seq")
    return now.where(F.col("status") == status) if status else now


def demoted(spark: SparkSession, path: str) -> DataFrame:
    """(path): files whose high waste was acted on."""
    return listed(spark, path, "applied").where("type = 'high_waste'").select(F.col("subject").alias("path")).distinct()


def with_usage(turns: DataFrame, usage: DataFrame, key: str = "turn_id", project: str | None = None) -> DataFrame:
    """Turn records with what was learned of them later: files_used, tool_calls and the waste ratio; the newest record of each project (or of all) takes them, as the others are closed.

    turns: key, injection_chars, files_injected; usage: the project if given, else one row, files_used, tool_calls. Waste is 1 less used over injected files; 1 where something was injected and nothing was used or listed, 0 where nothing was injected.
    """
    by = [project] if project else []
    last = turns.groupBy(*by).agg(F.max(key).alias(key))
    newest = usage.join(last, by) if by else usage.crossJoin(F.broadcast(last))
    n, m = F.size(F.coalesce("files_used", F.array().cast("array<string>"))), F.size(F.coalesce("files_injected", F.array().cast("array<string>")))
    waste = F.when(F.coalesce("injection_chars", F.lit(0)) <= 0, 0.0).when((n > 0) & (m > 0), F.round(1 - n / m, 3)).otherwise(1.0)
    own = turns.join(newest.select(key, "files_used", "tool_calls", F.lit(True).alias("_now")), key, "left")
    return own.withColumn("waste_ratio", F.when(F.col("_now"), waste)).drop("_now")
