"""What keeps state in order: documents that are there, fresh profiles, retention, reminders, changes of settings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import words as W
from .learning import top_n

# Folders in which no file in focus is looked for.
UNFOCUSED = ["node_modules", "__pycache__", ".git", "venv", "env", "build", "dist", "target", ".tox"]
# Words of a prompt that a history does not keep.
HISTORY_STOP = ["the", "a", "an", "is", "are", "to", "for", "and", "or", "in", "on", "it", "this", "that", "with", "of"]


def leads_out(path: Column) -> Column:
    """Whether a relative path leaves its root: absolute, or up by more folders than it went down before."""
    down = F.aggregate(F.split(path, "/"), F.lit(0), lambda n, x: F.when(n < 0, n).when(x == "..", n - 1).when(x.isin("", "."), n).otherwise(n + 1))
    return F.startswith(path, F.lit("/")) | (down < 0)


def listed_documents(listed: DataFrame, existing: DataFrame) -> DataFrame:
    """(doc, state) of configured documents: kept, absent, or outside of the root, which is not looked for."""
    e = existing.select(F.col("doc")).distinct().withColumn("there", F.lit(True))
    state = F.when(leads_out(F.col("doc")), "outside").when(F.col("there"), "kept").otherwise("absent")
    return listed.select("doc").distinct().join(e, "doc", "left").select("doc", state.alias("state"))


def fresh_profiles(profiles: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Profiles that were active within so many days; one without a time is not."""
    return profiles.where(F.col("last_active") >= now - F.make_dt_interval(F.lit(days)))


def kept_sources(scores: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """Scores of documents, and of source files the highest ones."""
    source = F.regexp_extract("path", r"\.([^./]+)$", 1).isin(W.SOURCE_EXTENSIONS)
    best = top_n(scores.where(source), keys, [F.desc("score"), F.asc("path")], most).drop("rank")
    return scores.where(~source).unionByName(best)


def swept(outputs: DataFrame, keys: list[str], now: Column, keep: int = 200, seconds: int = 86_400) -> DataFrame:
    """Kept outputs that go: older than a day, or beyond the newest 200 of a folder."""
    w = Window.partitionBy(*keys).orderBy(F.desc("written"), "name")
    return outputs.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > keep) | (now - F.col("written") > seconds)).drop("_n")


def nudge(noted: Column, edits: Column, commits: Column, turns: Column, least_edits: int = 6, least_turns: int = 25) -> Column:
    """(due, why) of a reminder to write a note: work was done, none was written in this window, and the last reminder is some turns ago."""
    n = lambda c: c.cast("string")
    why = F.when(noted, "a note has already been written in this window").when((edits < least_edits) & (commits == 0), F.concat(F.lit("only "), n(edits), F.lit(" edit(s) and "), n(commits), F.lit(" commit(s) so far"))).when(turns < least_turns, F.concat(F.lit("nudged "), n(turns), F.lit(" turn(s) ago")))
    return F.struct(why.isNull().alias("due"), F.coalesce(why, F.concat(n(edits), F.lit(" edit(s), "), n(commits), F.lit(" commit(s), no note yet"))).alias("why"))


def changed_settings(runs: DataFrame, keys: list[str], order: str, last: int = 10) -> DataFrame:
    """The last runs of an optimiser with the settings it changed (maps new and previous), by name."""
    of = F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.try_element_at("previous", k)))
    said = F.transform(F.array_sort(F.map_keys(of)), lambda k: F.concat(k, F.lit(":"), F.coalesce(F.try_element_at("previous", k), F.lit("-")), F.lit("->"), F.coalesce(F.try_element_at("new", k), F.lit("-"))))
    text = F.array_join(said, ", ")
    return top_n(runs, keys, [F.desc(order)], last).withColumn("changes", F.when(text == "", "no change").otherwise(text)).drop("rank")


def overrides(settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(name, value, default) of a map of settings; ? where there is no default."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return settings.select(F.explode("settings").alias("name", "value")).select("name", "value", F.coalesce(F.try_element_at(known, "name"), F.lit("?")).alias("default"))


def learned_counts(affinities: DataFrame, edges: DataFrame, rhythms: DataFrame) -> DataFrame:
    """One row: how many associations, files with co-activations and rhythms were learned."""
    n = lambda df, c, name: df.agg(c.alias(name))
    one = n(affinities, F.count("*"), "associations").crossJoin(n(edges, F.count_distinct("src"), "coactivations")).crossJoin(n(rhythms, F.count("*"), "rhythms"))  # one row each
    return one


def hit_rates(predicted: DataFrame, actual: DataFrame, keys: list[str], ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: turns with an actual file, and for each k the part of them that has one among its first k predictions. predicted: keys, path, rank; actual: keys, path."""
    best = predicted.join(actual.distinct(), [*keys, "path"]).groupBy(*keys).agg(F.min("rank").alias("best"))
    t = actual.select(*keys).distinct().join(best, keys, "left")
    return t.agg(F.count("*").alias("turns"), *[F.round(F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_at_{k}") for k in ks])


def focus_scores(files: DataFrame, folder: str) -> DataFrame:
    """(path, score) of source files near a working folder: below it 0.8, less 0.15 for each folder on the way, 0.3 at least; in a folder above it 0.2."""
    parent, low = C.folder(F.col("path")), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    hidden = F.exists(F.split(parent, "/"), lambda x: F.startswith(x, F.lit(".")) | x.isin(UNFOCUSED))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"))) - folder.count("/")
    below = F.lit(True) if folder == "." else F.startswith("path", F.lit(folder + "/"))
    score = F.when(below, F.round(F.greatest(F.lit(0.3), 0.8 - slashes * 0.15), 6)).when((parent != "") & F.startswith(F.lit(folder), parent), 0.2)
    return files.where(low.isin(W.SOURCE_EXTENSIONS) & ~hidden).select("path", score.alias("score")).where("score IS NOT NULL")


def indexed_paths(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """(asked, path): the indexed path that is meant: an equal one, else the first of which one ends the other at a folder. Ends are exploded, so that both are equi-joins."""
    a = asked.select("asked", F.regexp_replace(F.replace("asked", F.lit("\\"), F.lit("/")), r"^[./]+", "").alias("norm")).distinct()
    i = indexed.select("path").distinct()
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), k, F.size(F.split(c, "/"))), "/"))
    up = a.select("asked", "norm", F.explode(ends(F.col("norm"))).alias("path")).join(i, "path").select("asked", "norm", "path")
    of = i.select("path", F.explode(ends(F.col("path"))).alias("norm"))
    down = a.join(of, "norm").select("asked", "norm", "path")
    best = F.min(F.struct((F.col("norm") != F.col("path")).alias("other"), "path"))
    return up.unionByName(down).groupBy("asked").agg(best.alias("b")).select("asked", "b.path")


def history_keywords(prompt: Column, most: int = 8) -> Column:
    """The first words of a prompt that say something, in lower case."""
    return F.slice(F.filter(F.split(F.lower(prompt), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(HISTORY_STOP)), 1, most)
