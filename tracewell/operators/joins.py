"""Joins: calls with results, theta joins on path parts rewritten as equi-joins where the semantics allow, prefixes, as-of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .needles import contained


def calls_with_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with the characters of its results; calls without one stay."""
    chars = results.groupBy("tool_use_id").agg(F.sum("chars").alias("result_chars"))
    return uses.join(chars, uses["id"] == chars["tool_use_id"], "left").drop("tool_use_id").withColumn("result_chars", F.coalesce("result_chars", F.lit(0)))


def read_cost(reads: DataFrame, describes: DataFrame, injected: DataFrame, edited: DataFrame) -> DataFrame:
    """Reads by what they say of the routing: corpus_gap (no document describes the file), routing_miss (one does, none was injected), read_after_inject (injected and not edited), edited.

    reads: turn_id, path; describes: doc, path (as `describing_docs` finds them); injected: turn_id, doc; edited: turn_id, path.
    """
    docs = reads.join(describes, "path", "left").join(injected.withColumn("was_in", F.lit(1)), ["turn_id", "doc"], "left")
    per = docs.groupBy("turn_id", "path").agg(F.count("doc").alias("docs"), F.max(F.coalesce("was_in", F.lit(0))).alias("inj"))
    per = per.join(edited.distinct().withColumn("ed", F.lit(1)), ["turn_id", "path"], "left")
    kind = F.when(F.col("docs") == 0, "corpus_gap").when(F.col("inj") == 0, "routing_miss").when(F.col("ed").isNull(), "read_after_inject").otherwise("edited")
    return per.select("turn_id", "path", kind.alias("kind"))


def slashed(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


def describing_docs(paths: DataFrame, describes: DataFrame) -> DataFrame:
    """(path, doc): documents with a described file that a path contains. paths: path; describes: doc, described."""
    p = paths.select("path", slashed(F.col("path")).alias("text")).distinct()
    d = describes.select("doc", F.lower("described").alias("needle")).distinct()
    return contained(p, d).join(p, "text").join(d, "needle").select("path", "doc").distinct()


def inferred_usage(calls: DataFrame, describes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(turn_id, doc): documents that a turn used, since a call's target contains a file they describe or its pattern one of their keywords.

    calls: turn_id, target, pattern; describes: doc, described; keywords: doc, keyword.
    """
    by_target = calls.select("turn_id", F.col("target").alias("path")).distinct().join(describing_docs(calls.select(F.col("target").alias("path")), describes), "path")
    words = keywords.select("doc", F.lower("keyword").alias("needle")).distinct()
    said = calls.select("turn_id", F.lower("pattern").alias("text")).distinct()
    by_word = contained(said, words).join(said, "text").join(words, "needle")
    return by_target.select("turn_id", "doc").unionByName(by_word.select("turn_id", "doc")).distinct()


def used_documents(injected: DataFrame, calls: DataFrame) -> DataFrame:
    """Injected documents (turn_id, doc) whose path, or a part of its stem of over three characters, is in a target of the turn."""
    low = F.lower("doc")
    parts = F.filter(F.split(F.translate(T.stem(low), "-_", "  "), r"\s+"), lambda x: F.length(x) > 3)
    keys = injected.select("turn_id", "doc", F.explode(F.array_distinct(F.concat(F.array(low), parts))).alias("needle")).distinct()
    hits = contained(calls.select("turn_id", slashed(F.col("target")).alias("text")), keys, ["turn_id"]).select("turn_id", "needle").distinct()
    return keys.join(hits, ["turn_id", "needle"]).select("turn_id", "doc").distinct()


def matched_predictions(predicted: Column, actual: Column) -> Column:
    """(hits, matched): predicted paths that stand for an actual one, and how many of these are taken.

    Each predicted path, in order of its text, takes an equal path, else the first free one that one of the two ends with the other of, else the first free one of the same name. An equal path counts even if it was taken before. A turn's paths are few, so that both lists are arrays.
    """
    p, a = F.array_sort(F.array_distinct(predicted)), F.array_sort(F.array_distinct(actual))
    name = lambda x: F.lower(F.element_at(F.split(x, "/"), -1))

    def step(state, x):
        free = F.filter(a, lambda y: ~F.array_contains(state["taken"], y))
        ends = F.try_element_at(F.filter(free, lambda y: F.endswith(y, x) | F.endswith(x, y)), F.lit(1))
        named = F.try_element_at(F.filter(free, lambda y: name(y) == name(x)), F.lit(1))
        hit = F.when(F.array_contains(a, x), x).otherwise(F.coalesce(ends, named))
        taken = F.when(hit.isNull(), state["taken"]).otherwise(F.array_union(state["taken"], F.array(hit)))
        return F.struct((state["hits"] + hit.isNotNull().cast("int")).alias("hits"), taken.alias("taken"))

    start = F.struct(F.lit(0).alias("hits"), F.array().cast("array<string>").alias("taken"))
    return F.aggregate(p, start, step, lambda s: F.struct(s["hits"].alias("hits"), F.size(s["taken"]).alias("matched")))


def references_to_paths(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, path): references that name a path's basename, or its stem with any number of directories. Suffixes of a path are exploded, so that both are equi-joins."""
    p = paths.select("path").distinct()
    low = F.lower("path")
    stemmed = F.regexp_replace(low, r"\.[^./]*$", "")
    parts = F.split(stemmed, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))
    keys = p.select("path", F.explode(F.array_distinct(F.array_append(suffixes, T.basename(low)))).alias("key"))
    r = refs.select("id", F.lower("ref").alias("ref"))
    wanted = r.select("id", T.basename(F.col("ref")).alias("key")).unionByName(r.select("id", F.regexp_replace("ref", r"\.[^./]*$", "").alias("key"))).distinct()
    return wanted.join(keys, "key").select("id", "path").distinct()


def neighbour_boost(scores: DataFrame, activated: DataFrame, edges: DataFrame, points: Column) -> DataFrame:
    """Scores of the neighbours of activated files raised once for each of these, up to 1."""
    add = activated.select(F.col("path").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("path")).agg(F.sum(points).alias("add"))
    return scores.join(add, "path", "left").select("path", F.round(F.least(F.lit(1.0), F.col("score") + F.coalesce("add", F.lit(0.0))), 6).alias("score"))


def test_pairs(paths: DataFrame) -> DataFrame:
    """(path, other): each file with the first one that its name pairs it with (x.py and test_x.py)."""
    p = paths.select("path").distinct().withColumn("name", T.basename(F.col("path")))
    other = F.when(F.startswith("name", F.lit("test_")), F.substring("name", 6, 1000)).otherwise(F.concat(F.lit("test_"), "name"))
    first = p.groupBy("name").agg(F.min("path").alias("other"))
    return p.withColumn("want", other).join(first.withColumnRenamed("name", "want"), "want").select("path", "other")


def longest_prefix(rows: DataFrame, path: str, prefixes: DataFrame) -> DataFrame:
    """Each row with the value of the longest directory prefix that has one: prefixes are exploded and joined by equality. Prefixes with two values are refused."""
    ok = prefixes.groupBy("prefix").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n")).where("n = 1").drop("n")
    parts = F.split(F.col(path), "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    found = rows.select("id", F.explode(each).alias("prefix")).join(ok, "prefix").groupBy("id").agg(F.max_by("value", F.length("prefix")).alias("value"))
    return rows.join(found, "id", "left")


def stale_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References (doc, ref) that name nothing known."""
    return refs.join(known.select("ref").distinct(), "ref", "left_anti")


def staleness(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc, ratio, action): stale references to all of a document; over 0.8 skip, over 0.5 demote."""
    tagged = refs.join(known.select("ref").distinct().withColumn("ok", F.lit(1)), "ref", "left")
    r = tagged.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("stale"))
    ratio = F.col("stale") / F.col("n")
    return r.select("doc", F.round(ratio, 6).alias("ratio"), F.when(ratio > 0.8, "skip").when(ratio > 0.5, "demote").otherwise("keep").alias("action"))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def neighbours_in_time(rows: DataFrame, n: int, key: str, order: str) -> DataFrame:
    """For each row the ids of up to n rows strictly before it, newest first, and of up to n strictly after it, oldest first; of one time those with the highest ids count as newest.

    Of each time only n rows on either side can be a neighbour; these are kept, and times look at the n times around them, so that no frame grows with a session. Rows without a time have no neighbours and are none.
    """
    timed = rows.select(key, order, "id").where(F.col(order).isNotNull())
    nth = lambda by: F.row_number().over(Window.partitionBy(key, order).orderBy(by))
    ends = timed.withColumns({"_up": nth(F.asc("id")), "_down": nth(F.desc("id"))}).where((F.col("_up") <= n) | (F.col("_down") <= n))
    ids = lambda side: F.array_sort(F.collect_list(F.when(F.col(side) <= n, F.col("id"))))
    times = ends.groupBy(key, order).agg(ids("_up").alias("_first"), F.reverse(ids("_down")).alias("_last"))
    w = Window.partitionBy(key).orderBy(order)
    near = lambda c, a, b: F.flatten(F.collect_list(c).over(w.rowsBetween(a, b)))
    times = times.withColumns({"_p": near(F.reverse("_last"), -n, -1), "_a": F.slice(near("_first", 1, n), 1, n)})
    times = times.select(F.col(key).alias("_k"), F.col(order).alias("_t"), F.slice(F.reverse("_p"), 1, n).alias("_p"), "_a")
    found = rows.join(times, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_t")), "left")
    none = F.array().cast("array<bigint>")
    return found.select("id", F.coalesce("_p", none).alias("before"), F.coalesce("_a", none).alias("after"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key, the one with the highest version; of equal ones the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))).where("_r = 1").drop("_r", "_new")
