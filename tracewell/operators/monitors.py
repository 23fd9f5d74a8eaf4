"""Monitors of a session's calls as window functions: reads before writes, redundant reads, loops, compaction ledgers, notes.

The streaming package runs the ones that carry state with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered, upto

NOTICE_LEAST, NOTICE_COST = 400, 40


def edits_without_read(calls: DataFrame, session: str = "session_id", order: str = "pos") -> DataFrame:
    """Edits of files that the session did not read before: of one never read CRITICAL, of one read at least ten turns ago WARNING, else NOTICE; only CRITICAL ones are violations."""
    w = Window.partitionBy(session, "path").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    c = calls.withColumn("last_read", F.max(F.when(F.col("tool") == "Read", F.col("turn"))).over(w)).where("tool = 'Edit'")
    age = F.col("turn") - F.col("last_read")
    return c.withColumn("severity", F.when(F.col("last_read").isNull(), "CRITICAL").when(age >= 10, "WARNING").otherwise("NOTICE"))


def compliance(edits: DataFrame, session: str = "session_id") -> DataFrame:
    """1 - violations / edits; null for under five edits."""
    e = edits.groupBy(session).agg(F.count("*").alias("edits"), F.sum((F.col("severity") == "CRITICAL").cast("int")).alias("violations"))
    return e.select(session, "edits", "violations", F.when(F.col("edits") >= 5, F.round(1 - F.col("violations") / F.col("edits"), 6)).alias("rate"))


def read_decisions(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """NOTICE or ALLOW for each read of a ledger.

    events: keys, order, event (read, edit, compact), path, range, stat, tokens. A read of the same path and range that nothing has invalidated since (an edit of the path, a compaction, another stat) is noticed if it cost at least 400 tokens; the next ask is always served, and opens the count anew. So within a stretch without invalidation every second read is noticed.
    """
    reads = events.withColumn("edits", F.sum((F.col("event") == "edit").cast("int")).over(upto([*keys, "path"], [order])))
    reads = reads.withColumn("compactions", F.sum((F.col("event") == "compact").cast("int")).over(upto(keys, [order]))).where("event = 'read'")
    group = [*keys, "path", "range", "compactions", "edits", "stat"]
    n = F.row_number().over(ordered(group, [order]))
    prior = F.lag("tokens").over(ordered(group, [order]))
    r = reads.withColumns({"n": n, "prior": prior})
    notice = (F.col("n") % 2 == 0) & (F.col("prior") >= NOTICE_LEAST)
    return r.withColumn("action", F.when(notice, "NOTICE").otherwise("ALLOW")).withColumn("saved_tokens_est", F.when(notice, F.greatest(F.lit(0), F.col("prior") - NOTICE_COST)).otherwise(0))


def signature(tool: Column, target: Column, old: Column, new: Column) -> Column:
    """A call's signature: of a command its first word and its names, sorted; of an edit the path and a digest of the change."""
    names = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(target, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0)))), ":")
    changed = F.when(F.coalesce(F.length(old), F.lit(0)) + F.coalesce(F.length(new), F.lit(0)) > 0, F.substring(F.sha2(F.concat(F.coalesce(old, F.lit("")), F.lit("|||"), F.coalesce(new, F.lit(""))), 256), 1, 8)).otherwise("")
    return F.when(tool == "Bash", F.concat_ws("|", tool, F.split(target, " ")[0], names, F.lit(""))).otherwise(F.concat_ws("|", tool, F.replace(target, F.lit("\\"), F.lit("/")), changed, F.lit("")))


def similarity(a: Column, b: Column) -> Column:
    """Of two signatures: 0 for other tools or targets; edits 1 for the same change, 0.3 for another one, 0.5 if only one is known; commands by the overlap of their names. What has fewer than four parts is equal or not."""
    x, y = F.split(a, r"\|"), F.split(b, r"\|")
    at = lambda p, k: F.try_element_at(p, F.lit(k))
    same = (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2))
    known = lambda p: F.length(at(p, 3)) > 0
    edit = F.when(known(x) & known(y), F.when(at(x, 3) == at(y, 3), 1.0).otherwise(0.3)).when(~known(x) & ~known(y), 1.0).otherwise(0.5)
    names = lambda p: F.filter(F.split(at(p, 3), ":"), lambda n: n != "")
    command = F.when(~known(x) & ~known(y), 1.0).when(~known(x) | ~known(y), 0.0).otherwise(F.size(F.array_intersect(names(x), names(y))) / F.size(F.array_union(names(x), names(y))))
    short = (F.size(x) < 4) | (F.size(y) < 4)
    return F.when(short, (a == b).cast("double")).when(~same, 0.0).when(at(x, 1) == "Bash", command).otherwise(edit)


def loops(attempts: DataFrame, session: str = "session_id", order: str = "pos", last: int = 9, least: int = 3, alike: float = 0.7) -> DataFrame:
    """Attempts at which the last nine of the file repeat one signature: three in a row, or three of them in all, or three that are like the newest one. Severity by the count: 3 notice, 5 warning, 7 critical."""
    recent = F.collect_list("signature").over(upto([session, "path"], [order], last))
    a = attempts.withColumn("recent", recent)
    tail = F.slice("recent", -least, least)
    best = F.array_max(F.transform("recent", lambda s: F.size(F.filter("recent", lambda t: t == s))))
    newest = F.element_at("recent", -1)
    like = F.size(F.filter("recent", lambda s: similarity(newest, s) >= alike))  # the newest one is like itself
    a = a.where(F.size("recent") >= least).withColumns({"in_a_row": F.size(F.array_distinct(tail)) == 1, "most": best, "like": like})
    a = a.where((F.col("in_a_row")) | (F.col("most") >= least) | (F.col("like") >= least))
    a = a.withColumn("count", F.when(F.col("in_a_row"), F.size("recent")).when(F.col("most") >= least, F.col("most")).otherwise(F.col("like"))).drop("like")
    return a.withColumn("severity", F.when(F.col("count") >= 7, "CRITICAL").when(F.col("count") >= 5, "WARNING").otherwise("NOTICE"))


def multi_score(count: Column, failures: Column, idle: Column) -> Column:
    """How bad a loop is: repeats, failures and turns without progress."""
    part = lambda c, n: F.least(c / n, F.lit(1.0))
    return F.round(0.5 * part(count, 7) + 0.25 * part(failures, 5) + 0.25 * part(idle, 4), 6)


def rederivation(calls: DataFrame, keys: list[str], order: str, first: int = 40) -> DataFrame:
    """For each compaction the calls of the first 40 after it that repeat a signature from before it."""
    c = calls.withColumn("nth", F.row_number().over(ordered([*keys, "window"], [order]))).withColumn("since", F.min("window").over(Window.partitionBy(*keys, "signature")))
    return c.where((F.col("window") > 0) & (F.col("nth") <= first)).groupBy(*keys, "window").agg(F.count("*").alias("of"), F.sum((F.col("since") < F.col("window")).cast("int")).alias("repeats"))


def alerts(totals: DataFrame, keys: list[str], order: str, limit: Column, share: float = 0.8) -> DataFrame:
    """The first row of each window at which the context reaches `share` of its limit."""
    t = totals.where(F.col("context_tokens") >= limit * share)
    return t.withColumn("_n", F.row_number().over(ordered([*keys, "window"], [order]))).where("_n = 1").drop("_n")


def current_notes(notes: DataFrame, now: int, hours: int = 72) -> DataFrame:
    """Notes that none supersedes and that are not too old, by priority."""
    gone = notes.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct()
    return notes.join(gone, "id", "left_anti").where(F.lit(now) - F.col("noted_at") <= hours * 3600)


def by_prefix(notes: DataFrame, prefix: str, only: bool = True) -> DataFrame:
    """The note whose id begins so, if only one does; without `only` all that do."""
    found = notes.where(F.startswith(F.col("id").cast("string"), F.lit(prefix)))
    if not only:
        return found
    one = found.agg(F.count("*").alias("_n"))
    return found.crossJoin(F.broadcast(one)).where("_n = 1").drop("_n")


def compaction_risk(turns: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Risk from the number of turns and the mean size of the last ten; a growing second half counts as well."""
    w10 = upto(keys, [order], 10)
    sizes = F.collect_list(size).over(w10)
    t = turns.withColumns({"n": F.row_number().over(ordered(keys, [order])), "sizes": sizes})
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    half = F.floor(F.size("sizes") / 2).cast("int")
    t = t.withColumns({"avg": mean(F.col("sizes")), "growing": F.when(F.size("sizes") >= 4, mean(F.slice("sizes", half + 1, F.size("sizes") - half)) > 1.2 * mean(F.slice("sizes", F.lit(1), half))).otherwise(False)})
    risk = F.when(F.size("sizes") < 3, "none").when((F.col("n") > 60) & (F.col("avg") > 15000), "high").when((F.col("n") > 40) & (F.col("avg") > 10000), "medium").when((F.col("n") > 30) & F.col("growing"), "low").otherwise("none")
    return t.withColumn("risk", risk).drop("sizes")
