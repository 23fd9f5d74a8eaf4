"""Relevance routing: scores of files for every session, from one turn to the next, and what a budget lets through.

All sessions of a turn are one table (session, path, score, streak): the phases are joins on (session, path) with what the turn activated. Nothing lowers a score between the decay and the penalty, so boosts that are added and capped at 1 do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HOT, WARM = 0.8, 0.25
#: Points of each phase.
COACTIVE, TRANSITIVE, IMPORTED, IMPORTER, COCHANGE_MOST, COCHANGE_SHARE, PAIRED, PINNED_FLOOR, DEMOTED, INTENT = 0.35, 0.075, 0.15, 0.10, 0.2, 0.25, 0.20, 0.35, 0.5, 0.2
#: Weights of the signals of a cold start.
WARMUP = {"recency": 0.40, "frequency": 0.20, "mtime": 0.25, "imports": 0.15, "editor": 0.10, "directory": 0.05}


def capped(score: Column, add: Column) -> Column:
    return F.least(F.lit(1.0), score + F.coalesce(add, F.lit(0.0)))


def in_order(points: str) -> Column:
    """The sum of different points, the largest first: a score at the border of a tier is the same whatever order its rows come in. A list is of one session's links to one file."""
    return F.aggregate(F.sort_array(F.collect_list(points), asc=False), F.lit(0.0), lambda s, p: s + p)


def attention_turn(state: DataFrame, activated: DataFrame, coactive: DataFrame, imports: DataFrame, cochange: DataFrame, pinned: DataFrame, demoted: DataFrame, rhythm: DataFrame | None = None) -> DataFrame:
    """The state after a turn: (session, path, score, streak, tier).

    state: session, path, score, streak. activated: session, path, relevance (a search's weighed relevance, or 1). coactive, imports: src, dst. cochange: src, dst, strength. pinned, demoted: path. rhythm: path, decay.
    Phases in order: decay; activation; co-activated files, in one step and, where still cold, in two; imports both ways; files changed together, where there is some score; tests and sources; the floor of pinned files; the penalty of demoted ones; tier and streak.
    """
    s = state.join(rhythm, "path", "left") if rhythm is not None else state.withColumn("decay", F.lit(None).cast("double"))
    s = s.withColumn("score", F.col("score") * T.decay_rate(F.col("path"), F.col("decay"))).drop("decay")
    act = activated.groupBy("session", "path").agg(F.max("relevance").alias("relevance"))
    s = s.join(act, ["session", "path"], "full").select("session", "path", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("relevance", F.lit(0.0))).alias("score"), F.coalesce("streak", F.lit(0)).alias("streak"), F.col("relevance").isNotNull().alias("direct"))

    a = act.select("session", F.col("path").alias("src"))
    near = lambda edges, points: a.join(edges, "src").select("session", F.col("dst").alias("path"), points.alias("p"))
    add = lambda rows, name, how: rows.groupBy("session", "path").agg(how("p").alias(name))
    back = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one = near(coactive, F.lit(COACTIVE))
    two = one.select("session", F.col("path").alias("src")).distinct().join(coactive, "src").select("session", F.col("dst").alias("path"), F.lit(TRANSITIVE).alias("p"))
    imported = near(imports, F.lit(IMPORTED)).unionByName(near(back(imports), F.lit(IMPORTER)))
    changed = near(cochange, F.least(F.lit(COCHANGE_MOST), F.col("strength") * COCHANGE_SHARE))
    name = T.basename(F.col("path"))
    names = s.groupBy("session", name.alias("name")).agg(F.min("path").alias("path"))
    want = F.when(F.startswith(T.basename(F.col("src")), F.lit("test_")), F.substring(T.basename(F.col("src")), 6, 1000)).otherwise(F.concat(F.lit("test_"), T.basename(F.col("src"))))
    paired = a.withColumn("name", want).join(names, ["session", "name"]).select("session", "path", F.lit(PAIRED).alias("p"))
    for rows, c, how in ((one, "p1", F.sum), (two, "p2", F.max), (imported, "p3", in_order), (changed, "p4", in_order), (paired, "p5", F.sum)):
        s = s.join(add(rows, c, how), ["session", "path"], "left")
    s = s.withColumn("score", capped(F.col("score"), F.col("p1")))
    s = s.withColumn("score", F.when((F.col("score") < WARM) & ~F.col("direct"), capped(F.col("score"), F.col("p2"))).otherwise(F.col("score")))
    s = s.withColumn("score", capped(F.col("score"), F.col("p3")))
    s = s.withColumn("score", F.when(F.col("score") > 0.01, capped(F.col("score"), F.col("p4"))).otherwise(F.col("score")))
    s = s.withColumn("score", capped(F.col("score"), F.col("p5"))).drop("p1", "p2", "p3", "p4", "p5")
    s = s.join(pinned.select("path").distinct().withColumn("pin", F.lit(1)), "path", "left").join(demoted.select("path").distinct().withColumn("dem", F.lit(1)), "path", "left")
    s = s.withColumn("score", F.when(F.col("pin") == 1, F.greatest("score", F.lit(PINNED_FLOOR))).otherwise(F.col("score")))
    s = s.withColumn("score", F.when((F.col("dem") == 1) & ~F.col("direct"), F.col("score") * DEMOTED).otherwise(F.col("score")))
    tier = T.tier(F.col("score"))
    return s.select("session", "path", F.round("score", 9).alias("score"), F.when(tier.isin("HOT", "WARM"), F.col("streak") + 1).otherwise(0).alias("streak"), tier.alias("tier"))


def observed(state: DataFrame, calls: DataFrame) -> DataFrame:
    """Scores raised to what a session's own calls say: 0.75 for a read or an edit, 0.4 for a search of contents, 0.3 of names."""
    points = F.when(F.col("tool").isin("Read", "Edit", "Write"), 0.75).when(F.col("tool") == "Grep", 0.4).when(F.col("tool") == "Glob", 0.3).otherwise(0.0)
    seen = calls.groupBy("session", "path").agg(F.max(points).alias("p"))
    return state.join(seen, ["session", "path"], "full").select("session", "path", F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("p", F.lit(0.0))).alias("score"))


def boosted_by_intent(scores: DataFrame, intents: Column) -> DataFrame:
    """Scores raised by the intents of the prompt (an array column) on the paths and streaks that they speak of."""
    low = F.lower("path")
    ext, has = T.extension(F.col("path")), F.array_contains
    any_of = lambda c, ws: sum((F.contains(c, F.lit(w)).cast("int") for w in ws), F.lit(0)) > 0
    rules = [
        ("test_files", any_of(low, ["test", "spec"]), 1.0),
        ("recent_edits", F.col("streak") >= 2, 0.5),
        ("module_files", ext.isin(*[e for e in "py js ts tsx jsx go rs java c cpp rb".split()]) & ~any_of(low, ["test", "config"]), 0.3),
        ("refactor_targets", F.col("streak") >= 3, 1.0),
        ("config_files", any_of(T.basename(low), ["config", "setting", ".env", ".yaml", ".yml", ".toml", "docker", "makefile", "package.json"]), 1.0),
        ("perf_files", any_of(low, ["benchmark", "perf", "profile"]), 1.0),
        ("doc_files", (ext == "md") | any_of(low, ["readme", "docs", "changelog"]), 1.0),
    ]
    add = sum((F.when(has(intents, name) & on, INTENT * part).otherwise(0.0) for name, on, part in rules), F.lit(0.0))
    return scores.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + add), 9))


def warm_state(signals: DataFrame, pairs: DataFrame, most: int = 25, floor: float = 0.30, cap: float = 0.75) -> DataFrame:
    """(path, score) of a cold start from (signal, path, value): the weighed sum, a test at 0.4 of its source at least, the best `most` between floor and cap."""
    weight = F.lit(0.0)
    for k, v in WARMUP.items():
        weight = F.when(F.col("signal") == k, v).otherwise(weight)
    s = signals.groupBy("path").agg(F.sum(F.col("value") * weight).alias("score"))
    paired = pairs.join(s.withColumnRenamed("path", "src"), "src").groupBy(F.col("dst").alias("path")).agg((F.max("score") * 0.4).alias("p"))
    s = s.join(paired, "path", "full").select("path", F.round(F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("p", F.lit(0.0))), 9).alias("score"))
    return s.orderBy(F.desc("score"), "path").limit(most).where(F.col("score") >= floor).withColumn("score", F.least("score", F.lit(cap)))


def selected(state: DataFrame, sizes: DataFrame, budget: int, hot: int = 3, warm: int = 8, hints: int = 20) -> DataFrame:
    """What a turn injects: the best hot files, then warm ones as long as the characters reach, then hints; (session, path, tier, rank, chars)."""
    w = Window.partitionBy("session", "tier").orderBy(F.desc("streak"), F.desc("score"), "path")
    s = state.where("tier <> 'COLD'").withColumn("rank", F.row_number().over(w)).join(sizes, "path", "left")
    most = F.when(F.col("tier") == "HOT", hot).when(F.col("tier") == "WARM", warm).otherwise(hints)
    chars = F.when(F.col("tier") == "HOT", F.coalesce("size", F.lit(0))).when(F.col("tier") == "WARM", F.least(F.coalesce("size", F.lit(0)), F.lit(2000))).otherwise(F.length("path"))
    s = s.where(F.col("rank") <= most).withColumn("chars", chars.cast("long"))
    order = F.when(F.col("tier") == "HOT", 0).when(F.col("tier") == "WARM", 1).otherwise(2)
    used = F.sum("chars").over(Window.partitionBy("session").orderBy(order, "rank").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("used", used).where(F.col("used") <= budget).select("session", "path", "tier", "rank", "chars")
