"""Queries of ordered analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from .registry import query
from .views import ctes, view

TIER = "CASE WHEN {0} >= 0.8 THEN 'HOT' WHEN {0} >= 0.25 THEN 'WARM' WHEN {0} >= 0.15 THEN 'HINT' ELSE 'COLD' END"
WIN = "win AS (SELECT *, sum(CASE WHEN tool = 'Compact' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS wid FROM accesses)"


def accesses(spark, d):
    return view(spark, d, "accesses")


def turns(spark, d):
    return view(spark, d, "turns")


def windowed(spark, d):
    return W.compaction_windows(accesses(spark, d), F.col("tool") == "Compact", ["user_id"], ["pos"])


@query("window_compactions", ctes("accesses") + f", {WIN} SELECT user_id, CAST(max(wid) + 1 AS BIGINT) AS windows, count(*) AS n FROM win GROUP BY user_id")
def window_compactions(spark, d):
    return windowed(spark, d).groupBy("user_id").agg((F.max("window") + 1).alias("windows"), F.count("*").alias("n"))


@query("window_repeats", ctes("accesses") + f", {WIN}, e AS (SELECT DISTINCT user_id, wid, path FROM win), f AS (SELECT *, min(wid) OVER (PARTITION BY user_id, path) AS m FROM e) SELECT user_id, count(*) AS repeats FROM f WHERE wid > m GROUP BY user_id")
def window_repeats(spark, d):
    return W.repeats_across_windows(windowed(spark, d), "user_id", "path").groupBy("user_id").agg(F.count("*").alias("repeats"))


@query("window_transitions", ctes("turns") + f", l AS (SELECT turn_id, injected AS path, confidence AS score, coalesce(lag(confidence) OVER (PARTITION BY injected ORDER BY turn_id), 0) AS was FROM turns), t AS (SELECT turn_id, path, {TIER.format('score')} AS tier, {TIER.format('was')} AS was FROM l) SELECT turn_id, path, CASE tier WHEN 'HOT' THEN 'to_hot' WHEN 'WARM' THEN 'to_warm' ELSE 'to_cold' END AS transition FROM t WHERE tier <> was")
def window_transitions(spark, d):
    s = turns(spark, d).select("turn_id", F.col("injected").alias("path"), F.col("confidence").cast("double").alias("score"))
    return W.transitions(s, ["path"], ["turn_id"]).select("turn_id", "path", "transition")


@query("window_streaks", ctes("turns") + ", b AS (SELECT turn_id, project, confidence >= 0.25 AS o, sum(CASE WHEN confidence >= 0.25 THEN 0 ELSE 1 END) OVER (PARTITION BY project ORDER BY turn_id) AS i FROM turns) SELECT turn_id, CASE WHEN o THEN CAST(sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY project, i ORDER BY turn_id) AS BIGINT) ELSE 0 END AS streak FROM b")
def window_streaks(spark, d):
    return W.islands(turns(spark, d), F.col("confidence") >= 0.25, ["project"], ["turn_id"]).select("turn_id", "streak")


@query("window_confidence_trend", ctes("turns") + """, c AS (SELECT turn_id, project, CAST(confidence AS DOUBLE) AS v FROM turns) SELECT turn_id, CASE WHEN count(*) OVER t >= 3 THEN round(avg(v) OVER t, 6) END AS rolling, count(*) OVER f = 5 AND max(v) OVER f < 0.4 AS alert,
CASE WHEN avg(v) OVER p IS NULL THEN 'new' WHEN v - avg(v) OVER p > 0.05 THEN 'up' WHEN v - avg(v) OVER p < -0.05 THEN 'down' ELSE 'stable' END AS trend
FROM c WINDOW t AS (PARTITION BY project ORDER BY turn_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), f AS (PARTITION BY project ORDER BY turn_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), p AS (PARTITION BY project ORDER BY turn_id ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)""")
def window_confidence_trend(spark, d):
    t = turns(spark, d).select("turn_id", "project", F.col("confidence").cast("double").alias("confidence"))
    return W.confidence_trend(t, ["project"], ["turn_id"]).select("turn_id", "rolling", "alert", "trend")


@query("window_bounces", ctes("accesses") + ", h AS (SELECT pos, list(k % 3) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s FROM accesses) SELECT pos FROM h WHERE len(s) = 6 AND len(list_distinct(s)) = 2 AND s[1] <> s[2] AND s[2] <> s[3] AND s[3] <> s[4] AND s[4] <> s[5] AND s[5] <> s[6]")
def window_bounces(spark, d):
    a = accesses(spark, d).withColumn("path", F.col("k") % 3)
    return W.bounces(a, ["user_id"], ["pos"]).select("pos")


VEL = "v AS (SELECT session_id, turn, CAST(sum(CASE WHEN tool = 'Edit' THEN 1 ELSE 0 END) AS INT) AS edits, CAST(sum(CASE WHEN tool = 'Read' THEN 1 ELSE 0 END) AS INT) AS reads FROM accesses GROUP BY 1, 2)"


@query("window_velocity", ctes("accesses") + f", {VEL} SELECT session_id, turn, sum(CASE WHEN edits > 0 AND reads = 0 THEN 1 ELSE 0 END) OVER w >= 3 OR (sum(reads) OVER w > 0 AND sum(edits) OVER w / sum(reads) OVER w > 3.0) AS alert FROM v WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def window_velocity(spark, d):
    one = lambda t: F.sum((F.col("tool") == t).cast("int"))
    t = accesses(spark, d).groupBy("session_id", "turn").agg(one("Edit").alias("edits"), one("Read").alias("reads"))
    return W.velocity(t, ["session_id"], ["turn"]).select("session_id", "turn", "alert")


@query("window_compaction_drops", ctes("turns") + ", a AS (SELECT project, turn_id, hot_count + warm_count AS active FROM turns), l AS (SELECT *, lag(active) OVER (PARTITION BY project ORDER BY turn_id) AS was, row_number() OVER (PARTITION BY project ORDER BY turn_id) AS n FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY turn_id) AS nth FROM l WHERE n > 2 AND was >= 4 AND was - active >= 3 AND was - active > was * 0.5) SELECT project, turn_id, was, active, nth FROM f WHERE nth <= 5")
def window_compaction_drops(spark, d):
    a = turns(spark, d).select("project", "turn_id", (F.col("hot_count") + F.col("warm_count")).alias("active"))
    return W.compactions(a, ["project"], ["turn_id"]).select("project", "turn_id", "was", "active", "nth")


@query("window_failures", ctes("accesses") + ", b AS (SELECT *, sum(CASE WHEN tool = 'Error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS i FROM accesses) SELECT user_id, CAST(i AS BIGINT) AS island, count(*) AS n FROM b WHERE tool = 'Error' GROUP BY 1, 2 HAVING count(*) >= 3")
def window_failures(spark, d):
    """Runs of at least three failures without a success between."""
    a = accesses(spark, d).withColumn("island", F.sum((F.col("tool") != "Error").cast("long")).over(W.upto(["user_id"], ["pos"])))
    return a.where("tool = 'Error'").groupBy("user_id", "island").agg(F.count("*").alias("n")).where("n >= 3")


@query("window_zero_progress", ctes("accesses") + ", l AS (SELECT pos, user_id, k % 2 AS h, lag(k % 2) OVER (PARTITION BY user_id ORDER BY pos) AS p FROM accesses WHERE tool <> 'Error'), b AS (SELECT *, h IS NOT DISTINCT FROM p AS same, sum(CASE WHEN h IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS i FROM l) SELECT pos, CASE WHEN same THEN CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i ORDER BY pos) AS BIGINT) ELSE 0 END AS streak FROM b")
def window_zero_progress(spark, d):
    """How many turns of work in a row left the state's hash as it was."""
    a = accesses(spark, d).where("tool <> 'Error'").withColumn("h", F.col("k") % 2)
    a = a.withColumn("same", F.col("h").eqNullSafe(F.lag("h").over(W.ordered(["user_id"], ["pos"]))))
    return W.islands(a, F.col("same"), ["user_id"], ["pos"]).select("pos", "streak")


@query("window_previous_files", ctes("accesses") + " SELECT pos, array_to_string(coalesce(list(path) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []), ' ') AS files FROM accesses")
def window_previous_files(spark, d):
    """Training samples: up to ten files before each access."""
    return accesses(spark, d).select("pos", F.array_join(F.collect_list("path").over(W.before(["session_id"], ["pos"], 10)), " ").alias("files"))


@query("window_recency", ctes("commits") + ", m AS (SELECT path, min(commit_idx) AS i FROM commits GROUP BY path) SELECT path, round(1.0::DOUBLE - 0.9::DOUBLE * i / max(i) OVER (), 6) AS recency FROM m")
def window_recency(spark, d):
    """1.0 for the first commit down to 0.1 for the last one."""
    m = view(spark, d, "commits").groupBy("path").agg(F.min("commit_idx").alias("i"))
    top = m.agg(F.max("i").alias("top"))  # one row
    return m.crossJoin(F.broadcast(top)).select("path", F.round(1.0 - F.lit(0.9) * F.col("i") / F.col("top"), 6).alias("recency"))


@query("window_change_frequency", ctes("commits") + ", c AS (SELECT path, count(*) AS n FROM commits GROUP BY path) SELECT path, round(n / (SELECT max(n) FROM c), 6) AS frequency FROM c ORDER BY n DESC, path LIMIT 50")
def window_change_frequency(spark, d):
    c = view(spark, d, "commits").groupBy("path").agg(F.count("*").alias("n"))
    top = c.agg(F.max("n").alias("top"))  # one row
    return c.crossJoin(F.broadcast(top)).orderBy(F.desc("n"), "path").limit(50).select("path", F.round(F.col("n") / F.col("top"), 6).alias("frequency"))


@query("window_warm_start", ctes("turns") + ", p AS (SELECT project, injected AS path, count(*) AS uses, avg(CAST(confidence AS DOUBLE)) AS score FROM turns GROUP BY 1, 2) SELECT project, path, round(greatest(0.25::DOUBLE, least(0.6::DOUBLE, score * sqrt(uses) * 0.7::DOUBLE)), 6) AS score FROM p WHERE score * sqrt(uses) > 0")
def window_warm_start(spark, d):
    """Scores of a new session from a project's profile: mean score by the root of its uses, from 0.25 to 0.6."""
    p = turns(spark, d).groupBy("project", F.col("injected").alias("path")).agg(F.count("*").alias("uses"), F.avg(F.col("confidence").cast("double")).alias("score"))
    raw = F.col("score") * F.sqrt("uses")
    return p.where(raw > 0).select("project", "path", F.round(F.greatest(F.lit(0.25), F.least(F.lit(0.6), raw * 0.7)), 6).alias("score"))


@query("window_session_warmup", ctes("turns") + " SELECT session_id, injected AS path, round(max(CAST(confidence AS DOUBLE)) * 0.4::DOUBLE, 6) AS score FROM turns GROUP BY 1, 2 HAVING max(confidence) > 0.1")
def window_session_warmup(spark, d):
    s = turns(spark, d).groupBy("session_id", F.col("injected").alias("path")).agg(F.max(F.col("confidence").cast("double")).alias("s"))
    return s.where("s > 0.1").select("session_id", "path", F.round(F.col("s") * 0.4, 6).alias("score"))


@query("window_project_switches", ctes("turns") + ", l AS (SELECT turn_id, session_id, project, hot_count % 3 AS p, lag(hot_count % 3) OVER (PARTITION BY project ORDER BY turn_id) AS was FROM turns) SELECT turn_id, was, p AS now FROM l WHERE was IS NOT NULL AND was <> p")
def window_project_switches(spark, d):
    """Turns at which another project begins, where scores are reset."""
    t = turns(spark, d).withColumn("now", F.col("hot_count") % 3).withColumn("was", F.lag(F.col("hot_count") % 3).over(W.ordered(["project"], ["turn_id"])))
    return t.where("was IS NOT NULL AND was <> now").select("turn_id", "was", "now")


@query("window_ledger_rates", ctes("accesses") + f", {WIN}, c AS (SELECT user_id, wid, count(*) AS calls, count(*) - count(DISTINCT path) AS repeats FROM win GROUP BY 1, 2), r AS (SELECT *, sum(repeats) OVER w AS er, sum(calls) OVER w AS ec, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY wid DESC) AS z FROM c WINDOW w AS (PARTITION BY user_id ORDER BY wid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, round(repeats / calls, 6) AS last_rate, round(er / ec, 6) AS earlier_rate, n >= 2 AND repeats / calls > er / ec AS rising FROM r WHERE z = 1 AND n >= 1")
def window_ledger_rates(spark, d):
    """The last window's rate of repeats against the pooled rate before it."""
    c = windowed(spark, d).groupBy("user_id", "window").agg(F.count("*").alias("calls"), (F.count("*") - F.count_distinct("path")).alias("repeats"))
    w = W.before(["user_id"], ["window"])
    c = c.withColumns({"er": F.sum("repeats").over(w), "ec": F.sum("calls").over(w), "n": F.count("*").over(w), "last": F.row_number().over(W.ordered(["user_id"], [F.desc("window")]))})
    return c.where("last = 1 AND n >= 1").select("user_id", F.round(F.col("repeats") / F.col("calls"), 6).alias("last_rate"), F.round(F.col("er") / F.col("ec"), 6).alias("earlier_rate"), ((F.col("n") >= 2) & (F.col("repeats") / F.col("calls") > F.col("er") / F.col("ec"))).alias("rising"))
