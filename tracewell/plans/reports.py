"""Queries of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports as P
from ..operators.learning import top_n
from .registry import query
from .text import STOP, words_sql
from .views import ctes, view

WASTE = "CASE WHEN waste_ratio >= 0 THEN CAST(waste_ratio AS DOUBLE) END"


def turns(spark, d):
    return view(spark, d, "turns")


def injected(t):
    return t.select(F.col("injected").alias("path"))


def used(t):
    return t.select(F.col("used").alias("path"))


@query("report_task_costs", ctes("turns") + ", s AS (SELECT 'task' || CAST(hot_count AS VARCHAR) AS task, injection_chars AS c, row_number() OVER (PARTITION BY hot_count ORDER BY turn_id DESC) AS n FROM turns), a AS (SELECT task, count(*) AS n, avg(c) AS m, stddev_pop(c) AS s, quantile_cont(CAST(c AS DOUBLE), 0.25) AS a, quantile_cont(CAST(c AS DOUBLE), 0.5) AS b, quantile_cont(CAST(c AS DOUBLE), 0.75) AS c2, quantile_cont(CAST(c AS DOUBLE), 0.95) AS d FROM s WHERE n <= 50 GROUP BY task) SELECT task, n, round(m, 6) AS mean, round(s, 6) AS std, round(a, 6) AS p25, round(b, 6) AS p50, round(c2, 6) AS p75, round(d, 6) AS p95, CASE WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM a")
def report_task_costs(spark, d):
    t = turns(spark, d).withColumn("task", F.concat(F.lit("task"), "hot_count"))
    return P.cost_statistics(t, "task", "injection_chars", "turn_id")


@query("report_waste", ctes("turns") + f" SELECT project, count(*) AS turns, round(avg(CAST(was_notification AS INT)) * 100, 6) AS notification_pct, round(avg({WASTE}), 6) AS waste, round(avg(CAST(injection_chars = 0 AS INT)), 6) AS without, round(avg(injection_chars), 6) AS mean_chars, max(injection_chars) AS max_chars FROM turns GROUP BY project")
def report_waste(spark, d):
    return P.waste(turns(spark, d), ["project"])


@query("report_leaderboard", ctes("turns") + ", i AS (SELECT injected AS path, count(*) AS injected FROM turns GROUP BY 1), u AS (SELECT used AS path, count(*) AS used FROM turns GROUP BY 1) SELECT path, injected, coalesce(used, 0) AS used, injected - coalesce(used, 0) AS unused FROM i LEFT JOIN u USING (path) ORDER BY unused DESC, path LIMIT 15")
def report_leaderboard(spark, d):
    t = turns(spark, d)
    return P.leaderboard(injected(t), used(t), 15)


@query("report_projects", ctes("turns") + " SELECT project, count(*) AS turns, round(avg(nullif(total_context_tokens, 0)), 6) AS tokens, round(avg(hot_count), 6) AS hot FROM turns GROUP BY project")
def report_projects(spark, d):
    return turns(spark, d).groupBy("project").agg(F.count("*").alias("turns"), F.round(F.avg(F.nullif(F.col("total_context_tokens"), F.lit(0))), 6).alias("tokens"), F.round(F.avg("hot_count"), 6).alias("hot"))


@query("report_sessions", ctes("turns") + f", m AS (SELECT session_id, project, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, project) AS n FROM turns GROUP BY 1, 2) SELECT t.session_id, count(*) AS turns, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 3) AS minutes, round(avg({WASTE}), 6) AS waste, any_value(m.project) AS project FROM turns t JOIN m ON m.session_id = t.session_id AND m.n = 1 GROUP BY t.session_id")
def report_sessions(spark, d):
    return P.sessions(turns(spark, d))


@query("report_always_hot", ctes("turns") + ", t AS (SELECT project, 'hot_' || CAST(hot_count > 0 AS VARCHAR) AS path, row_number() OVER (PARTITION BY project ORDER BY turn_id DESC) AS n FROM turns), l AS (SELECT * FROM t WHERE n <= 20), c AS (SELECT project, count(*) AS n FROM l GROUP BY project HAVING count(*) >= 10) SELECT project, path, count(*) AS hot, any_value(c.n) AS n FROM l JOIN c USING (project) GROUP BY project, path HAVING count(*) >= any_value(c.n) * 0.8")
def report_always_hot(spark, d):
    t = turns(spark, d).withColumn("path", F.concat(F.lit("hot_"), (F.col("hot_count") > 0).cast("string")))
    return P.always_hot(t, "project", "turn_id")


@query("report_phrases", ctes("prompts") + f", w AS (SELECT {words_sql('prompt', STOP)} AS ws FROM prompts), g AS (SELECT unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) AS phrase FROM w WHERE len(ws) >= 3) SELECT phrase, count(*) AS n, substr(sha256(phrase), 1, 12) AS id FROM g GROUP BY phrase HAVING count(*) >= 3 ORDER BY n DESC, phrase LIMIT 5")
def report_phrases(spark, d):
    return P.phrases(view(spark, d, "prompts").select(T.prompt_words(F.col("prompt")).alias("words")))


@query("report_high_waste", ctes("turns") + ", i AS (SELECT injected AS path, count(*) AS injected FROM turns GROUP BY 1), u AS (SELECT used AS path, count(*) AS used FROM turns WHERE waste_ratio > 0.5 GROUP BY 1) SELECT path, injected, round(1 - coalesce(used, 0) / injected, 6) AS waste FROM i LEFT JOIN u USING (path) WHERE injected >= 10 AND 1 - coalesce(used, 0) / injected >= 0.9")
def report_high_waste(spark, d):
    t = turns(spark, d)
    return P.high_waste(injected(t), used(t.where("waste_ratio > 0.5")))


@query("report_trend", ctes("turns") + ", v AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(total_context_tokens) AS t FROM turns GROUP BY 1) SELECT day, round(t / (SELECT max(t) FROM v), 6) AS share FROM v")
def report_trend(spark, d):
    v = turns(spark, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum("total_context_tokens").alias("t"))
    return P.trend(v, "day", "t")


@query("report_sparkline", ctes("turns") + ", v AS (SELECT project, injection_chars AS c, row_number() OVER (PARTITION BY project ORDER BY turn_id) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM turns) SELECT project, CAST(floor(i * 20 / n) AS BIGINT) AS part, round(avg(c), 6) AS mean FROM v GROUP BY 1, 2")
def report_sparkline(spark, d):
    return P.sparkline(turns(spark, d), "turn_id", "injection_chars", 20, "project")


@query("report_burn_projection", ctes("usage") + " SELECT model, CAST(sum(input_tokens) AS BIGINT) AS tokens, round(sum(input_tokens) / count(DISTINCT CAST(ts AS DATE)) * 30, 6) AS month, round(sum(cache_read_tokens) * 100.0::DOUBLE / sum(cache_read_tokens + input_tokens), 6) AS cache_pct FROM usage WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY model")
def report_burn_projection(spark, d):
    u = view(spark, d, "usage").where("ts >= TIMESTAMP_NTZ '2024-01-10'")
    return u.groupBy("model").agg(F.sum("input_tokens").alias("tokens"), F.round(F.sum("input_tokens") / F.count_distinct(F.to_date("ts")) * 30, 6).alias("month"), F.round(F.sum("cache_read_tokens") * 100.0 / F.sum(F.col("cache_read_tokens") + F.col("input_tokens")), 6).alias("cache_pct"))


@query("report_dashboard", ctes("turns") + f" SELECT round(count(*) / 7.0::DOUBLE, 6) AS turns_per_day, round(avg({WASTE}), 6) AS waste, CAST(sum(total_context_tokens) AS BIGINT) AS tokens FROM turns WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30'")
def report_dashboard(spark, d):
    t = turns(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-23' AND ts < TIMESTAMP_NTZ '2024-01-30'")
    return t.agg(F.round(F.count("*") / 7.0, 6).alias("turns_per_day"), F.round(F.avg(F.when(F.col("waste_ratio") >= 0, F.col("waste_ratio").cast("double"))), 6).alias("waste"), F.sum("total_context_tokens").alias("tokens"))


@query("report_history", ctes("turns") + ", h AS (SELECT injected AS path, count(*) AS n, 'hot' AS kind FROM turns WHERE confidence >= 0.8 GROUP BY 1), m AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS path, count(*) AS n, 'day' AS kind FROM turns GROUP BY 1), u AS (SELECT * FROM h UNION ALL SELECT * FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, path) AS rank FROM u) SELECT kind, path, n, rank FROM r WHERE rank <= 5")
def report_history(spark, d):
    t = turns(spark, d)
    hot = t.where("confidence >= 0.8").groupBy(F.col("injected").alias("path")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("hot"))
    day = t.groupBy(F.to_date("ts").cast("string").alias("path")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("day"))
    return top_n(hot.unionByName(day), ["kind"], [F.desc("n"), F.asc("path")], 5).select("kind", "path", "n", "rank")


@query("report_history_filter", ctes("turns") + " SELECT turn_id FROM turns WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' AND (contains(injected, '_4') OR contains(used, '_4')) AND hot_count + warm_count > 0")
def report_history_filter(spark, d):
    t = turns(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-29 12:00:00'")
    return t.where(F.exists(F.array("injected", "used"), lambda p: F.contains(p, F.lit("_4"))) & (F.col("hot_count") + F.col("warm_count") > 0)).select("turn_id")


@query("report_optimise_interval", ctes("turns") + " SELECT project, CASE WHEN w > 0.7 THEN 10 WHEN w > 0.4 THEN 25 ELSE 50 END AS every FROM (SELECT project, arg_max(waste_ratio, turn_id) AS w FROM turns GROUP BY project)")
def report_optimise_interval(spark, d):
    t = turns(spark, d).groupBy("project").agg(F.max_by("waste_ratio", "turn_id").alias("w"))
    return t.select("project", P.optimise_interval(F.col("w")).alias("every"))


@query("report_last_turns", ctes("turns") + ", r AS (SELECT project, turn_id, row_number() OVER (PARTITION BY project ORDER BY turn_id DESC) AS n FROM turns) SELECT project, turn_id FROM r WHERE n <= 25")
def report_last_turns(spark, d):
    return top_n(turns(spark, d), ["project"], [F.desc("turn_id")], 25).select("project", "turn_id")


@query("report_predictor_quality", "SELECT quality AS grp, round(CASE WHEN sum(CASE WHEN p THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN p AND a THEN 1 ELSE 0 END) / sum(CASE WHEN p THEN 1 ELSE 0 END) ELSE 0 END, 6) AS precision, round(CASE WHEN sum(CASE WHEN a THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN p AND a THEN 1 ELSE 0 END) / sum(CASE WHEN a THEN 1 ELSE 0 END) ELSE 0 END, 6) AS recall, round(CASE WHEN sum(CASE WHEN p AND a THEN 1 ELSE 0 END) > 0 THEN 2.0::DOUBLE * sum(CASE WHEN p AND a THEN 1 ELSE 0 END) / (sum(CASE WHEN p THEN 1 ELSE 0 END) + sum(CASE WHEN a THEN 1 ELSE 0 END)) ELSE 0 END, 6) AS f1 FROM (SELECT quality, doc_id % 3 = 0 AS p, toxic = 1 AS a FROM labels) GROUP BY quality")
def report_predictor_quality(spark, d):
    h = spark.read.parquet(f"{d}/labels.parquet").select(F.col("quality").alias("grp"), (F.col("doc_id") % 3 == 0).alias("predicted"), (F.col("toxic") == 1).alias("actual"))
    return P.precision_recall(h, ["grp"])


@query("report_extensions", ctes("accesses") + r" SELECT regexp_extract(path, '\.([^.]+)$', 1) AS ext, count(*) AS n FROM (SELECT DISTINCT path FROM accesses) GROUP BY 1 ORDER BY n DESC, ext LIMIT 10")
def report_extensions(spark, d):
    return view(spark, d, "accesses").select("path").distinct().groupBy(T.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(10)


@query("report_profiles", ctes("turns") + ", p AS (SELECT project, injected AS path, count(*) AS usage_count, round(avg(CAST(confidence AS DOUBLE)), 6) AS avg_score FROM turns GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY usage_count DESC, path) AS rank FROM p) SELECT * FROM r WHERE rank <= 30")
def report_profiles(spark, d):
    p = turns(spark, d).groupBy("project", F.col("injected").alias("path")).agg(F.count("*").alias("usage_count"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("avg_score"))
    return top_n(p, ["project"], [F.desc("usage_count"), F.asc("path")], 30)
