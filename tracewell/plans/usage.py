"""Queries of usage and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from .registry import query
from .views import ctes, view

NOW = "TIMESTAMP '2024-01-15 12:00:00'"
TOTAL = "(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens)"
IN_WINDOW = f"ts >= {NOW} - INTERVAL 5 HOUR AND ts <= {NOW}"
FAMILY = "CASE WHEN model LIKE '%opus-4-0%' OR model LIKE '%opus-4-1%' OR model LIKE '%opus-4-2025%' THEN 'opus_legacy' WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%haiku%' THEN 'haiku' ELSE 'sonnet' END"
PRICES = "prices(family, pi, po, p5, p1, pr) AS (VALUES " + ", ".join(str(p).replace("'", "'") for p in U.PRICES) + ")"
MADE = "CASE WHEN cache_creation_5m_tokens + cache_creation_1h_tokens > 0 THEN cache_creation_5m_tokens * p5 / 1e6 + cache_creation_1h_tokens * p1 / 1e6 ELSE cache_creation_tokens * p5 / 1e6 END"
PRICED = f"priced AS (SELECT *, input_tokens * pi / 1e6 AS c_in, output_tokens * po / 1e6 AS c_out, {MADE} AS c_cc, cache_read_tokens * pr / 1e6 AS c_cr FROM (SELECT *, {FAMILY} AS family FROM usage) JOIN prices USING (family))"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in U.PARTS)


def now():
    return F.expr(NOW)


def usage(spark, d):
    return view(spark, d, "usage")


@query("usage_records_deduplicated", ctes("usage") + " SELECT request_id, session_id, model, input_tokens FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts) AS n FROM (SELECT * FROM usage UNION ALL SELECT * FROM usage)) WHERE n = 1")
def usage_records_deduplicated(spark, d):
    twice = usage(spark, d).unionByName(usage(spark, d))
    return U.first_of_requests(twice, ["ts"]).select("request_id", "session_id", "model", "input_tokens")


@query("usage_window_scan", ctes("usage") + f" SELECT ts, request_id, model FROM usage WHERE {IN_WINDOW}")
def usage_window_scan(spark, d):
    return U.in_window(usage(spark, d), now()).select("ts", "request_id", "model")


@query("usage_history_scan", ctes("usage") + f" SELECT request_id, project FROM usage WHERE ts >= {NOW} - INTERVAL 7 DAY AND ts <= {NOW}")
def usage_history_scan(spark, d):
    return U.in_window(usage(spark, d), now(), hours=24 * 7).select("request_id", "project")


@query("usage_window_stats", ctes("usage") + f", s AS (SELECT model, session_id, project, grouping_id(model, session_id, project) AS g, CAST(sum({TOTAL}) AS BIGINT) AS window_tokens, {SUMS}, count(*) AS api_calls FROM usage GROUP BY GROUPING SETS ((), (model), (session_id), (project))) SELECT CASE g WHEN 7 THEN 'total' WHEN 3 THEN 'model' WHEN 5 THEN 'session' ELSE 'project' END AS level, coalesce(model, session_id, project, '') AS name, window_tokens, {', '.join(U.PARTS)}, api_calls FROM s")
def usage_window_stats(spark, d):
    return U.window_stats(usage(spark, d))


@query("usage_primary_model", ctes("usage") + f" SELECT model AS primary_model, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM usage GROUP BY model ORDER BY tokens DESC, model LIMIT 1")
def usage_primary_model(spark, d):
    return U.primary_model(usage(spark, d))


@query("usage_burn_rate", ctes("usage") + f""", w AS (SELECT ts, {TOTAL} AS t FROM usage WHERE {IN_WINDOW}), r AS (SELECT * FROM w WHERE ts >= {NOW} - INTERVAL 15 MINUTE), p AS (SELECT * FROM r WHERE (SELECT count(*) FROM r) >= 2 UNION ALL SELECT * FROM w WHERE (SELECT count(*) FROM r) < 2),
a AS (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS m, sum(t) AS t FROM p) SELECT round(t / m, 6) AS tokens_per_minute, round(m, 1) AS sample_minutes, n AS sample_count FROM a WHERE n >= 2 AND m >= 0.5""")
def usage_burn_rate(spark, d):
    return U.burn_rate(U.in_window(usage(spark, d), now()), now())


@query("usage_cost", ctes("usage") + f", {PRICES}, {PRICED}, s AS (SELECT model, project, grouping_id(model, project) AS g, round(sum(c_in + c_out + c_cc + c_cr), 2) AS cost FROM priced GROUP BY GROUPING SETS ((), (model), (project))) SELECT CASE g WHEN 3 THEN 'total' WHEN 1 THEN 'model' ELSE 'project' END AS level, coalesce(model, project, '') AS name, cost FROM s")
def usage_cost(spark, d):
    return U.estimate_cost(usage(spark, d))


@query("usage_daily", ctes("usage") + f" SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(sum(input_tokens + output_tokens + cache_creation_tokens) AS BIGINT) AS billable_tokens, {SUMS}, count(*) AS api_calls FROM usage GROUP BY 1")
def usage_daily(spark, d):
    return U.daily(usage(spark, d))


@query("usage_by_project", ctes("usage") + " SELECT project, CAST(sum(input_tokens + output_tokens + cache_creation_tokens) AS BIGINT) AS billable_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(*) AS api_calls, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(DISTINCT session_id) AS sessions FROM usage GROUP BY project")
def usage_by_project(spark, d):
    return U.by_project(usage(spark, d))


@query("usage_insights", ctes("usage") + f""", d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, CAST(sum({TOTAL}) AS BIGINT) AS t FROM usage GROUP BY 1), b AS (SELECT * FROM d ORDER BY t DESC, d LIMIT 1),
a AS (SELECT count(*) AS n, count(DISTINCT session_id) AS s, sum({TOTAL}) AS t, sum(cache_read_tokens) AS r, sum(input_tokens) AS i, sum(cache_creation_tokens) AS c FROM usage), n AS (SELECT count(*) AS days FROM d)
SELECT a.n AS api_calls, s AS sessions, days, round(a.t / s, 6) AS tokens_per_session, round(a.t / days, 6) AS tokens_per_day, round(r * 100.0::DOUBLE / (r + i + c), 6) AS cache_hit_pct, b.d AS busiest_day, b.t AS busiest_tokens FROM a, b, n""")
def usage_insights(spark, d):
    return U.insights(usage(spark, d))


@query("usage_peak_hours", ctes("usage") + f" SELECT CAST(extract(hour FROM ts) AS INT) AS hour, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM usage GROUP BY 1 ORDER BY tokens DESC, hour LIMIT 5")
def usage_peak_hours(spark, d):
    return U.top_by(usage(spark, d), F.hour("ts"), "hour", 5)


@query("usage_top_branches", ctes("usage") + f" SELECT git_branch, CAST(sum({TOTAL}) AS BIGINT) AS tokens FROM usage GROUP BY 1 ORDER BY tokens DESC, git_branch LIMIT 10")
def usage_top_branches(spark, d):
    return U.top_by(usage(spark, d), F.col("git_branch"), "git_branch", 10)


@query("usage_billing_audit", ctes("usage") + f""", {PRICES}, {PRICED}, f AS (SELECT family FROM priced GROUP BY family ORDER BY count(*) DESC, family LIMIT 1),
s AS (SELECT {SUMS}, round(sum(c_in), 2) AS cost_input, round(sum(c_out), 2) AS cost_output, round(sum(c_cc), 2) AS cost_cache_creation, round(sum(c_cr), 2) AS cost_cache_read, round(sum(c_in + c_out + c_cc + c_cr), 2) AS cost_total FROM priced)
SELECT s.*, f.family AS common_family, round(cache_read_tokens * 100.0::DOUBLE / {TOTAL}, 1) AS cache_read_pct, round((input_tokens + cache_creation_tokens + cache_read_tokens) * 5.0::DOUBLE / 1e6 + output_tokens * 25.0::DOUBLE / 1e6, 2) AS flat_rate_cost FROM s, f""")
def usage_billing_audit(spark, d):
    return U.billing_audit(usage(spark, d))


@query("usage_budget", ctes("usage") + f" SELECT CAST(sum(CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN {TOTAL} END) AS BIGINT) AS daily_tokens, CAST(sum(CASE WHEN CAST(ts AS DATE) > DATE '2024-01-08' AND CAST(ts AS DATE) <= DATE '2024-01-15' THEN {TOTAL} END) AS BIGINT) AS weekly_tokens FROM usage")
def usage_budget(spark, d):
    return U.budget_usage(usage(spark, d), F.lit("2024-01-15").cast("date"))


@query("usage_budget_levels", ctes("usage") + f", s AS (SELECT project, CAST(sum({TOTAL}) AS BIGINT) AS used FROM usage GROUP BY project), b AS (SELECT *, (CAST(substr(project, 5) AS BIGINT)) * 1500000 AS budget FROM s) SELECT project, used, CASE WHEN budget <= 0 THEN NULL WHEN used * 100.0 / budget >= 95 THEN 'critical' WHEN used * 100.0 / budget >= 80 THEN 'warning' WHEN used * 100.0 / budget >= 60 THEN 'notice' ELSE 'ok' END AS level FROM b")
def usage_budget_levels(spark, d):
    s = usage(spark, d).groupBy("project").agg(F.sum(U.total_tokens()).alias("used"))
    return s.withColumn("budget", F.expr("CAST(substring(project, 5) AS BIGINT) * 1500000")).select("project", "used", U.budget_level(F.col("used"), F.col("budget")).alias("level"))


@query("usage_session_summary", ctes("usage") + f", s AS (SELECT CAST(sum({TOTAL}) AS BIGINT) AS t FROM usage WHERE {IN_WINDOW}) SELECT t AS window_tokens, round(t * 100.0::DOUBLE / 500000, 1) AS pct, greatest(0, t - 100000) AS session_tokens, CASE WHEN t >= 500000 THEN 'max_20x' WHEN t >= 150000 THEN 'max_5x' ELSE 'pro' END AS plan FROM s")
def usage_session_summary(spark, d):
    return U.session_summary(U.in_window(usage(spark, d), now()), 100_000, 500_000)


@query("usage_model_family", ctes("usage") + f" SELECT {FAMILY} AS family, count(*) AS n FROM usage GROUP BY 1")
def usage_model_family(spark, d):
    return usage(spark, d).groupBy(U.model_family(F.col("model")).alias("family")).agg(F.count("*").alias("n"))


@query("usage_weekly_by_model", ctes("usage") + f" SELECT CAST(date_trunc('week', ts) AS DATE) AS week, model, CAST(sum({TOTAL}) AS BIGINT) AS tokens, count(*) AS api_calls FROM usage GROUP BY 1, 2")
def usage_weekly_by_model(spark, d):
    return usage(spark, d).groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "model").agg(F.sum(U.total_tokens()).alias("tokens"), F.count("*").alias("api_calls"))


@query("usage_export", ctes("usage") + " SELECT ts, model, project, session_id, input_tokens, output_tokens, cache_read_tokens FROM usage")
def usage_export(spark, d):
    return usage(spark, d).select("ts", "model", "project", "session_id", "input_tokens", "output_tokens", "cache_read_tokens")
