"""Queries of experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as E
from .registry import query
from .views import ctes, view

CON = "c AS (SELECT grp, count(*) AS sessions, round(sum(units) / sum(turns), 6) AS units_per_turn, round(sum(turns) / sum(windows), 6) AS turns_per_window, CASE WHEN sum(compactions) > 0 THEN round(sum(repeats) / sum(compactions), 6) END AS repeats_per_compaction FROM experiment GROUP BY grp)"
STREAM = "st AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CASE k % 2 WHEN 0 THEN 'ledger' ELSE 'cap' END AS component, CASE user_id % 3 WHEN 0 THEN 'treated' ELSE 'baseline' END AS arm, k % 4 <> 0 AS acting, k * 11 AS tokens FROM accesses WHERE user_id % 5 <> 0)"


def sessions(spark, d):
    return view(spark, d, "experiment")


def stream(spark, d):
    a = view(spark, d, "accesses").where("user_id % 5 <> 0")
    return a.selectExpr("CAST(user_id AS STRING) AS session_id", "CASE k % 2 WHEN 0 THEN 'ledger' ELSE 'cap' END AS component", "CASE user_id % 3 WHEN 0 THEN 'treated' ELSE 'baseline' END AS arm", "k % 4 <> 0 AS acting", "k * 11 AS tokens")


@query("experiment_groups", ctes("experiment") + f", {CON} SELECT * FROM c")
def experiment_groups(spark, d):
    return E.group_contrast(sessions(spark, d))


@query("experiment_saving", ctes("experiment") + f", {CON} SELECT round(1 - (SELECT units_per_turn FROM c WHERE grp = 'treated') / (SELECT units_per_turn FROM c WHERE grp = 'baseline'), 6) AS saving")
def experiment_saving(spark, d):
    return E.saving(E.group_contrast(sessions(spark, d)))


@query("experiment_interval")
def experiment_interval(spark, d):
    """Resampling by digests; SQL has no such digest, so tests check it on groups of a known contrast."""
    return E.bootstrap(sessions(spark, d)).select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


T_SQL = "CASE " + " ".join(f"WHEN n - 1 <= {k} THEN {v}::DOUBLE" for k, v in sorted(E.T_VALUES.items())) + " ELSE 1.96::DOUBLE END"


@query("experiment_t_intervals", ctes("experiment") + f", a AS (SELECT grp, count(*) AS n, avg(units / turns) AS m, stddev_samp(units / turns) AS s FROM experiment GROUP BY grp) SELECT grp, n, round(m, 6) AS mean, CASE WHEN n > 1 THEN round({T_SQL} * s / sqrt(n), 6) END AS half FROM a")
def experiment_t_intervals(spark, d):
    return E.t_interval(sessions(spark, d).withColumn("v", F.col("units") / F.col("turns")), "grp", "v")


@query("experiment_arms", ctes("accesses") + f", {STREAM}, a AS (SELECT component, avg(CASE WHEN arm = 'treated' THEN tokens END) AS t, avg(CASE WHEN arm = 'baseline' THEN tokens END) AS c FROM st WHERE acting GROUP BY component) SELECT component, round(t, 6) AS treated, round(c, 6) AS control, round(1 - t / c, 6) AS saving FROM a")
def experiment_arms(spark, d):
    return E.arm_contrast(stream(spark, d))


@query("experiment_session_groups", ctes("experiment", "accesses") + f", {STREAM}, f AS (SELECT session_id, bool_or(acting AND tokens > 1050) AS acted FROM st GROUP BY session_id) SELECT session_id, CASE WHEN acted IS NULL THEN 'baseline' WHEN acted THEN 'treated' ELSE 'observed' END AS grp FROM experiment LEFT JOIN f USING (session_id)")
def experiment_session_groups(spark, d):
    s = stream(spark, d).withColumn("acting", F.col("acting") & (F.col("tokens") > 1050))
    return E.session_groups(sessions(spark, d).drop("grp"), s).select("session_id", "grp")


@query("experiment_stream_summary", ctes("accesses") + f", {STREAM} SELECT session_id, bool_or(acting) AS acting, CAST(sum(CASE WHEN acting THEN tokens ELSE 0 END) AS BIGINT) AS saved, CAST(sum(CASE WHEN acting THEN 0 ELSE tokens END) AS BIGINT) AS would_save FROM st GROUP BY session_id")
def experiment_stream_summary(spark, d):
    return E.stream_summary(stream(spark, d))


@query("experiment_units", ctes("usage") + " SELECT session_id, round(sum(cache_read_tokens * 0.1::DOUBLE + cache_creation_tokens * 1.25::DOUBLE + input_tokens + output_tokens * 5.0::DOUBLE), 3) AS units, count(DISTINCT request_id) AS turns FROM usage GROUP BY session_id")
def experiment_units(spark, d):
    return view(spark, d, "usage").groupBy("session_id").agg(F.round(F.sum(E.units()), 3).alias("units"), F.count_distinct("request_id").alias("turns"))
