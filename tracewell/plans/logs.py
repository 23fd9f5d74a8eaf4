"""Queries of logs of changes and of the advisor."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import advisor as A
from ..sources import status_log as S
from ..sources.shared import shared_dir
from .registry import query
from .views import ctes, view


def new_log(spark):
    return f"{shared_dir(spark)}/status/{uuid.uuid4().hex}"


CHANGES = "ch AS (SELECT path AS id, pos AS seq, tool AS status, CASE WHEN k % 3 = 0 THEN user_id END AS owner, CASE WHEN tool = 'Edit' THEN turn END AS edited FROM accesses)"


@query("log_latest_states", ctes("accesses") + f", {CHANGES} SELECT id, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(owner, seq) FILTER (WHERE owner IS NOT NULL) AS owner, arg_max(edited, seq) FILTER (WHERE edited IS NOT NULL) AS edited FROM ch GROUP BY id")
def log_latest_states(spark, d):
    """The state of each file after changes in four batches, one of which comes twice, with a compaction between."""
    path = new_log(spark)
    ch = view(spark, d, "accesses").selectExpr("path AS id", "pos AS seq", "tool AS status", "CASE WHEN k % 3 = 0 THEN user_id END AS owner", "CASE WHEN tool = 'Edit' THEN turn END AS edited")
    cut = ch.agg(F.max("seq")).first()[0] or 0
    for n in range(4):
        S.append(spark, path, ch.where((F.col("seq") > cut * n // 4) & (F.col("seq") <= cut * (n + 1) // 4) | (F.lit(n) == 0) & (F.col("seq") <= 0)), n)
        if n == 2:
            S.compact(spark, path, "id", "seq")
            S.append(spark, path, ch.withColumn("status", F.lit("again")), 1)
    return S.states(spark, path, "id", "seq").select("id", "seq", "status", "owner", "edited")


TURN_LISTS = "tl AS (SELECT turn_id, project, 'hot_' || CAST(hot_count % 2 AS VARCHAR) AS h, 'file_' || CAST(warm_count AS VARCHAR) AS i, CASE WHEN warm_count % 4 = 0 THEN 'file_' || CAST(warm_count AS VARCHAR) ELSE 'x' END AS u, hot_count FROM turns), ls AS (SELECT *, row_number() OVER (ORDER BY turn_id DESC) AS n FROM tl), fifty AS (SELECT * FROM ls WHERE n <= 50)"
RULES = """hot AS (SELECT 'always_hot_' || s AS id, 'always_hot' AS type, s AS subject, count(*) AS n, 20::BIGINT AS of FROM (SELECT n, h AS s FROM fifty WHERE n <= 20 UNION ALL SELECT n, 'index' FROM fifty WHERE n <= 20) GROUP BY s HAVING count(*) >= 16),
wd AS (SELECT turn_id, ['please', 'check', 'part' || CAST(hot_count AS VARCHAR), 'again'] AS w FROM fifty), ph AS (SELECT array_to_string(w[k : k + 2], ' ') AS s, count(*) AS n FROM wd, range(1, 3) r(k) GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, s LIMIT 5), phr AS (SELECT 'phrase_' || substr(sha256(s), 1, 12) AS id, 'repeated_phrase' AS type, s AS subject, n, NULL::BIGINT AS of FROM ph),
inj AS (SELECT turn_id, i AS s, u FROM fifty UNION ALL SELECT turn_id, 'always.md', u FROM fifty), wst AS (SELECT 'high_waste_' || s AS id, 'high_waste' AS type, s AS subject, CAST(sum(CASE WHEN u = s THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS of FROM inj GROUP BY s HAVING count(*) >= 10 AND 1 - sum(CASE WHEN u = s THEN 1 ELSE 0 END) / count(*) >= 0.9),
sug AS (SELECT * FROM hot UNION ALL SELECT * FROM phr UNION ALL SELECT * FROM wst)"""


def turn_lists(spark, d):
    t = view(spark, d, "turns")
    file = F.concat(F.lit("file_"), F.col("warm_count").cast("string"))
    return t.select("turn_id", F.array(F.concat(F.lit("hot_"), (F.col("hot_count") % 2).cast("string")), F.lit("index")).alias("hot"), F.array(file, F.lit("always.md")).alias("injected"), F.array(F.when(F.col("warm_count") % 4 == 0, file).otherwise("x")).alias("used"), F.array(F.lit("please"), F.lit("check"), F.concat(F.lit("part"), F.col("hot_count").cast("string")), F.lit("again")).alias("words"))


@query("advisor_suggestions", ctes("turns") + f", {TURN_LISTS}, {RULES} SELECT id, type, subject, n, of FROM sug")
def advisor_suggestions(spark, d):
    """What the last fifty turns suggest: files that are always hot, repeated phrases, files that are injected and not used."""
    return A.suggestions(turn_lists(spark, d))


@query("advisor_listed", ctes("turns") + f", {TURN_LISTS}, {RULES} SELECT id, type, subject, CASE WHEN type = 'high_waste' THEN 'applied' WHEN type = 'always_hot' THEN 'dismissed' ELSE 'pending' END AS status, CASE WHEN type = 'repeated_phrase' THEN 1 WHEN type = 'high_waste' THEN 3 ELSE 2 END AS seq FROM sug")
def advisor_listed(spark, d):
    """Suggestions with their last status, after some were dismissed and some applied; asking again brings none back."""
    path, t = new_log(spark), turn_lists(spark, d)
    A.suggest(spark, path, t, 0, F.lit(1))
    known = A.listed(spark, path)
    A.decide(spark, path, known.where("type <> 'repeated_phrase'").select("id", F.lit("dismissed").alias("status"), F.lit(2).alias("seq")), 1)
    A.decide(spark, path, known.where("type = 'high_waste'").select("id", F.lit("applied").alias("status"), F.lit(3).alias("seq")), 2)
    S.compact(spark, path, "id", "seq")
    A.suggest(spark, path, t, 3, F.lit(4))
    return A.listed(spark, path).select("id", "type", "subject", "status", "seq")


@query("log_turn_usage", ctes("turns") + ", nw AS (SELECT project, max(turn_id) AS turn_id FROM turns GROUP BY project), cl AS (SELECT project, count(*) AS tool_calls, max(CAST(hot_count AS INT)) % 3 AS n_used FROM turns GROUP BY project) SELECT t.turn_id, t.project, c.tool_calls, CASE WHEN n.turn_id IS NULL THEN NULL WHEN injection_chars <= 0 THEN 0.0::DOUBLE WHEN n_used = 0 THEN 1.0::DOUBLE ELSE round(1 - n_used / 4, 3) END AS waste_ratio FROM turns t LEFT JOIN nw n ON t.turn_id = n.turn_id LEFT JOIN cl c ON n.project = c.project")
def log_turn_usage(spark, d):
    """The newest turn of each project takes the calls and files that its end brought, and its waste ratio."""
    t = view(spark, d, "turns").select("turn_id", "project", "injection_chars", "hot_count", F.array(*[F.lit(f"f{k}") for k in range(4)]).alias("files_injected"))
    used = F.slice(F.array(F.lit("f0"), F.lit("f1")), F.lit(1), (F.max(F.col("hot_count").cast("int")) % 3))
    usage = t.groupBy("project").agg(F.count("*").alias("tool_calls"), used.alias("files_used"))
    return A.with_usage(t, usage, project="project").select("turn_id", "project", "tool_calls", "waste_ratio")
