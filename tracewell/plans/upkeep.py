"""Queries of upkeep and interchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interchange as I
from ..operators import learning as L
from ..operators import upkeep as U
from .learning import WORDS, turn_words
from .registry import query
from .views import ctes, view

AFF = f"{WORDS}, af AS (SELECT word, path, round(least(1.0, count(*) * 0.08::DOUBLE), 4) AS affinity FROM w JOIN u USING (turn_id) GROUP BY word, path)"


def accesses(spark, d):
    return view(spark, d, "accesses")


@query("upkeep_listed_documents", ctes("accesses") + ", l AS (SELECT DISTINCT CASE k % 5 WHEN 0 THEN '../' || path WHEN 1 THEN 'a/../../' || path WHEN 2 THEN 'a/../' || path WHEN 3 THEN '/' || path ELSE path END AS doc, k FROM accesses), e AS (SELECT DISTINCT path AS doc FROM accesses WHERE k % 3 = 0) SELECT doc, CASE WHEN k % 5 IN (0, 1, 3) THEN 'outside' WHEN doc IN (SELECT doc FROM e) THEN 'kept' ELSE 'absent' END AS state FROM l")
def upkeep_listed_documents(spark, d):
    a = accesses(spark, d)
    listed = a.selectExpr("CASE k % 5 WHEN 0 THEN '../' || path WHEN 1 THEN 'a/../../' || path WHEN 2 THEN 'a/../' || path WHEN 3 THEN '/' || path ELSE path END AS doc")
    return U.listed_documents(listed, a.where("k % 3 = 0").selectExpr("path AS doc"))


@query("upkeep_fresh_profiles", ctes("accesses") + ", p AS (SELECT session_id, max(ts) AS last_active FROM accesses GROUP BY session_id) SELECT session_id FROM p WHERE last_active >= (SELECT max(last_active) FROM p) - INTERVAL 14 DAY")
def upkeep_fresh_profiles(spark, d):
    p = accesses(spark, d).groupBy("session_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_active"))
    now = p.agg(F.max("last_active")).first()[0]
    return U.fresh_profiles(p, F.lit(now)).select("session_id")


@query("upkeep_kept_sources", ctes("accesses") + r", s AS (SELECT user_id, path, sum(k) AS score FROM accesses GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, path) AS n FROM s WHERE regexp_matches(path, '\.(py|ts)$')) SELECT user_id, path, score FROM r WHERE n <= 5 UNION ALL SELECT * FROM s WHERE NOT regexp_matches(path, '\.(py|ts)$')")
def upkeep_kept_sources(spark, d):
    s = accesses(spark, d).groupBy("user_id", "path").agg(F.sum("k").cast("decimal(38,0)").alias("score"))
    return U.kept_sources(s, ["user_id"], 5)


@query("upkeep_swept", ctes("accesses") + ", o AS (SELECT pos AS name, user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS written FROM accesses), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY written DESC, name) AS n, max(written) OVER () AS now FROM o) SELECT name FROM r WHERE n > 20 OR now - written > 864000")
def upkeep_swept(spark, d):
    o = accesses(spark, d).select(F.col("pos").alias("name"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("written"))
    return U.swept(o, ["user_id"], F.lit(o.agg(F.max("written")).first()[0]), 20, 864_000).select("name")


@query("upkeep_nudges", ctes("turns") + ", t AS (SELECT turn_id, was_notification AS noted, hot_count AS edits, CAST(turn_id % 3 AS INT) AS commits, warm_count AS n FROM turns) SELECT turn_id, NOT noted AND NOT (edits < 3 AND commits = 0) AND n >= 8 AS due, CASE WHEN noted THEN 'a note has already been written in this window' WHEN edits < 3 AND commits = 0 THEN 'only ' || edits || ' edit(s) and ' || commits || ' commit(s) so far' WHEN n < 8 THEN 'nudged ' || n || ' turn(s) ago' ELSE edits || ' edit(s), ' || commits || ' commit(s), no note yet' END AS why FROM t")
def upkeep_nudges(spark, d):
    t = view(spark, d, "turns")
    return t.select("turn_id", U.nudge(F.col("was_notification"), F.col("hot_count"), (F.col("turn_id") % 3).cast("int"), F.col("warm_count"), 3, 8).alias("n")).select("turn_id", "n.*")


@query("upkeep_changed_settings", ctes("turns") + ", r AS (SELECT turn_id, project, hot_count, warm_count, row_number() OVER (PARTITION BY project ORDER BY turn_id DESC) AS n FROM turns) SELECT turn_id, CASE WHEN hot_count = warm_count THEN 'new:->1' ELSE 'hot:' || warm_count || '->' || hot_count || ', new:->1' END AS changes FROM r WHERE n <= 10".replace("new:->1", "new:-->1"))
def upkeep_changed_settings(spark, d):
    runs = view(spark, d, "turns").selectExpr("turn_id", "project", "map('hot', CAST(hot_count AS STRING), 'new', '1', 'same', 'x') AS new", "map('hot', CAST(warm_count AS STRING), 'same', 'x') AS previous")
    return U.changed_settings(runs, ["project"], "turn_id").select("turn_id", "changes")


@query("upkeep_hit_rates", ctes("accesses") + ", c AS (SELECT user_id, path, count(*) AS n FROM accesses WHERE tool = 'Read' GROUP BY 1, 2), p AS (SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, path) AS rank FROM c), a AS (SELECT DISTINCT user_id, path FROM accesses WHERE tool = 'Edit'), b AS (SELECT a.user_id, min(rank) AS best FROM a LEFT JOIN p ON p.user_id = a.user_id AND p.path = a.path GROUP BY 1) SELECT count(*) AS turns, round(avg(CASE WHEN best <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_at_1, round(avg(CASE WHEN best <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_at_5 FROM b")
def upkeep_hit_rates(spark, d):
    a = accesses(spark, d)
    c = a.where("tool = 'Read'").groupBy("user_id", "path").agg(F.count("*").alias("n"))
    return U.hit_rates(L.top_n(c, ["user_id"], [F.desc("n"), F.asc("path")], 5), a.where("tool = 'Edit'").select("user_id", "path"), ["user_id"])


@query("upkeep_focus", ctes("accesses") + r", p AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN 'src/' || path WHEN 1 THEN 'src/app/' || path WHEN 2 THEN 'src/.x/' || path ELSE path END AS path, k FROM accesses WHERE regexp_matches(path, '\.(py|ts)$')), q AS (SELECT DISTINCT path, k FROM p) SELECT path, CASE k % 4 WHEN 1 THEN round(0.8::DOUBLE - 2 * 0.15::DOUBLE, 6) END AS score FROM q WHERE k % 4 = 1 UNION ALL SELECT DISTINCT 'src/' || CAST(k AS VARCHAR) || '.py', 0.2::DOUBLE FROM accesses")
def upkeep_focus(spark, d):
    a = accesses(spark, d)
    p = a.selectExpr("CASE k % 4 WHEN 0 THEN 'src/' || path WHEN 1 THEN 'src/app/' || path WHEN 2 THEN 'src/.x/' || path ELSE path END AS path").unionByName(a.selectExpr("'src/' || k || '.py' AS path"))
    return U.focus_scores(p.distinct(), "src/app")


@query("upkeep_indexed_paths", ctes("accesses") + ", i AS (SELECT DISTINCT path FROM accesses), q AS (SELECT DISTINCT CASE k % 3 WHEN 0 THEN './' || path WHEN 1 THEN '/home/x/' || path ELSE string_split(path, '/')[2] END AS asked FROM accesses), n AS (SELECT asked, regexp_replace(asked, '^[./]+', '') AS norm FROM q), m AS (SELECT asked, path, norm <> path AS other FROM n JOIN i ON norm = path OR ends_with(norm, '/' || path) OR ends_with(path, '/' || norm)) SELECT asked, arg_min(path, (other, path)) AS path FROM m GROUP BY asked")
def upkeep_indexed_paths(spark, d):
    a = accesses(spark, d)
    return U.indexed_paths(a.selectExpr("CASE k % 3 WHEN 0 THEN './' || path WHEN 1 THEN '/home/x/' || path ELSE split(path, '/')[1] END AS asked"), a)


@query("upkeep_history_keywords", ctes("prompts") + ", w AS (SELECT session_id, turn, list_filter(regexp_split_to_array(lower(prompt), '\\s+'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in U.HISTORY_STOP) + "], x)) AS w FROM prompts) SELECT session_id, turn, array_to_string(w[1:8], ' ') AS words FROM w")
def upkeep_history_keywords(spark, d):
    return view(spark, d, "prompts").select("session_id", "turn", F.array_join(U.history_keywords(F.col("prompt")), " ").alias("words"))


@query("interchange_files_in_use", ctes("accesses") + ", s AS (SELECT path, (k % 10) / 10.0 AS score FROM (SELECT DISTINCT path, k FROM accesses)), o AS (SELECT DISTINCT k AS id, 'File_' || CAST(k % 40 AS VARCHAR) || '.md' AS f, 'x/file_' || CAST(k % 60 AS VARCHAR) || '.rs' AS g FROM accesses) SELECT DISTINCT id FROM o JOIN s ON score >= 0.25 AND (contains(path, regexp_extract(f, '(File_[0-9]+)', 1)) OR contains(path, regexp_extract(g, '(file_[0-9]+)', 1)))")
def interchange_files_in_use(spark, d):
    a = accesses(spark, d)
    obs = a.selectExpr("k AS id", "array('File_' || (k % 40) || '.md', 'x/file_' || (k % 60) || '.rs') AS related_files").distinct()
    return I.of_files_in_use(obs, a.selectExpr("path", "(k % 10) / 10.0 AS score").distinct()).select("id")


def exported(spark, d):
    aff = L.affinity(*turn_words(spark, d))
    edges = aff.where("affinity <= 0.9").selectExpr("word AS src", "path AS dst", "affinity / 2 AS weight")
    found = spark.read.parquet(f"{d}/benchmark.parquet").selectExpr("CAST(item_id AS STRING) AS description", "'f' AS path")
    return I.ledger_rows(aff, edges, found)


LEDGER = AFF + ", lr AS (SELECT 'observation' AS type, format('Learned association: ''{}'' → {} (score: {:.2f})', word, path, affinity) AS content FROM af WHERE affinity > 0.5 UNION ALL SELECT 'observation', format('Co-activation pattern: {} ↔ {} (score: {:.2f})', word, path, affinity / 2) FROM af WHERE affinity <= 0.9 AND affinity / 2 > 0.3 UNION ALL SELECT 'discovery', CAST(item_id AS VARCHAR) FROM benchmark)"


@query("interchange_ledger", ctes("prompts") + f", {LEDGER} SELECT type, content FROM lr")
def interchange_ledger(spark, d):
    return exported(spark, d).select("type", "content")


@query("interchange_learned", ctes("prompts") + f", {AFF} SELECT 'affinity' AS kind, word AS a, path AS b, affinity AS v FROM af WHERE affinity > 0.5 UNION ALL SELECT 'edge', word, path, affinity / 2 FROM af WHERE affinity <= 0.9 AND affinity / 2 > 0.3 UNION ALL SELECT 'discovery', CAST(item_id AS VARCHAR), 'f', NULL FROM benchmark")
def interchange_learned(spark, d):
    """What was learned, to the ledger and back."""
    a, e, f = I.learned_from_ledger(exported(spark, d))
    row = lambda df, kind, *cols: df.select(F.lit(kind).alias("kind"), *[F.col(c).alias(n) if c else F.lit(None).cast("double").alias(n) for c, n in zip(cols, "abv", strict=True)])
    return row(a, "affinity", "word", "path", "affinity").unionByName(row(e, "edge", "src", "dst", "weight")).unionByName(row(f, "discovery", "description", "path", None))
