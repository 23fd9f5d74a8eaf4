"""Queries of relevance routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing as R
from .registry import query
from .views import ctes, view

ST = "st AS (SELECT user_id AS session, path, round(least(1.0::DOUBLE, count(*) / 4.0::DOUBLE), 6) AS score, CAST(count(*) % 4 AS BIGINT) AS streak FROM accesses WHERE tool IN ('Read', 'Edit') GROUP BY 1, 2)"
AC = "ac AS (SELECT user_id AS session, path, max(CASE WHEN k % 4 = 0 THEN 1.0::DOUBLE ELSE round(k / 200.0::DOUBLE, 6) END) AS rel FROM accesses WHERE tool = 'Bash' AND k % 3 = 0 GROUP BY 1, 2)"
CO = "nx AS (SELECT path, lead(path) OVER (PARTITION BY user_id ORDER BY pos) AS nxt, k, lead(k) OVER (PARTITION BY user_id ORDER BY pos) AS kn FROM accesses), co AS (SELECT DISTINCT path AS src, nxt AS dst FROM nx WHERE nxt IS NOT NULL AND path <> nxt AND (k + kn) % 9 = 0), im AS (SELECT DISTINCT path AS src, nxt AS dst FROM nx WHERE nxt IS NOT NULL AND path <> nxt AND (k + kn) % 11 = 1), cc AS (SELECT DISTINCT path AS src, nxt AS dst, round((k % 10) / 10.0::DOUBLE, 6) AS strength FROM nx WHERE nxt IS NOT NULL AND path <> nxt AND (k + kn) % 7 = 2)"
DEC = "CASE WHEN starts_with(path, 'docs/') THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END"
TIER = "CASE WHEN {0} >= 0.8 THEN 'HOT' WHEN {0} >= 0.25 THEN 'WARM' WHEN {0} >= 0.15 THEN 'HINT' ELSE 'COLD' END"
TURN = f"""{ST}, {AC}, {CO},
s0 AS (SELECT coalesce(st.session, ac.session) AS session, coalesce(st.path, ac.path) AS path, greatest(coalesce(score * 0.7::DOUBLE, 0), coalesce(rel, 0)) AS s, coalesce(streak, 0) AS streak, rel IS NOT NULL AS direct FROM st FULL JOIN ac ON st.session = ac.session AND st.path = ac.path),
p1 AS (SELECT session, dst AS path, sum(0.35::DOUBLE) AS p FROM ac JOIN co ON co.src = ac.path GROUP BY 1, 2), p2 AS (SELECT DISTINCT p1.session, co.dst AS path, 0.075::DOUBLE AS p FROM p1 JOIN co ON co.src = p1.path),
p3 AS (SELECT session, path, sum(p) AS p FROM (SELECT session, dst AS path, 0.15::DOUBLE AS p FROM ac JOIN im ON im.src = ac.path UNION ALL SELECT session, src, 0.10::DOUBLE FROM ac JOIN im ON im.dst = ac.path) GROUP BY 1, 2), p4 AS (SELECT session, dst AS path, sum(least(0.2::DOUBLE, strength * 0.25::DOUBLE)) AS p FROM ac JOIN cc ON cc.src = ac.path GROUP BY 1, 2),
j AS (SELECT s0.*, p1.p AS a, p2.p AS b, p3.p AS c, p4.p AS d FROM s0 LEFT JOIN p1 USING (session, path) LEFT JOIN p2 USING (session, path) LEFT JOIN p3 USING (session, path) LEFT JOIN p4 USING (session, path)),
s1 AS (SELECT *, least(1.0::DOUBLE, s + coalesce(a, 0)) AS x1 FROM j), s2 AS (SELECT *, CASE WHEN x1 < 0.25 AND NOT direct THEN least(1.0::DOUBLE, x1 + coalesce(b, 0)) ELSE x1 END AS x2 FROM s1), s3 AS (SELECT *, least(1.0::DOUBLE, x2 + coalesce(c, 0)) AS x3 FROM s2), s4 AS (SELECT *, CASE WHEN x3 > 0.01 THEN least(1.0::DOUBLE, x3 + coalesce(d, 0)) ELSE x3 END AS x4 FROM s3),
s5 AS (SELECT *, CASE WHEN ends_with(path, '_5.ts') OR path = 'mod7/file_7.md' THEN greatest(x4, 0.35::DOUBLE) ELSE x4 END AS x5 FROM s4), s6 AS (SELECT session, path, streak, CASE WHEN path = 'mod9/file_9.py' AND NOT direct THEN x5 * 0.5::DOUBLE ELSE x5 END AS x6 FROM s5),
turn AS (SELECT session, path, round(x6, 9) AS score, CASE WHEN x6 >= 0.25 THEN streak + 1 ELSE 0 END AS streak, {TIER.format('x6')} AS tier FROM s6)"""


def accesses(spark, d):
    return view(spark, d, "accesses").withColumnRenamed("user_id", "session")


def next_edges(a):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("pos")
    return a.select(F.col("path").alias("src"), F.lead("path").over(w).alias("dst"), "k", (F.col("k") + F.lead("k").over(w)).alias("kk")).where("dst IS NOT NULL AND src <> dst")


def turn(spark, d):
    a = accesses(spark, d)
    state = a.where("tool IN ('Read', 'Edit')").groupBy("session", "path").agg(F.round(F.least(F.lit(1.0), F.count("*") / 4.0), 6).alias("score"), (F.count("*") % 4).alias("streak"))
    act = a.where("tool = 'Bash' AND k % 3 = 0").select("session", "path", F.when(F.col("k") % 4 == 0, 1.0).otherwise(F.round(F.col("k") / 200.0, 6)).alias("relevance"))
    e = next_edges(a)
    pick = lambda m, r, *cols: e.where(f"kk % {m} = {r}").select("src", "dst", *cols).distinct()
    pinned = a.select("path").distinct().where("path LIKE '%!_5.ts' ESCAPE '!' OR path = 'mod7/file_7.md'")
    demoted = spark.createDataFrame([("mod9/file_9.py",)], "path string")
    return R.attention_turn(state, act, pick(9, 0), pick(11, 1), pick(7, 2, F.round((F.col("k") % 10) / 10.0, 6).alias("strength")), pinned, demoted)


@query("routing_attention", ctes("accesses") + f", {TURN} SELECT session, path, score, streak, tier FROM turn")
def routing_attention(spark, d):
    return turn(spark, d)


@query("routing_selected", ctes("accesses") + f""", {TURN}, z AS (SELECT path, CAST(max(k) * 40 AS BIGINT) AS size FROM accesses GROUP BY path), r AS (SELECT *, row_number() OVER (PARTITION BY session, tier ORDER BY streak DESC, score DESC, path) AS rank FROM turn WHERE tier <> 'COLD'),
c AS (SELECT r.*, CAST(CASE tier WHEN 'HOT' THEN coalesce(size, 0) WHEN 'WARM' THEN least(coalesce(size, 0), 2000) ELSE length(path) END AS BIGINT) AS chars FROM r LEFT JOIN z USING (path) WHERE rank <= CASE tier WHEN 'HOT' THEN 3 WHEN 'WARM' THEN 8 ELSE 20 END), u AS (SELECT *, sum(chars) OVER (PARTITION BY session ORDER BY CASE tier WHEN 'HOT' THEN 0 WHEN 'WARM' THEN 1 ELSE 2 END, rank) AS used FROM c) SELECT session, path, tier, rank, chars FROM u WHERE used <= 15000""")
def routing_selected(spark, d):
    sizes = accesses(spark, d).groupBy("path").agg((F.max("k") * 40).alias("size"))
    return R.selected(turn(spark, d), sizes, 15_000)


@query("routing_observed", ctes("accesses") + f", {ST}, o AS (SELECT user_id AS session, path, max(CASE WHEN tool IN ('Read', 'Edit') THEN 0.75::DOUBLE WHEN k % 2 = 0 THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END) AS p FROM accesses WHERE k % 5 <> 0 GROUP BY 1, 2) SELECT coalesce(st.session, o.session) AS session, coalesce(st.path, o.path) AS path, greatest(coalesce(score, 0), coalesce(p, 0)) AS score FROM st FULL JOIN o ON st.session = o.session AND st.path = o.path")
def routing_observed(spark, d):
    a = accesses(spark, d)
    state = a.where("tool IN ('Read', 'Edit')").groupBy("session", "path").agg(F.round(F.least(F.lit(1.0), F.count("*") / 4.0), 6).alias("score"))
    calls = a.where("k % 5 <> 0").withColumn("tool", F.expr("CASE WHEN tool IN ('Read', 'Edit') THEN tool WHEN k % 2 = 0 THEN 'Grep' ELSE 'Glob' END"))
    return R.observed(state, calls)


@query("routing_intents", ctes("accesses") + ", s AS (SELECT path, CAST(count(*) % 4 AS INT) AS streak, round(count(*) / 200.0::DOUBLE, 6) AS score FROM accesses GROUP BY path) SELECT path, round(least(1.0::DOUBLE, score + CASE WHEN streak >= 2 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ends_with(path, '.py') OR ends_with(path, '.ts') THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN ends_with(path, '.md') THEN 0.2::DOUBLE ELSE 0 END), 9) AS score FROM s")
def routing_intents(spark, d):
    s = accesses(spark, d).groupBy("path").agg((F.count("*") % 4).alias("streak"), F.round(F.count("*") / 200.0, 6).alias("score"))
    return R.boosted_by_intent(s, F.expr("array('recent_edits', 'module_files', 'doc_files')")).select("path", "score")


@query("routing_warm_state", ctes("commits") + ", m AS (SELECT path, min(commit_idx) AS i, count(*) AS n FROM commits GROUP BY path), s AS (SELECT path, 0.40::DOUBLE * round(1.0::DOUBLE - 0.9::DOUBLE * i / (SELECT max(i) + 1 FROM m), 6) + 0.20::DOUBLE * round(n / (SELECT max(n) FROM m), 6) AS s FROM m), p AS (SELECT 'part_' || CAST((CAST(substr(path, 6) AS INT) + 1) % 50 AS VARCHAR) AS path, max(s) * 0.4::DOUBLE AS p FROM s GROUP BY 1), f AS (SELECT coalesce(s.path, p.path) AS path, round(greatest(coalesce(s, 0), coalesce(p, 0)), 9) AS score FROM s FULL JOIN p ON s.path = p.path), t AS (SELECT * FROM f ORDER BY score DESC, path LIMIT 25) SELECT path, least(score, 0.75::DOUBLE) AS score FROM t WHERE score >= 0.30")
def routing_warm_state(spark, d):
    m = view(spark, d, "commits").groupBy("path").agg(F.min("commit_idx").alias("i"), F.count("*").alias("n"))
    top = m.agg((F.max("i") + 1).alias("ti"), F.max("n").alias("tn"))  # one row
    m = m.crossJoin(F.broadcast(top))
    signals = m.select(F.lit("recency").alias("signal"), "path", F.round(1.0 - F.lit(0.9) * F.col("i") / F.col("ti"), 6).alias("value")).unionByName(m.select(F.lit("frequency").alias("signal"), "path", F.round(F.col("n") / F.col("tn"), 6).alias("value")))
    pairs = m.select(F.col("path").alias("src"), F.concat(F.lit("part_"), (F.substring("path", 6, 9).cast("int") + 1) % 50).alias("dst"))
    return R.warm_state(signals, pairs)
