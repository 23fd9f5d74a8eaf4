"""Queries of learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learning as L
from ..operators import prediction as P
from ..sources.shared import written
from .registry import query
from .text import INGEST, STOP, words_sql
from .views import ctes, view

TOPS = "baskets AS (SELECT * FROM injections QUALIFY row_number() OVER (PARTITION BY turn_id, project ORDER BY seen, path) <= 6)"
PAIRS = "p AS (SELECT a.path AS a, b.path AS b, count(*) AS shared FROM baskets a JOIN baskets b ON a.turn_id = b.turn_id AND a.path < b.path GROUP BY 1, 2), n AS (SELECT path, count(*) AS n FROM baskets GROUP BY path), j AS (SELECT a, b, shared, shared / (x.n + y.n - shared) AS w FROM p JOIN n x ON x.path = a JOIN n y ON y.path = b WHERE shared >= 3)"
WORDS = f"w AS (SELECT session_id || '/' || CAST(turn AS VARCHAR) AS turn_id, unnest({words_sql('prompt', STOP)}) AS word FROM prompts), u AS (SELECT session_id || '/' || CAST(turn AS VARCHAR) AS turn_id, 'doc_' || CAST(length(prompt) % 7 AS VARCHAR) AS path FROM prompts)"


def baskets(spark, d):
    return view(spark, d, "baskets")


def injections(spark, d):
    return view(spark, d, "injections")


def accesses(spark, d):
    return view(spark, d, "accesses")


def turn_words(spark, d):
    p = view(spark, d, "prompts").withColumn("turn_id", F.concat_ws("/", "session_id", "turn"))
    return p.select("turn_id", F.explode(T.prompt_words(F.col("prompt"))).alias("word")), p.select("turn_id", F.concat(F.lit("doc_"), F.length("prompt") % 7).alias("path"))


@query("learn_coactivation", ctes("injections") + f", {TOPS}" + f", {PAIRS}, e AS (SELECT a, b, w FROM j WHERE w >= 0.25) SELECT a AS src, b AS dst, round(w, 9) AS weight FROM e UNION ALL SELECT b, a, round(w, 9) FROM e")
def learn_coactivation(spark, d):
    return L.coactivation(injections(spark, d), ["turn_id"], "seen").withColumn("weight", F.round("weight", 9))


@query("learn_coactivation_by_project", ctes("injections") + f", {TOPS}" + ", p AS (SELECT a.project, a.path AS a, b.path AS b, count(*) AS shared FROM baskets a JOIN baskets b ON a.turn_id = b.turn_id AND a.project = b.project AND a.path < b.path GROUP BY 1, 2, 3), n AS (SELECT project, path, count(*) AS n FROM baskets GROUP BY 1, 2), e AS (SELECT p.project, a, b, shared / (x.n + y.n - shared) AS w FROM p JOIN n x ON x.path = a AND x.project = p.project JOIN n y ON y.path = b AND y.project = p.project WHERE shared >= 3) SELECT project, count(*) * 2 AS edges, round(sum(w) * 2, 6) AS weight FROM e WHERE w >= 0.25 GROUP BY project")
def learn_coactivation_by_project(spark, d):
    return L.coactivation(injections(spark, d), ["project", "turn_id"], "seen").groupBy("project").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query("learn_global_coactivation", ctes("injections") + f", {TOPS}" + ", p AS (SELECT a.project, a.path AS a, b.path AS b, count(*) AS shared FROM baskets a JOIN baskets b ON a.turn_id = b.turn_id AND a.project = b.project AND a.path < b.path GROUP BY 1, 2, 3), n AS (SELECT project, path, count(*) AS n FROM baskets GROUP BY 1, 2), e AS (SELECT p.project, a, b, shared / (x.n + y.n - shared) AS w FROM p JOIN n x ON x.path = a AND x.project = p.project JOIN n y ON y.path = b AND y.project = p.project WHERE shared >= 3), f AS (SELECT a, b FROM e WHERE w >= 0.25 UNION SELECT b, a FROM e WHERE w >= 0.25) SELECT a AS src, count(*) AS partners FROM f GROUP BY a")
def learn_global_coactivation(spark, d):
    """The union of all projects' edges."""
    return L.coactivation(injections(spark, d), ["project", "turn_id"], "seen").select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("partners"))


@query("learn_cochange", ctes("commits") + """, s AS (SELECT commit_idx FROM commits GROUP BY commit_idx HAVING count(*) BETWEEN 2 AND 15), k AS (SELECT * FROM commits SEMI JOIN s USING (commit_idx)), n AS (SELECT path, count(*) AS n FROM k GROUP BY path),
p AS (SELECT a.path AS src, b.path AS dst, count(*) AS shared FROM k a JOIN k b ON a.commit_idx = b.commit_idx AND a.path <> b.path GROUP BY 1, 2), t AS (SELECT src, dst, round(shared / n, 3) AS strength FROM p JOIN n ON n.path = src WHERE shared / n >= 0.08),
h AS (SELECT src FROM t GROUP BY src HAVING count(*) >= greatest(5.0, (SELECT count(*) * 0.9 FROM n))), e AS (SELECT * FROM t WHERE src NOT IN (SELECT src FROM h) AND dst NOT IN (SELECT src FROM h)), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM e) SELECT src, dst, strength, rank FROM r WHERE rank <= 5""")
def learn_cochange(spark, d):
    return L.cochange(view(spark, d, "commits"), least=0.08, hub_share=0.9)


@query("learn_affinity", ctes("prompts") + f", {WORDS} SELECT word, path, round(least(1.0, count(*) * 0.08::DOUBLE), 4) AS affinity FROM w JOIN u USING (turn_id) GROUP BY word, path")
def learn_affinity(spark, d):
    return L.affinity(*turn_words(spark, d))


@query("learn_affinity_decay", ctes("prompts") + f", {WORDS}, a AS (SELECT word, path, round(least(1.0, count(*) * 0.04::DOUBLE), 4) AS affinity FROM w JOIN u USING (turn_id) GROUP BY word, path) SELECT word, path, round(affinity * 0.7::DOUBLE, 4) AS affinity FROM a WHERE affinity * 0.7::DOUBLE >= 0.03")
def learn_affinity_decay(spark, d):
    return L.decayed(L.affinity(*turn_words(spark, d), turns_learned=100), rate=0.7)


@query("learn_word_frequency", ctes("prompts") + f", {WORDS}, t AS (SELECT count(*) AS n FROM prompts) SELECT word, round(count(DISTINCT turn_id) / (SELECT n FROM t), 3) AS frequency FROM w GROUP BY word HAVING count(DISTINCT turn_id) >= 2")
def learn_word_frequency(spark, d):
    words, _ = turn_words(spark, d)
    total = view(spark, d, "prompts").count()
    return L.word_frequency(words, F.lit(total))


@query("learn_rhythm", ctes("accesses") + ", a AS (SELECT DISTINCT path || ':' || project AS path, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS turn FROM accesses), g AS (SELECT path, (max(turn) - min(turn)) / (count(*) - 1) AS gap FROM a GROUP BY path HAVING count(*) >= 3) SELECT path, round(CASE WHEN gap <= 3 THEN 0.88::DOUBLE WHEN gap >= 12 THEN 0.5::DOUBLE ELSE 0.88::DOUBLE + (gap - 3) / 9 * (0.5::DOUBLE - 0.88::DOUBLE) END, 3) AS decay FROM g")
def learn_rhythm(spark, d):
    a = accesses(spark, d).select(F.concat_ws(":", "path", "project").alias("path"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("turn"))
    return L.rhythm(a)


@query("learn_boosted_scores", ctes("prompts") + f""", {WORDS}, a AS (SELECT word, path, round(least(1.0, count(*) * 0.08::DOUBLE), 4) AS affinity FROM w JOIN u USING (turn_id) GROUP BY word, path), f AS (SELECT word, round(count(DISTINCT turn_id) / (SELECT count(*) FROM prompts), 3) AS frequency FROM w GROUP BY word HAVING count(DISTINCT turn_id) >= 2),
q AS (SELECT DISTINCT word FROM w), s AS (SELECT DISTINCT path FROM u), b AS (SELECT path, sum(affinity * CASE WHEN coalesce(frequency, 0) > 0.3 THEN 0.3::DOUBLE / frequency ELSE 1 END * 0.45::DOUBLE) AS add FROM q JOIN a USING (word) LEFT JOIN f USING (word) GROUP BY path)
SELECT path, round(least(1.0, 0.01::DOUBLE + coalesce(add * 0.001::DOUBLE, 0)), 6) AS score FROM s LEFT JOIN b USING (path)""")
def learn_boosted_scores(spark, d):
    words, used = turn_words(spark, d)
    freq = L.word_frequency(words, F.lit(view(spark, d, "prompts").count()))
    prompt = words.select("word").distinct()
    return L.boost(used.select("path").distinct().withColumn("score", F.lit(0.01)), L.affinity(words, used), prompt, freq, weight=0.45 * 0.001)


def ngram_sql(n: int) -> str:
    lags = ", ".join(f"lag(path, {k}) OVER w AS c{k}" for k in range(n - 1, 0, -1))
    ctx = " || ' ' || ".join(f"c{k}" for k in range(n - 1, 0, -1))
    return ctes("accesses") + f", s AS (SELECT path AS next, {lags} FROM accesses WINDOW w AS (PARTITION BY session_id ORDER BY pos)) SELECT {ctx} AS context, next, count(*) AS count FROM s WHERE c{n - 1} IS NOT NULL GROUP BY 1, 2"


@query("learn_bigrams", ngram_sql(2))
def learn_bigrams(spark, d):
    return L.ngrams(accesses(spark, d), "session_id", "pos", "path", 2)


@query("learn_trigrams", ngram_sql(3))
def learn_trigrams(spark, d):
    return L.ngrams(accesses(spark, d), "session_id", "pos", "path", 3)


KC = f"c AS (SELECT word, path, count(*) AS count FROM (SELECT unnest({words_sql('prompt', INGEST)}) AS word, 'doc_' || CAST(length(prompt) % 7 AS VARCHAR) AS path FROM prompts) GROUP BY 1, 2)"


@query("learn_strong_keywords", ctes("prompts") + f", {KC}, r AS (SELECT *, sum(count) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY count DESC, path) AS rank FROM c) SELECT word, path, CAST(total AS BIGINT) AS total FROM r WHERE length(word) >= 4 AND total >= 3 AND rank = 1 AND count / total >= 0.7")
def learn_strong_keywords(spark, d):
    p = view(spark, d, "prompts").select(F.explode(T.keywords(F.col("prompt"))).alias("word"), F.concat(F.lit("doc_"), F.length("prompt") % 7).alias("path"))
    return L.strong_keywords(p.groupBy("word", "path").agg(F.count("*").alias("count")))


@query("learn_project_popularity", ctes("accesses") + ", c AS (SELECT project, path, count(*) AS n FROM accesses GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, path) AS rank FROM c) SELECT project, path, n, rank FROM r WHERE rank <= 20")
def learn_project_popularity(spark, d):
    c = accesses(spark, d).groupBy("project", "path").agg(F.count("*").alias("n"))
    return L.top_n(c, ["project"], [F.desc("n"), F.asc("path")], 20).select("project", "path", "n", "rank")


@query("learn_file_popularity", ctes("accesses") + r", c AS (SELECT path, count(*) AS n, count(DISTINCT project) AS projects FROM accesses GROUP BY path) SELECT regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS stem, string_agg(path, ',' ORDER BY path) AS paths, CAST(sum(n) AS BIGINT) AS n, max(projects) AS projects FROM c GROUP BY 1")
def learn_file_popularity(spark, d):
    c = accesses(spark, d).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("project").alias("projects"))
    return c.groupBy(T.stem(F.col("path")).alias("stem")).agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.sum("n").alias("n"), F.max("projects").alias("projects"))


@query("learn_cooccurrence", ctes("baskets") + ", p AS (SELECT a.path AS a, b.path AS b, count(*) AS shared FROM baskets a JOIN baskets b ON a.turn_id = b.turn_id AND a.path <> b.path GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM p) SELECT a AS path, b AS related, shared, rank FROM r WHERE rank <= 10")
def learn_cooccurrence(spark, d):
    p = L.pairs(baskets(spark, d), ["turn_id"])
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    return L.top_n(both, ["a"], [F.desc("shared"), F.asc("b")], 10).select(F.col("a").alias("path"), F.col("b").alias("related"), "shared", "rank")


@query("learn_usefulness", ctes("turns", "accesses") + """, e AS (SELECT injected AS path, 1 AS i, 0 AS a, 0 AS e FROM turns UNION ALL SELECT used, 0, 1, 0 FROM turns UNION ALL SELECT 'file_' || CAST(k AS VARCHAR), 0, 0, 1 FROM accesses WHERE tool = 'Edit'), s AS (SELECT path, CAST(sum(i) AS BIGINT) AS injected, CAST(sum(a) AS BIGINT) AS accessed, CAST(sum(e) AS BIGINT) AS edited FROM e GROUP BY path)
SELECT *, CASE WHEN injected > 0 THEN least(1.0, round((accessed + 2 * edited) / injected, 2)) ELSE 0 END AS usefulness FROM s""")
def learn_usefulness(spark, d):
    t, a = view(spark, d, "turns"), accesses(spark, d)
    return L.usage_counters(t.select(F.col("injected").alias("path")), t.select(F.col("used").alias("path")), a.where("tool = 'Edit'").select(F.concat(F.lit("file_"), "k").alias("path")))


MERGE = "l AS (SELECT path, round(count(*) / 100.0::DOUBLE, 3) AS v FROM accesses WHERE tool = 'Edit' AND k % 2 = 0 GROUP BY path), r AS (SELECT path, round(count(*) / 100.0::DOUBLE, 3) AS v FROM accesses WHERE tool = 'Read' AND k % 3 = 0 GROUP BY path)"
RULES = {
    "max": "greatest(coalesce(l.v, 0), coalesce(r.v, 0))",
    "avg": "CASE WHEN r.v IS NULL THEN l.v ELSE (coalesce(l.v, 0) + r.v) / 2 END",
    "prefer": "coalesce(l.v, r.v)",
    "add": "coalesce(l.v, 0) + coalesce(r.v, 0)",
    "weighted": "CASE WHEN l.v IS NULL THEN r.v WHEN r.v IS NULL THEN l.v ELSE (2 * l.v + r.v) / 3 END",
}


def _merge(how: str):
    @query(f"learn_merge_{how}", ctes("accesses") + f", {MERGE} SELECT coalesce(l.path, r.path) AS path, round({RULES[how]}, 9) AS v FROM l FULL JOIN r ON l.path = r.path")
    def merge(spark, d):
        a = accesses(spark, d)
        side = lambda tool, k: a.where(f"tool = '{tool}' AND k % {k} = 0").groupBy("path").agg(F.round(F.count("*") / 100.0, 3).alias("v"))
        return L.merged(side("Edit", 2), side("Read", 3), ["path"], "v", how)


for _how in RULES:
    _merge(_how)


@query("learn_maturity", ctes("turns") + " SELECT project, count(*) AS turns, CASE WHEN count(*) < 25 THEN 'observing' ELSE 'active' END AS maturity, CASE WHEN count(*) < 25 THEN 0.0::DOUBLE ELSE 0.45::DOUBLE END AS boost FROM turns WHERE injection_chars > 2000 GROUP BY project")
def learn_maturity(spark, d):
    n = view(spark, d, "turns").where("injection_chars > 2000").groupBy("project").agg(F.count("*").alias("turns"))
    return n.select("project", "turns", L.maturity(F.col("turns")).alias("maturity"), L.maturity_boost(F.col("turns")).alias("boost"))


@query("learn_predictions_by_sequence", ctes("accesses") + """, s AS (SELECT pos, session_id, project, path, lag(path, 1) OVER w AS c1, lag(path, 2) OVER w AS c2 FROM accesses WINDOW w AS (PARTITION BY user_id ORDER BY pos)), b AS (SELECT c1, path, count(*) AS n FROM s WHERE c1 IS NOT NULL GROUP BY 1, 2), br AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY n DESC, path) AS r FROM b),
g AS (SELECT pos AS turn_id, br.path, least(8.0::DOUBLE, n * 0.6::DOUBLE) AS points, n >= 3 AND r = 1 AS sure FROM s JOIN br ON s.c1 = br.c1 WHERE r <= 5 AND n >= 2 UNION ALL SELECT pos, c1, 6.0, false FROM s WHERE c1 IS NOT NULL UNION ALL SELECT pos, c2, 3.0, false FROM s WHERE c2 IS NOT NULL),
t AS (SELECT turn_id, path, round(sum(points), 6) AS score, max(CAST(sure AS INT)) AS c FROM g GROUP BY 1, 2), k AS (SELECT *, max(score) OVER (PARTITION BY turn_id) AS top, max(c) OVER (PARTITION BY turn_id) AS s, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, path) AS rank FROM t)
SELECT turn_id, path, score, rank FROM k WHERE CASE WHEN s = 1 THEN rank <= 3 AND score >= top * 0.4::DOUBLE ELSE rank <= 2 END""")
def learn_predictions_by_sequence(spark, d):
    """Signals of what follows the last file and of the two last files themselves."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("pos")
    s = accesses(spark, d).select(F.col("pos").alias("turn_id"), "path", F.lag("path", 1).over(w).alias("c1"), F.lag("path", 2).over(w).alias("c2"))
    s = written(s, "turns")  # counted first, then predicted
    follow = P.firsts(s.where("c1 IS NOT NULL").groupBy("c1", "path").agg(F.count("*").alias("n")), ["c1"], P.FOLLOWS, "follows")
    recent = F.array(P.candidate(F.col("c1"), 6.0, False), P.candidate(F.col("c2"), 3.0, False)).cast(P.CANDIDATES)
    t = s.join(follow, "c1", "left").select("turn_id", F.lit("").alias("project"), F.concat(recent, F.coalesce("follows", P.none())).alias("candidates"))
    return P.chosen(t).drop("sure")


SAID = "'please topic' || CAST(k % 23 AS STRING) || CASE k % 6 WHEN 0 THEN ' see mod' || CAST(k % 10 AS STRING) || '/file_' || CAST(k AS STRING) || '.py now' WHEN 1 THEN ' open file_' || CAST(k + 2 AS STRING) || '.md' WHEN 2 THEN ' about rare' || CAST(k AS STRING) ELSE '' END"
MENTION, WORD = r"[\w./-]+\.(?:py|md|ts)", "[a-zA-Z][a-zA-Z0-9_-]{2,}"
PREDICT = f"""tt AS MATERIALIZED (SELECT pos AS turn_id, path, k, user_id, {SAID} AS said FROM accesses),
ctx AS MATERIALIZED (SELECT turn_id, path, said, lag(path, 1) OVER w AS r1, lag(path, 2) OVER w AS r2, lag(path, 3) OVER w AS r3, lag(path, 4) OVER w AS r4, lag(path, 5) OVER w AS r5 FROM tt WINDOW w AS (PARTITION BY user_id ORDER BY turn_id)),
paths AS (SELECT DISTINCT path FROM tt), nm AS (SELECT lower(string_split(path, '/')[-1]) AS key, path FROM paths UNION SELECT regexp_replace(lower(string_split(path, '/')[-1]), '\\.[^.]*$', ''), path FROM paths),
kc AS (SELECT word, path, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(lower(said), '{WORD}')) AS word FROM tt) GROUP BY 1, 2), sk AS (SELECT word, path FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total, row_number() OVER (PARTITION BY word ORDER BY n DESC, path) AS r FROM kc) WHERE length(word) >= 4 AND total >= 3 AND r = 1 AND n / total >= 0.7),
f1 AS (SELECT *, row_number() OVER (PARTITION BY r1 ORDER BY n DESC, path) AS r FROM (SELECT r1, path, count(*) AS n FROM ctx WHERE r1 IS NOT NULL GROUP BY 1, 2)), f2 AS (SELECT *, row_number() OVER (PARTITION BY r2, r1 ORDER BY n DESC, path) AS r FROM (SELECT r2, r1, path, count(*) AS n FROM ctx WHERE r2 IS NOT NULL GROUP BY 1, 2, 3)),
us AS (SELECT DISTINCT user_id, path FROM tt), co AS (SELECT *, row_number() OVER (PARTITION BY used ORDER BY n DESC, path) AS r FROM (SELECT a.path AS used, b.path AS path, count(*) AS n FROM us a JOIN us b ON a.user_id = b.user_id AND a.path <> b.path GROUP BY 1, 2)),
pop AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, path) AS r FROM (SELECT string_split(path, '/')[1] AS project, path, count(*) AS n FROM tt GROUP BY 1, 2)),
rc AS (SELECT turn_id, r1 AS path, 1 AS i FROM ctx UNION ALL SELECT turn_id, r2, 2 FROM ctx UNION ALL SELECT turn_id, r3, 3 FROM ctx UNION ALL SELECT turn_id, r4, 4 FROM ctx UNION ALL SELECT turn_id, r5, 5 FROM ctx),
mt AS (SELECT turn_id, unnest(list_distinct(regexp_extract_all(said, '{MENTION}'))) AS m FROM tt),
sg AS (SELECT turn_id, m AS path, 25.0::DOUBLE AS points, TRUE AS sure FROM mt WHERE contains(m, '/') UNION ALL SELECT turn_id, path, 15.0, TRUE FROM mt JOIN nm ON key = regexp_replace(lower(string_split(m, '/')[-1]), '\\.[^.]*$', '') UNION ALL SELECT turn_id, path, 18.0, TRUE FROM mt JOIN nm ON key = lower(string_split(m, '/')[-1]) UNION ALL SELECT turn_id, NULL, 0.0, TRUE FROM mt
  UNION ALL SELECT turn_id, sk.path, 10.0, TRUE FROM (SELECT DISTINCT turn_id, unnest(regexp_extract_all(lower(said), '{WORD}')) AS word FROM tt) JOIN sk USING (word)
  UNION ALL SELECT turn_id, f1.path, least(8.0::DOUBLE, n * 0.6::DOUBLE), r = 1 AND n >= 3 FROM ctx JOIN f1 ON ctx.r1 = f1.r1 WHERE r <= 5 AND n >= 2
  UNION ALL SELECT turn_id, f2.path, least(10.0::DOUBLE, n * 1.0::DOUBLE), r = 1 AND n >= 2 FROM ctx JOIN f2 ON ctx.r1 = f2.r1 AND ctx.r2 = f2.r2 WHERE r <= 3
  UNION ALL SELECT turn_id, path, 6.0::DOUBLE / i, FALSE FROM rc WHERE path IS NOT NULL
  UNION ALL SELECT turn_id, co.path, least(4.0::DOUBLE, n * 0.4::DOUBLE), FALSE FROM rc JOIN co ON rc.path = co.used WHERE i <= 3 AND r <= 5 AND n >= 2),
sr AS (SELECT turn_id, max(sure) AS sure FROM sg GROUP BY 1), pj AS (SELECT turn_id, string_split(r1, '/')[1] AS project FROM ctx),
al AS (SELECT * FROM sg UNION ALL SELECT pj.turn_id, pop.path, 3.0::DOUBLE / r, FALSE FROM pj JOIN pop USING (project) LEFT JOIN sr ON sr.turn_id = pj.turn_id WHERE r <= 5 AND NOT coalesce(sure, FALSE)),
sc AS (SELECT turn_id, path, round(sum(points) * any_value(CASE WHEN project IS NULL OR string_split(path, '/')[1] = project THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END), 6) AS score FROM al JOIN pj USING (turn_id) WHERE path IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT sc.*, coalesce(sure, FALSE) AS sure, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, path) AS rank, max(score) OVER (PARTITION BY turn_id) AS top FROM sc LEFT JOIN sr USING (turn_id))"""


@query("learn_predictions", ctes("accesses") + f", {PREDICT} SELECT turn_id, path, score, sure, rank FROM rk WHERE CASE WHEN sure THEN rank <= 3 AND score >= top * 0.4::DOUBLE ELSE rank <= 2 END")
def learn_predictions(spark, d):
    """The files of each access predicted from what was said and done before it, by all seven signals."""
    from pyspark.sql import Window

    a = accesses(spark, d).select(F.col("pos").alias("turn_id"), "path", "user_id", F.expr(SAID).alias("said"))
    w = Window.partitionBy("user_id").orderBy("turn_id")
    words = F.regexp_extract_all(F.lower("said"), F.lit(WORD), F.lit(0))
    turns = a.select("turn_id", "path", "user_id", F.regexp_extract_all("said", F.lit(MENTION), F.lit(0)).alias("mentions"), words.alias("words"), F.collect_list("path").over(w.rowsBetween(-5, -1)).alias("recent"))
    turns = written(turns, "turns")  # read for each signal
    last, before = F.try_element_at("recent", F.lit(-1)), F.try_element_at("recent", F.lit(-2))
    seen = turns.select("path", last.alias("last"), before.alias("before"))
    follows = seen.where("last IS NOT NULL").groupBy("last", "path").agg(F.count("*").alias("n"))
    follows_two = seen.where("before IS NOT NULL").groupBy("before", "last", "path").agg(F.count("*").alias("n"))
    strong = L.strong_keywords(turns.select("path", F.explode("words").alias("word")).groupBy("word", "path").agg(F.count("*").alias("count")))
    pairs = L.pairs(turns.select(F.col("user_id").alias("turn_id"), "path").distinct(), ["turn_id"]).withColumnRenamed("shared", "n")
    pairs = written(pairs, "pairs")  # each pair is read from both sides
    together = pairs.select(F.col("a").alias("path"), F.col("b").alias("related"), "n").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("related"), "n"))
    popular = L.top_n(turns.groupBy(P.project_of(F.col("path")).alias("project"), "path").agg(F.count("*").alias("n")), ["project"], [F.desc("n"), F.asc("path")], 20)
    return P.predict(turns, P.names_of(turns), strong, follows, follows_two, together, popular)
