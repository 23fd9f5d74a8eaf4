"""Queries of retrieval, ranking and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budgets as B
from ..operators import retrieval as R
from ..operators import stored_index as I
from ..sources.shared import shared_dir, written
from .registry import query
from .source import FINGERPRINT
from .views import ctes, view

TFIDF = "i AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM dfs, tot), w AS (SELECT doc, term, tf * idf AS w FROM post JOIN i USING (term)), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc), qw AS (SELECT q, term, idf AS qw FROM qs JOIN i USING (term)), qn AS (SELECT q, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY q), sc AS (SELECT q, doc, round(sum(qw * w) / (any_value(norm) * any_value(qn)), 6) AS score FROM qw JOIN w USING (term) JOIN nm USING (doc) JOIN qn USING (q) GROUP BY q, doc)"
TOK = "regexp_extract_all(lower(content), '[a-z][a-z0-9_]{2,}')"
POST = f"post AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({TOK}) AS term FROM corpus) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), dls AS (SELECT doc, sum(tf) AS dl FROM post GROUP BY doc), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls)"
# queries: the different words of the first lines of a few documents
QS = "qs AS (SELECT DISTINCT doc_id AS q, unnest(regexp_extract_all(lower(string_split(content, chr(10))[1]), '[a-z][a-z0-9_]{2,}')) AS term FROM corpus WHERE doc_id % 100 = 0)"
BM = "sc AS (SELECT q, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qs JOIN post USING (term) JOIN dfs USING (term) JOIN dls USING (doc), tot GROUP BY q, doc)"


def rank_sql(src: str, k: int) -> str:
    return f"SELECT q, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM {src}) WHERE rank <= {k}"


def corpus(spark, d):
    return view(spark, d, "corpus")


def queries_of(c):
    return c.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"), F.explode(T.index_tokens(F.element_at(F.split("content", "\n"), 1))).alias("term")).distinct()


@query("retrieval_postings", ctes("corpus") + f", {POST} SELECT doc, term, tf FROM post")
def retrieval_postings(spark, d):
    return R.postings(corpus(spark, d))


@query("retrieval_bm25", ctes("corpus") + f", {POST}, {QS}, {BM} {rank_sql('sc', 20)}")
def retrieval_bm25(spark, d):
    c = corpus(spark, d)
    return R.bm25(written(R.postings(c), "postings"), queries_of(c), 20)


@query("retrieval_tfidf", ctes("corpus") + f""", {POST}, {QS}, i AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM dfs, tot), w AS (SELECT doc, term, tf * idf AS w FROM post JOIN i USING (term)), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc), qw AS (SELECT q, term, idf AS qw FROM qs JOIN i USING (term)), qn AS (SELECT q, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY q),
sc AS (SELECT q, doc, round(sum(qw * w) / (any_value(norm) * any_value(qn)), 6) AS score FROM qw JOIN w USING (term) JOIN nm USING (doc) JOIN qn USING (q) GROUP BY q, doc) {rank_sql('sc', 10)}""")
def retrieval_tfidf(spark, d):
    c = corpus(spark, d)
    return R.tfidf(written(R.postings(c), "postings"), queries_of(c), 10)


def stored(c):
    """An index that was built of an older corpus (some documents unknown, some with other words), then brought up to all of it; its path."""
    path = f"{shared_dir(c.sparkSession)}/indexes/{uuid.uuid4().hex}"
    old = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("outdated words "), "path")).otherwise(F.col("content"))
    older = c.withColumn("content", old).withColumn("mtime", F.lit(1)).where("doc_id % 11 <> 0")
    I.update(c.sparkSession, path, older)
    I.update(c.sparkSession, path, c.withColumn("mtime", F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1)))
    return path


@query("retrieval_stored_bm25", ctes("corpus") + f", {POST}, {QS}, {BM} {rank_sql('sc', 20)}")
def retrieval_stored_bm25(spark, d):
    """Search of a stored index after an update; every document is in it."""
    c = corpus(spark, d)
    return I.bm25(spark, stored(c), queries_of(c), 20)


@query("retrieval_stored_tfidf", ctes("corpus") + f", {POST}, {QS}, {TFIDF} {rank_sql('sc', 10)}")
def retrieval_stored_tfidf(spark, d):
    c = corpus(spark, d)
    return I.tfidf(spark, stored(c), queries_of(c), 10)


@query("retrieval_stored_status", ctes("corpus") + f", t AS (SELECT doc_type, len({TOK}) AS dl FROM corpus) SELECT doc_type, count(*) AS n, CAST(sum(dl) AS BIGINT) AS tokens FROM t GROUP BY doc_type")
def retrieval_stored_status(spark, d):
    """The state of a stored index after an update and a merge of all its segments."""
    path = stored(corpus(spark, d))
    I.merge(spark, path, 1 << 60)
    return I.status(spark, path)


@query("retrieval_weighted_postings", ctes("corpus") + f""", p AS (SELECT doc_id AS doc, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem, list_filter(regexp_split_to_array(lower(path), '[/\\\\._-]'), lambda x: length(x) >= 2) AS parts FROM corpus), a AS (SELECT doc, unnest(CASE WHEN list_contains(parts, stem) THEN parts ELSE list_append(parts, stem) END) AS term, 5 AS w FROM p UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower({FINGERPRINT}), '[a-z][a-z0-9_]{{2,}}')), 3 FROM corpus UNION ALL SELECT doc_id, unnest({TOK}), 1 FROM corpus)
SELECT doc, term, CAST(sum(w) AS BIGINT) AS tf FROM a GROUP BY doc, term""")
def retrieval_weighted_postings(spark, d):
    return R.weighted_postings(corpus(spark, d))


EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query("retrieval_reranked", ctes("corpus") + f", {POST}, {QS}, {BM}, c AS (SELECT * FROM ({rank_sql('sc', 20)})), {EMB}, f AS (SELECT q, doc, round(0.6::DOUBLE * score / CASE WHEN max(score) OVER (PARTITION BY q) > 0 THEN max(score) OVER (PARTITION BY q) ELSE 1 END + 0.4::DOUBLE * coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS score FROM c LEFT JOIN e a ON a.vec_id = doc JOIN e b ON b.vec_id = q) {rank_sql('f', 10)}")
def retrieval_reranked(spark, d):
    c = corpus(spark, d)
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = R.bm25(written(R.postings(c), "postings"), queries_of(c), 20).select("q", "doc", "score")
    return R.reranked(found, e.withColumnRenamed("vec_id", "doc"), e.select(F.col("vec_id").alias("q"), F.col("v").alias("qv")), 10)


@query("retrieval_cosine", f"WITH {EMB} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def retrieval_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("w"))
    return e.withColumnRenamed("vec_id", "a").join(b, "a").select("a", "b", F.round(R.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("retrieval_index_status", ctes("corpus") + " SELECT doc_type, count(*) AS n FROM corpus GROUP BY doc_type")
def retrieval_index_status(spark, d):
    return corpus(spark, d).groupBy("doc_type").agg(F.count("*").alias("n"))


@query("retrieval_phrase_search", ctes("observations") + " SELECT id FROM observations WHERE contains(lower(summary), ' of the ') ORDER BY id DESC LIMIT 20")
def retrieval_phrase_search(spark, d):
    return view(spark, d, "observations").where(F.contains(F.lower("summary"), F.lit(" of the "))).orderBy(F.desc("id")).limit(20).select("id")


@query("retrieval_like_search", ctes("observations") + " SELECT id, kind FROM observations WHERE summary LIKE '%tion%' OR kind LIKE 'f%' ORDER BY ts DESC, id LIMIT 50")
def retrieval_like_search(spark, d):
    return view(spark, d, "observations").where("summary LIKE '%tion%' OR kind LIKE 'f%'").orderBy(F.desc("ts"), "id").limit(50).select("id", "kind")


@query("budget_stop", ctes("observations") + ", r AS (SELECT id, session_id, sum(tokens) OVER (PARTITION BY session_id ORDER BY ts DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM observations) SELECT session_id, id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 20000")
def budget_stop(spark, d):
    """Observations of a session, newest first, up to the first that exceeds the budget."""
    return R.stop_at_budget(view(spark, d, "observations"), ["session_id"], [F.desc("ts"), F.asc("id")], F.col("tokens"), 20_000).select("session_id", "id", "used")


@query("budget_fill", ctes("observations") + """, o AS (SELECT session_id, id, tokens, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM observations), m AS (SELECT max(n) AS m FROM o),
s AS (SELECT session_id, list(id ORDER BY id) AS ids, list(tokens ORDER BY id) AS t FROM o GROUP BY session_id), f AS (SELECT session_id, ids, list_reduce(list_prepend({'left': 20000::BIGINT, 'k': []::BIGINT[]}, list_transform(range(1, len(ids) + 1), lambda i: {'left': t[i], 'k': [ids[i]]})), lambda a, x: CASE WHEN x.left <= a.left THEN {'left': a.left - x.left, 'k': list_concat(a.k, x.k)} ELSE a END) AS r FROM s)
SELECT session_id, unnest(r.k) AS id FROM f""")
def budget_fill(spark, d):
    """Observations of a session in order that fit what is left of the budget."""
    return B.fill(view(spark, d, "observations").select("session_id", "id", "tokens"), ["session_id"], ["id"], "tokens", 20_000).where("kept").select("session_id", "id")


@query("budget_diverse", ctes("accesses") + ", s AS (SELECT project, path, string_split(path, '/')[1] AS dir, round(count(*) / 100.0::DOUBLE, 3) AS score FROM accesses GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY project, dir ORDER BY score DESC, path) AS sib FROM s), v AS (SELECT *, round(0.7::DOUBLE * score - 0.045::DOUBLE * (sib - 1), 9) AS value FROM b WHERE sib <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY value DESC, path) AS rank FROM v) SELECT project, path, value, rank FROM r WHERE rank <= 8")
def budget_diverse(spark, d):
    s = view(spark, d, "accesses").groupBy("project", "path").agg(F.round(F.count("*") / 100.0, 3).alias("score")).withColumn("dir", F.element_at(F.split("path", "/"), 1))
    return B.diverse(s, ["project"], 8).select("project", "path", "value", "rank")


# greedy steps over all users at once: the next of those that are left, by full directories, value and place
GREEDY = """c AS MATERIALIZED (SELECT user_id, path, dir, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, path) AS ix, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, path, regexp_extract(path, '[^.]*$') AS dir, round(sum(k) / 100.0::DOUBLE, 3) AS score FROM accesses GROUP BY 1, 2)),
g(user_id, step, taken, dirs, ix, value, fallback) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::VARCHAR[], 0::BIGINT, NULL::DOUBLE, FALSE FROM c WHERE n > 12
  UNION ALL SELECT user_id, step + 1, list_append(taken, b.ix), list_append(dirs, b.dir), b.ix, b.value, b.late FROM (
    SELECT g.user_id, step, any_value(taken) AS taken, any_value(dirs) AS dirs, arg_min({'ix': c.ix, 'dir': c.dir, 'value': CASE WHEN len(list_filter(dirs, lambda d: d = c.dir)) < 3 THEN round(0.7::DOUBLE * score - 0.045::DOUBLE * len(list_filter(dirs, lambda d: d = c.dir)), 9) END, 'late': len(list_filter(dirs, lambda d: d = c.dir)) >= 3},
      (CASE WHEN len(list_filter(dirs, lambda d: d = c.dir)) >= 3 THEN 1 ELSE 0 END, CASE WHEN len(list_filter(dirs, lambda d: d = c.dir)) >= 3 THEN 0 ELSE -round(0.7::DOUBLE * score - 0.045::DOUBLE * len(list_filter(dirs, lambda d: d = c.dir)), 9) END, c.ix)) AS b
    FROM g JOIN c ON g.user_id = c.user_id AND NOT list_contains(taken, c.ix) WHERE step < 12 GROUP BY g.user_id, step))"""


@query("budget_diverse_greedy", ctes("accesses").replace("WITH ", "WITH RECURSIVE ", 1) + f", {GREEDY} SELECT g.user_id, path, g.value, fallback, CAST(step AS INTEGER) AS rank FROM g JOIN c ON g.user_id = c.user_id AND g.ix = c.ix WHERE step > 0 UNION ALL SELECT user_id, path, NULL, FALSE, CAST(ix AS INTEGER) FROM c WHERE n <= 12")
def budget_diverse_greedy(spark, d):
    """Twelve files of each user over three kinds of files: nine by greedy steps, then the rest in order; short lists whole."""
    s = view(spark, d, "accesses").groupBy("user_id", "path").agg(F.round(F.sum("k") / 100.0, 3).alias("score")).withColumn("dir", F.regexp_extract("path", "[^.]*$", 0))
    return B.diverse(s, ["user_id"], 12).select("user_id", "path", "value", "fallback", "rank")


LINES = "ln AS (SELECT session_id, id, CASE WHEN id % 9 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 ELSE 2 END AS priority, tokens AS size, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN id % 9 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 ELSE 2 END, ts DESC, id) AS n FROM observations)"


def lines(spark, d):
    return view(spark, d, "observations").selectExpr("session_id", "id", "ts", "CASE WHEN id % 9 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 ELSE 2 END AS priority", "tokens AS size")


@query("budget_handback", ctes("observations").replace("WITH ", "WITH RECURSIVE ", 1) + f", {LINES}, f(session_id, n, rest, id, kept) AS (SELECT DISTINCT session_id, 0::BIGINT, 14900::BIGINT, NULL::BIGINT, FALSE FROM ln UNION ALL SELECT f.session_id, l.n, CASE WHEN size <= rest THEN rest - size ELSE rest END, l.id, size <= rest FROM f JOIN ln l ON l.session_id = f.session_id AND l.n = f.n + 1) SELECT session_id, id, rest AS \"left\", dropped FROM f JOIN (SELECT session_id, count(*) FILTER (NOT kept AND n > 0) AS dropped FROM f GROUP BY 1) USING (session_id) WHERE kept")
def budget_handback(spark, d):
    """Lines of a session by priority, newest first, that fit 15,000 less a reserve of 100 for the notice, with the number of those that did not."""
    return B.handback(lines(spark, d), ["session_id"], ["priority", F.desc("ts"), "id"], "size", 15_000, 100).select("session_id", "id", "left", "dropped")


@query("budget_context", ctes("observations").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {LINES.replace("tokens AS size", "CASE WHEN id % 9 = 0 OR id % 4 = 0 THEN tokens ELSE tokens // 20 END AS size").replace("CASE WHEN id % 9 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 ELSE 2 END", "CASE WHEN id % 9 = 0 OR id % 4 = 0 THEN 0 ELSE 1 END")}, f(session_id, n, rest, id, priority, open, kept) AS (SELECT DISTINCT session_id, 0::BIGINT, 9000::BIGINT, NULL::BIGINT, -1, TRUE, FALSE FROM ln
  UNION ALL SELECT session_id, ln, CASE WHEN o AND size < rest THEN rest - size ELSE rest END, lid, lp, o, o AND size < rest FROM (SELECT f.session_id, f.rest, l.n AS ln, l.id AS lid, l.priority AS lp, l.size, CASE WHEN l.priority <> f.priority AND f.priority >= 0 THEN rest > 100 ELSE open END AS o FROM f JOIN ln l ON l.session_id = f.session_id AND l.n = f.n + 1) x) SELECT session_id, id, rest AS "left" FROM f WHERE kept""")
def budget_context(spark, d):
    """Whole files of a session that fit a budget, then brief lines on the others in what is left, if that is over a hundred."""
    own = lines(spark, d).selectExpr("session_id", "id", "ts", "CASE WHEN id % 9 = 0 OR id % 4 = 0 THEN 0 ELSE 1 END AS phase", "CASE WHEN id % 9 = 0 OR id % 4 = 0 THEN size ELSE size DIV 20 END AS size")
    return B.fill(own, ["session_id"], [F.desc("ts"), "id"], "size", 9000, strict=True, phase="phase", least_left=100).where("kept").select("session_id", "id", "left")


@query("observation_recent", ctes("observations") + " SELECT id, session_id, ts FROM observations ORDER BY ts DESC, id LIMIT 10")
def observation_recent(spark, d):
    return view(spark, d, "observations").orderBy(F.desc("ts"), "id").limit(10).select("id", "session_id", "ts")


@query("observation_before", ctes("observations") + " SELECT id, ts FROM observations WHERE ts < 500 ORDER BY ts DESC LIMIT 5")
def observation_before(spark, d):
    return view(spark, d, "observations").where("ts < 500").orderBy(F.desc("ts")).limit(5).select("id", "ts")


@query("observation_after", ctes("observations") + " SELECT id, ts FROM observations WHERE ts > 500 ORDER BY ts LIMIT 5")
def observation_after(spark, d):
    return view(spark, d, "observations").where("ts > 500").orderBy("ts").limit(5).select("id", "ts")


@query("observation_session", ctes("observations") + " SELECT id, ts, array_to_string(string_split(summary, chr(10))[1:5], '|') AS facts FROM observations WHERE session_id = 'src1'")
def observation_session(spark, d):
    return view(spark, d, "observations").where("session_id = 'src1'").select("id", "ts", F.array_join(F.slice(F.split("summary", "\n"), 1, 5), "|").alias("facts"))


@query("observation_stats", ctes("observations") + " SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, count(DISTINCT session_id) AS sessions, round(sum(least(tokens, 500)) / sum(tokens), 6) AS ratio FROM observations")
def observation_stats(spark, d):
    o = view(spark, d, "observations")
    return o.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.count_distinct("session_id").alias("sessions"), F.round(F.sum(F.least("tokens", F.lit(500))) / F.sum("tokens"), 6).alias("ratio"))


@query("observation_gate", ctes("observations") + " SELECT id FROM observations WHERE tokens >= 500 AND substr(sha256(summary), 1, 16) NOT IN (SELECT substr(sha256(summary), 1, 16) FROM observations WHERE id % 5 = 0)")
def observation_gate(spark, d):
    """Texts worth compressing: at least 500 tokens, not seen before."""
    from ..operators.joins import unseen

    o = view(spark, d, "observations").withColumn("h", F.substring(F.sha2("summary", 256), 1, 16))
    return unseen(o.where("tokens >= 500"), o.where("id % 5 = 0"), "h").select("id")
