"""Queries of joins, sets and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import joins as J
from ..operators import needles as N
from .registry import query
from .views import ctes, view


def accesses(spark, d):
    return view(spark, d, "accesses")


def edges(spark, d):
    return view(spark, d, "edges")


CONV = "u AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS id, conv_id FROM conversations WHERE role = 'user'), r AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn - 1 AS VARCHAR) AS tool_use_id, length(text) AS chars FROM conversations WHERE role = 'assistant')"


def calls(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    uses = c.where("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id")
    results = c.where("role = 'assistant'").select(F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("tool_use_id"), F.length("text").alias("chars"))
    return uses, results


@query("join_calls_with_results", f"WITH {CONV} SELECT id, CAST(coalesce((SELECT sum(chars) FROM r WHERE tool_use_id = id), 0) AS BIGINT) AS result_chars FROM u")
def join_calls_with_results(spark, d):
    return J.calls_with_results(*calls(spark, d)).select("id", F.col("result_chars").cast("long").alias("result_chars"))


@query("join_result_tokens", f"WITH {CONV}, j AS (SELECT conv_id, coalesce((SELECT sum(chars) FROM r WHERE tool_use_id = id), 0) AS c FROM u) SELECT conv_id, count(*) AS calls, CAST(sum(CAST(trunc(c / 3.3::DOUBLE) AS BIGINT)) AS BIGINT) AS tokens FROM j GROUP BY conv_id")
def join_result_tokens(spark, d):
    from ..functions.text import tokens_from_chars

    return J.calls_with_results(*calls(spark, d)).groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum(tokens_from_chars(F.col("result_chars"))).alias("tokens"))


@query("join_read_cost", ctes("accesses") + """, rd AS (SELECT DISTINCT user_id AS turn_id, k FROM accesses WHERE tool = 'Read'), ds AS (SELECT DISTINCT k, k % 5 AS doc FROM accesses WHERE k % 4 <> 0), inj AS (SELECT DISTINCT user_id AS turn_id, k % 5 AS doc FROM accesses WHERE tool = 'Bash' AND k % 2 = 0), ed AS (SELECT DISTINCT user_id AS turn_id, k FROM accesses WHERE tool = 'Edit'),
p AS (SELECT rd.turn_id, rd.k, count(ds.doc) AS docs, max(CASE WHEN inj.doc IS NOT NULL THEN 1 ELSE 0 END) AS i FROM rd LEFT JOIN ds ON rd.k = ds.k LEFT JOIN inj ON inj.turn_id = rd.turn_id AND inj.doc = ds.doc GROUP BY 1, 2)
SELECT p.turn_id, p.k AS path, CASE WHEN docs = 0 THEN 'corpus_gap' WHEN i = 0 THEN 'routing_miss' WHEN ed.k IS NULL THEN 'read_after_inject' ELSE 'edited' END AS kind FROM p LEFT JOIN ed ON ed.turn_id = p.turn_id AND ed.k = p.k""")
def join_read_cost(spark, d):
    a = accesses(spark, d)
    pick = lambda where, *cols: a.where(where).select(*cols).distinct()
    t, p = F.col("user_id").alias("turn_id"), F.col("k").alias("path")
    return J.read_cost(pick("tool = 'Read'", t, p), pick("k % 4 <> 0", (F.col("k") % 5).alias("doc"), p), pick("tool = 'Bash' AND k % 2 = 0", t, (F.col("k") % 5).alias("doc")), pick("tool = 'Edit'", t, p))


@query("join_describing_docs", ctes("accesses") + ", p AS (SELECT DISTINCT path FROM accesses), ds AS (SELECT DISTINCT k % 5 AS doc, CASE WHEN k % 4 = 1 THEN 'File_' || CAST(k AS VARCHAR) || '.py' ELSE 'mod' || CAST(k % 10 AS VARCHAR) || '/file_' || CAST(k AS VARCHAR) END AS described FROM accesses WHERE k % 4 <> 0) SELECT DISTINCT path, doc FROM p JOIN ds ON contains(lower(path), lower(described))")
def join_describing_docs(spark, d):
    return J.describing_docs(accesses(spark, d), described(spark, d))


def described(spark, d):
    return accesses(spark, d).where("k % 4 <> 0").selectExpr("k % 5 AS doc", "CASE WHEN k % 4 = 1 THEN 'File_' || k || '.py' ELSE 'mod' || (k % 10) || '/file_' || k END AS described").distinct()


@query("join_read_cost_by_containment", ctes("accesses") + """, rd AS (SELECT DISTINCT user_id AS turn_id, path FROM accesses WHERE tool = 'Read'), df AS (SELECT DISTINCT k % 5 AS doc, CASE WHEN k % 4 = 1 THEN 'File_' || CAST(k AS VARCHAR) || '.py' ELSE 'mod' || CAST(k % 10 AS VARCHAR) || '/file_' || CAST(k AS VARCHAR) END AS described FROM accesses WHERE k % 4 <> 0), pt AS (SELECT DISTINCT path FROM rd), ds AS (SELECT DISTINCT path, doc FROM pt JOIN df ON contains(lower(path), lower(described))), inj AS (SELECT DISTINCT user_id AS turn_id, k % 5 AS doc FROM accesses WHERE tool = 'Bash' AND k % 2 = 0), ed AS (SELECT DISTINCT user_id AS turn_id, path FROM accesses WHERE tool = 'Edit'),
p AS (SELECT rd.turn_id, rd.path, count(ds.doc) AS docs, max(CASE WHEN inj.doc IS NOT NULL THEN 1 ELSE 0 END) AS i FROM rd LEFT JOIN ds ON rd.path = ds.path LEFT JOIN inj ON inj.turn_id = rd.turn_id AND inj.doc = ds.doc GROUP BY 1, 2)
SELECT p.turn_id, p.path, CASE WHEN docs = 0 THEN 'corpus_gap' WHEN i = 0 THEN 'routing_miss' WHEN ed.path IS NULL THEN 'read_after_inject' ELSE 'edited' END AS kind FROM p LEFT JOIN ed ON ed.turn_id = p.turn_id AND ed.path = p.path""")
def join_read_cost_by_containment(spark, d):
    a = accesses(spark, d)
    pick = lambda where, *cols: a.where(where).select(*cols).distinct()
    t, reads = F.col("user_id").alias("turn_id"), a.where("tool = 'Read'").selectExpr("user_id AS turn_id", "path").distinct()
    return J.read_cost(reads, J.describing_docs(reads, described(spark, d)), pick("tool = 'Bash' AND k % 2 = 0", t, (F.col("k") % 5).alias("doc")), pick("tool = 'Edit'", t, "path"))


@query("join_inferred_usage", ctes("accesses") + ", c AS (SELECT DISTINCT user_id AS turn_id, CASE WHEN tool = 'Bash' THEN '' ELSE path END AS target, CASE WHEN tool = 'Bash' THEN 'Find Key' || CAST(k % 30 AS VARCHAR) || ' now' END AS pattern FROM accesses), ds AS (SELECT DISTINCT k % 5 AS doc, CASE WHEN k % 4 = 1 THEN 'File_' || CAST(k AS VARCHAR) || '.py' ELSE 'mod' || CAST(k % 10 AS VARCHAR) || '/file_' || CAST(k AS VARCHAR) END AS described FROM accesses WHERE k % 4 <> 0), kw AS (SELECT DISTINCT 100 + k AS doc, 'key' || CAST(k AS VARCHAR) AS keyword FROM accesses WHERE k < 12) SELECT DISTINCT turn_id, doc FROM c JOIN ds ON contains(lower(target), lower(described)) UNION SELECT turn_id, doc FROM c JOIN kw ON contains(lower(pattern), keyword)")
def join_inferred_usage(spark, d):
    a = accesses(spark, d)
    c = a.selectExpr("user_id AS turn_id", "CASE WHEN tool = 'Bash' THEN '' ELSE path END AS target", "CASE WHEN tool = 'Bash' THEN 'Find Key' || (k % 30) || ' now' END AS pattern").distinct()
    return J.inferred_usage(c, described(spark, d), a.where("k < 12").selectExpr("100 + k AS doc", "'key' || k AS keyword").distinct())


@query("join_used_documents", ctes("accesses") + ", i AS (SELECT DISTINCT user_id AS turn_id, 'docs/Mod' || CAST(k % 20 AS VARCHAR) || '-a_xyz.md' AS doc FROM accesses WHERE k % 2 = 0), t AS (SELECT DISTINCT user_id AS turn_id, lower(path) AS target FROM accesses WHERE tool = 'Read') SELECT DISTINCT i.turn_id, doc FROM i JOIN t ON t.turn_id = i.turn_id AND (contains(target, lower(doc)) OR contains(target, regexp_extract(lower(doc), '(mod[0-9]+)', 1)))")
def join_used_documents(spark, d):
    a = accesses(spark, d)
    return J.used_documents(a.where("k % 2 = 0").selectExpr("user_id AS turn_id", "'docs/Mod' || (k % 20) || '-a_xyz.md' AS doc"), a.where("tool = 'Read'").selectExpr("user_id AS turn_id", "path AS target"))


@query("join_matched_predictions", ctes("accesses").replace("WITH ", "WITH RECURSIVE ", 1) + r""", b AS (SELECT user_id || '-' || CAST(turn % 40 AS VARCHAR) AS id, list(DISTINCT CASE k % 3 WHEN 0 THEN path WHEN 1 THEN 'file_' || CAST(k AS VARCHAR) || '.md' ELSE 'other/file_' || CAST(k AS VARCHAR) || '.ts' END ORDER BY CASE k % 3 WHEN 0 THEN path WHEN 1 THEN 'file_' || CAST(k AS VARCHAR) || '.md' ELSE 'other/file_' || CAST(k AS VARCHAR) || '.ts' END) FILTER (tool <> 'Edit') AS p, list(DISTINCT path ORDER BY path) FILTER (tool <> 'Bash') AS a FROM accesses GROUP BY 1),
w AS (SELECT id, coalesce(p, []::VARCHAR[]) AS p, coalesce(a, []::VARCHAR[]) AS a FROM b), r AS (SELECT id, 0 AS i, p, a, 0 AS hits, []::VARCHAR[] AS taken FROM w UNION ALL SELECT id, i + 1, p, a, hits + CAST(h IS NOT NULL AS INT), CASE WHEN h IS NULL OR list_contains(taken, h) THEN taken ELSE list_append(taken, h) END FROM (SELECT *, CASE WHEN list_contains(a, p[i + 1]) THEN p[i + 1] ELSE coalesce(list_filter(a, lambda y: NOT list_contains(taken, y) AND (ends_with(y, p[i + 1]) OR ends_with(p[i + 1], y)))[1], list_filter(a, lambda y: NOT list_contains(taken, y) AND lower(string_split(y, '/')[-1]) = lower(string_split(p[i + 1], '/')[-1]))[1]) END AS h FROM r WHERE i < len(p)))
SELECT id, hits, CAST(len(taken) AS INT) AS matched FROM r WHERE i = len(p)""")
def join_matched_predictions(spark, d):
    a = accesses(spark, d).withColumn("said", F.expr("CASE k % 3 WHEN 0 THEN path WHEN 1 THEN 'file_' || k || '.md' ELSE 'other/file_' || k || '.ts' END"))
    g = a.groupBy(F.concat_ws("-", "user_id", F.col("turn") % 40).alias("id")).agg(F.collect_set(F.when(F.col("tool") != "Edit", F.col("said"))).alias("p"), F.collect_set(F.when(F.col("tool") != "Bash", F.col("path"))).alias("a"))
    return g.select("id", J.matched_predictions(F.col("p"), F.col("a")).alias("m")).select("id", "m.*")


GLOBS = """g AS (SELECT user_id, pos, CASE WHEN tool = 'Bash' THEN 'Glob' ELSE tool END AS tool, CASE WHEN tool <> 'Bash' THEN path WHEN k % 6 = 0 THEN 'mod' || CAST(k % 10 AS STRING) || '/*' WHEN k % 6 = 1 THEN '*_' || CAST(k AS STRING) || '.??' WHEN k % 6 = 2 THEN 'src/file_' || CAST(k % 9 AS STRING) || '[0-4].*' WHEN k % 6 = 3 THEN '**/file_[!1]?.md' WHEN k % 6 = 4 THEN 'mod[13]/file_*' ELSE 'file_' || CAST(k AS STRING) || '.ts' END AS path FROM accesses)"""


def glob_calls(spark, d):
    a = view(spark, d, "accesses")
    return spark.sql("WITH " + GLOBS.replace("FROM accesses", "FROM {a}") + " SELECT CAST(user_id % 20 AS STRING) AS session_id, pos, tool, path FROM g", a=a)


@query("join_reads_by_glob", ctes("accesses") + f", {GLOBS}, c AS (SELECT CAST(user_id % 20 AS VARCHAR) AS session_id, pos, tool, path FROM g), p AS (SELECT DISTINCT session_id, path FROM c WHERE tool = 'Edit'), s AS (SELECT DISTINCT session_id, path AS pat FROM c WHERE tool = 'Glob') SELECT session_id, path FROM p JOIN (SELECT DISTINCT session_id, path FROM c WHERE tool = 'Read') USING (session_id, path) UNION SELECT session_id, path FROM p JOIN s USING (session_id) WHERE (path GLOB pat) OR ((string_split(path, '/')[-1]) GLOB (string_split(pat, '/')[-1]))")
def join_reads_by_glob(spark, d):
    """Edited files that their session read, by name or by a glob."""
    c = glob_calls(spark, d)
    paths, reads, globs = (c.where(F.col("tool") == t).select("session_id", F.col("path").alias(n)) for t, n in (("Edit", "path"), ("Read", "path"), ("Glob", "glob")))
    return N.read_files(paths, reads, globs, ["session_id"])


@query("monitor_unread_edits", ctes("accesses") + f", {GLOBS}, c AS (SELECT CAST(user_id % 20 AS VARCHAR) AS session_id, pos, tool, path FROM g) SELECT session_id, pos, path FROM c e WHERE tool = 'Edit' AND NOT EXISTS (SELECT 1 FROM c r WHERE r.session_id = e.session_id AND r.pos < e.pos AND (r.tool = 'Read' AND r.path = e.path OR r.tool = 'Glob' AND ((e.path GLOB r.path) OR ((string_split(e.path, '/')[-1]) GLOB (string_split(r.path, '/')[-1])))))")
def monitor_unread_edits(spark, d):
    """Edits of files that neither a read nor a glob of the session covered before."""
    return N.unread_edits(glob_calls(spark, d))


@query("join_references_to_paths", ctes("accesses") + r""", p AS (SELECT DISTINCT path FROM accesses), r AS (SELECT DISTINCT k AS id, CASE k % 3 WHEN 0 THEN 'file_' || CAST(k AS VARCHAR) || '.py' WHEN 1 THEN 'mod' || CAST(k % 10 AS VARCHAR) || '/file_' || CAST(k AS VARCHAR) ELSE 'File_' || CAST(k AS VARCHAR) END AS ref FROM accesses),
n AS (SELECT id, lower(ref) AS ref, regexp_replace(lower(ref), '\.[^./]*$', '') AS stem, string_split(lower(ref), '/')[-1] AS base FROM r), q AS (SELECT path, regexp_replace(path, '\.[^./]*$', '') AS stem, string_split(path, '/')[-1] AS base FROM p)
SELECT DISTINCT id, path FROM n JOIN q ON q.base = n.base OR q.stem = n.stem OR ends_with(q.stem, '/' || n.stem) OR q.stem = n.base OR ends_with(q.stem, '/' || n.base)""")
def join_references_to_paths(spark, d):
    a = accesses(spark, d)
    refs = a.selectExpr("k AS id", "CASE k % 3 WHEN 0 THEN 'file_' || k || '.py' WHEN 1 THEN 'mod' || (k % 10) || '/file_' || k ELSE 'File_' || k END AS ref").distinct()
    return J.references_to_paths(refs, a)


SCORES = "s AS (SELECT 'file_' || CAST(k AS VARCHAR) AS path, round(count(*) / 1000.0::DOUBLE, 3) AS score FROM accesses GROUP BY k), act AS (SELECT path FROM s WHERE score > 0.115)"


def scored(spark, d):
    s = accesses(spark, d).groupBy(F.concat(F.lit("file_"), "k").alias("path")).agg(F.round(F.count("*") / 1000.0, 3).alias("score"))
    return s, s.where("score > 0.115").select("path")


@query("join_neighbour_boost", ctes("accesses", "edges") + f", {SCORES}, b AS (SELECT dst AS path, sum(0.35::DOUBLE) AS add FROM act JOIN edges ON src = path GROUP BY dst) SELECT path, round(least(1.0, score + coalesce(add, 0)), 6) AS score FROM s LEFT JOIN b USING (path)")
def join_neighbour_boost(spark, d):
    return J.neighbour_boost(*scored(spark, d), edges(spark, d), F.lit(0.35))


@query("join_import_boost", ctes("accesses", "edges") + f", {SCORES}, b AS (SELECT path, sum(p) AS add FROM (SELECT dst AS path, 0.15::DOUBLE AS p FROM act JOIN edges ON src = path UNION ALL SELECT src, 0.10::DOUBLE FROM act JOIN edges ON dst = path) GROUP BY path) SELECT path, round(least(1.0, score + coalesce(add, 0)), 6) AS score FROM s LEFT JOIN b USING (path)")
def join_import_boost(spark, d):
    """Imports of activated files forward and back."""
    e = edges(spark, d)
    both = e.select("src", "dst", F.lit(0.15).alias("p")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.10).alias("p")))
    return J.neighbour_boost(*scored(spark, d), both, F.col("p"))


@query("join_test_pairs", r"WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'test_' ELSE '' END || 'f' || CAST(doc_id // 2 % 97 AS VARCHAR) || '.py' AS name, source FROM documents), q AS (SELECT source || '/' || name AS path, name FROM p), f AS (SELECT name, min(path) AS other FROM q GROUP BY name) SELECT path, other FROM q JOIN f ON f.name = CASE WHEN starts_with(q.name, 'test_') THEN substr(q.name, 6) ELSE 'test_' || q.name END")
def join_test_pairs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("source || '/' || CASE WHEN doc_id % 2 = 0 THEN 'test_' ELSE '' END || 'f' || CAST(floor(doc_id / 2) % 97 AS STRING) || '.py' AS path")
    return J.test_pairs(docs)


@query("join_longest_prefix", "WITH p(prefix, value) AS (VALUES ('src0', 'team-a'), ('src0/en', 'team-b'), ('src1', 'team-c'), ('src2', 'team-d'), ('src2', 'team-e'), ('src3/fr', 'team-f')), ok AS (SELECT prefix, min(value) AS value FROM p GROUP BY prefix HAVING count(DISTINCT value) = 1), r AS (SELECT doc_id AS id, source || '/' || lang || '/x' AS cwd FROM documents), j AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY length(prefix) DESC) AS n FROM r JOIN ok ON cwd = prefix OR starts_with(cwd, prefix || '/')) SELECT r.id, value FROM r LEFT JOIN j ON j.id = r.id AND n = 1")
def join_longest_prefix(spark, d):
    p = spark.createDataFrame([("src0", "team-a"), ("src0/en", "team-b"), ("src1", "team-c"), ("src2", "team-d"), ("src2", "team-e"), ("src3/fr", "team-f")], "prefix string, value string")
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.lit("x")).alias("cwd"))
    return J.longest_prefix(rows, "cwd", p).select("id", "value")


REFS = "rf AS (SELECT DISTINCT turn % 50 AS doc, 'file_' || CAST(k AS VARCHAR) AS ref FROM accesses), kn AS (SELECT DISTINCT src AS ref FROM edges WHERE length(src) < 7)"


def refs_known(spark, d):
    return accesses(spark, d).select((F.col("turn") % 50).alias("doc"), F.concat(F.lit("file_"), "k").alias("ref")).distinct(), edges(spark, d).where("length(src) < 7").select(F.col("src").alias("ref"))


@query("join_stale_references", ctes("accesses", "edges") + f", {REFS} SELECT doc, ref FROM rf WHERE ref NOT IN (SELECT ref FROM kn)")
def join_stale_references(spark, d):
    return J.stale_references(*refs_known(spark, d)).select("doc", "ref")


@query("join_staleness", ctes("accesses", "edges") + f", {REFS}, t AS (SELECT doc, sum(CASE WHEN kn.ref IS NULL THEN 1 ELSE 0 END) / count(*) AS r FROM rf LEFT JOIN kn USING (ref) GROUP BY doc) SELECT doc, round(r, 6) AS ratio, CASE WHEN r > 0.8 THEN 'skip' WHEN r > 0.5 THEN 'demote' ELSE 'keep' END AS action FROM t")
def join_staleness(spark, d):
    return J.staleness(*refs_known(spark, d))


@query("join_unseen_hashes", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 100)")
def join_unseen_hashes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("h"))
    return J.unseen(docs, docs.where("doc_id < 100"), "h").select("doc_id")


@query("join_neighbours_in_time", ctes("observations") + ", o AS (SELECT id, session_id, ts // 50 AS t FROM observations) SELECT a.id, coalesce((SELECT string_agg(CAST(x.id AS VARCHAR), ' ' ORDER BY x.t DESC, x.id DESC) FROM (SELECT b.id, b.t FROM o b WHERE b.session_id = a.session_id AND b.t < a.t ORDER BY b.t DESC, b.id DESC LIMIT 3) x), '') AS before FROM o a")
def join_neighbours_in_time(spark, d):
    return timed_neighbours(spark, d).select("id", F.array_join(F.col("before").cast("array<string>"), " ").alias("before"))


def timed_neighbours(spark, d):
    o = view(spark, d, "observations").selectExpr("id", "session_id", "CAST(floor(ts / 50) AS BIGINT) AS t")
    return J.neighbours_in_time(o, 3, "session_id", "t")


@query("join_timeline", ctes("observations") + ", o AS (SELECT id, session_id, ts // 50 AS t FROM observations) SELECT a.id, coalesce((SELECT string_agg(CAST(x.id AS VARCHAR), ' ' ORDER BY x.t, x.id) FROM (SELECT b.id, b.t FROM o b WHERE b.session_id = a.session_id AND b.t < a.t ORDER BY b.t DESC, b.id DESC LIMIT 3) x), '') AS before, coalesce((SELECT string_agg(CAST(x.id AS VARCHAR), ' ' ORDER BY x.t, x.id) FROM (SELECT b.id, b.t FROM o b WHERE b.session_id = a.session_id AND b.t > a.t ORDER BY b.t, b.id LIMIT 3) x), '') AS after FROM o a")
def join_timeline(spark, d):
    """Both sides of each observation in order of time."""
    ids = lambda c: F.array_join(c.cast("array<string>"), " ")
    return timed_neighbours(spark, d).select("id", ids(F.reverse("before")).alias("before"), ids(F.col("after")).alias("after"))


@query("join_upsert", "WITH o AS (SELECT doc_id AS id, n_chars AS v, 0 AS n FROM documents WHERE doc_id % 3 <> 0), w AS (SELECT doc_id AS id, length(source) * 100 AS v, 1 AS n FROM documents WHERE doc_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, n DESC) AS k FROM (SELECT * FROM o UNION ALL SELECT * FROM w)) SELECT id, v FROM r WHERE k = 1")
def join_upsert(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return J.upsert(docs.where("doc_id % 3 <> 0").selectExpr("doc_id AS id", "n_chars AS v"), docs.where("doc_id % 2 = 0").selectExpr("doc_id AS id", "CAST(length(source) * 100 AS BIGINT) AS v"), "id", "v")


@query("set_symmetric_edges", ctes("edges") + " SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def set_symmetric_edges(spark, d):
    return G.symmetric(edges(spark, d))


@query("set_unused_files", ctes("turns") + " SELECT project, injected AS path FROM turns EXCEPT SELECT project, used FROM turns")
def set_unused_files(spark, d):
    t = view(spark, d, "turns")
    return t.select("project", F.col("injected").alias("path")).subtract(t.select("project", F.col("used").alias("path")))


@query("set_predicted_and_used", ctes("turns") + " SELECT project, injected AS path FROM turns INTERSECT SELECT project, used FROM turns")
def set_predicted_and_used(spark, d):
    t = view(spark, d, "turns")
    return t.select("project", F.col("injected").alias("path")).intersect(t.select("project", F.col("used").alias("path")))


@query("set_basket_pairs", ctes("baskets") + " SELECT DISTINCT a.path AS src, b.path AS dst FROM baskets a JOIN baskets b ON a.turn_id = b.turn_id AND a.path <> b.path")
def set_basket_pairs(spark, d):
    b = view(spark, d, "baskets")
    return b.select("turn_id", F.col("path").alias("src")).join(b.select("turn_id", F.col("path").alias("dst")), "turn_id").where("src <> dst").select("src", "dst").distinct()


@query("set_overrides", "WITH g(k, v) AS (VALUES ('a', 1), ('b', 2)), p AS (SELECT user_id % 3 AS project, CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'c' END AS k, CAST(max(user_id) AS INT) AS v FROM events GROUP BY 1, 2), pr AS (SELECT DISTINCT project FROM p) SELECT project, coalesce(p.k, x.k) AS k, coalesce(p.v, x.v) AS v FROM (SELECT project, g.k, g.v FROM pr, g) x FULL JOIN p USING (project, k)")
def set_overrides(spark, d):
    """Global parameters with a project's own ones over them, as maps."""
    g = F.expr("map('a', 1, 'b', 2)")
    p = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 3).alias("project"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'c' END").alias("k")).agg(F.max("user_id").cast("int").alias("v"))
    own = p.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("own"))
    merged = F.map_concat(F.map_filter(g, lambda k, v: ~F.map_contains_key("own", k)), "own")
    return own.select("project", F.explode(merged).alias("k", "v"))


def pagerank_sql(rounds: int) -> str:
    s = ctes("edges") + ", e AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT src AS path FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), m AS (SELECT path, deg FROM n LEFT JOIN o ON src = path), r0 AS (SELECT path, deg, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM m)"
    for k in range(rounds):
        s += f", r{k + 1} AS (SELECT m.path, m.deg, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (coalesce(g.got, 0) + coalesce((SELECT sum(rank) FROM r{k} WHERE deg IS NULL), 0) / (SELECT count(*) FROM n)) AS rank FROM m LEFT JOIN (SELECT dst, sum(rank / deg) AS got FROM e JOIN r{k} ON r{k}.path = e.src GROUP BY dst) g ON g.dst = m.path)"
    return s + f" SELECT path, round(rank, 9) AS rank FROM r{rounds}"


@query("graph_pagerank", pagerank_sql(5))
def graph_pagerank(spark, d):
    return G.pagerank(edges(spark, d), rounds=5)


STARTS = "st AS (SELECT path FROM (VALUES ('file_1'), ('file_42')) t(path)), b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def starts(spark):
    return spark.createDataFrame([("file_1",), ("file_42",)], "path string")


@query("graph_neighbourhood", ctes("edges") + f", {STARTS}, h1 AS (SELECT DISTINCT path AS start, dst AS path FROM st JOIN b ON src = path WHERE dst <> path), h2 AS (SELECT DISTINCT start, dst AS path FROM h1 JOIN b ON src = path WHERE dst <> start) SELECT start, path, 1 AS depth FROM h1 UNION ALL SELECT start, path, 2 FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = h2.start AND h1.path = h2.path)")
def graph_neighbourhood(spark, d):
    return G.within_hops(starts(spark), edges(spark, d), 2)


@query("graph_transitive_boosts", ctes("edges") + f", {STARTS}, h1 AS (SELECT DISTINCT path AS start, dst AS path FROM st JOIN b ON src = path WHERE dst <> path), h2 AS (SELECT DISTINCT start, dst AS path FROM h1 JOIN b ON src = path WHERE dst <> start), u AS (SELECT path, 0.35::DOUBLE AS boost FROM h1 UNION ALL SELECT path, 0.075::DOUBLE FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = h2.start AND h1.path = h2.path)) SELECT path, max(boost) AS boost FROM u WHERE path NOT IN (SELECT path FROM st) GROUP BY path")
def graph_transitive_boosts(spark, d):
    return G.transitive_boosts(starts(spark), edges(spark, d))


@query("graph_import_boosts", ctes("edges") + ", s0 AS (SELECT path, 1.0::DOUBLE AS s FROM (VALUES ('file_1'), ('file_42')) t(path)), s1 AS (SELECT path, max(s) AS s FROM (SELECT dst AS path, s * 0.5::DOUBLE AS s FROM s0 JOIN edges ON src = path UNION ALL SELECT src, s * 0.5::DOUBLE * 0.7::DOUBLE FROM s0 JOIN edges ON dst = path) GROUP BY path), s2 AS (SELECT path, max(s) AS s FROM (SELECT dst AS path, s * 0.5::DOUBLE AS s FROM s1 JOIN edges ON src = path UNION ALL SELECT src, s * 0.5::DOUBLE * 0.7::DOUBLE FROM s1 JOIN edges ON dst = path) GROUP BY path) SELECT path, round(max(s), 6) AS score FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY path")
def graph_import_boosts(spark, d):
    return G.import_boosts(starts(spark).withColumn("score", F.lit(1.0)), edges(spark, d))


@query("graph_definers", ctes("accesses") + ", df AS (SELECT DISTINCT 'n' || CAST(k % 40 AS VARCHAR) AS name, path FROM accesses WHERE tool = 'Edit' AND k % 4 <> 1), few AS (SELECT name FROM df GROUP BY name HAVING count(DISTINCT path) <= 2), rf AS (SELECT DISTINCT 'n' || CAST((k + 3) % 40 AS VARCHAR) AS name, path FROM accesses WHERE tool = 'Read') SELECT DISTINCT rf.path AS src, df.path AS dst FROM rf JOIN df USING (name) WHERE name IN (SELECT name FROM few) AND rf.path <> df.path")
def graph_definers(spark, d):
    a = accesses(spark, d)
    defs = a.where("tool = 'Edit' AND k % 4 <> 1").select(F.concat(F.lit("n"), F.col("k") % 40).alias("name"), "path")
    refs = a.where("tool = 'Read'").select(F.concat(F.lit("n"), (F.col("k") + 3) % 40).alias("name"), "path").distinct()
    return G.definers(defs, refs, most=2)
