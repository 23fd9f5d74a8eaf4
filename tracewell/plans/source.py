"""Queries over source files and pages of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import source as S
from ..operators.learning import top_n
from ..sources import logs
from ..operators import outlines as O
from .registry import query
from .views import ctes, view

GENERIC = ", ".join(f"'{n}'" for n in C.GENERIC_NAMES)


def code(spark, d):
    return view(spark, d, "code").withColumn("language", F.lit("python"))


def sources(spark, d):
    return view(spark, d, "sources")


def md(spark, d):
    return view(spark, d, "pages_md")


@query("source_symbols", ctes("code") + r""", l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line FROM code), s AS (SELECT path, CAST(line AS INT) AS line, regexp_extract(text, '^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)', 1) AS f, regexp_extract(text, '^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)', 2) AS p, regexp_extract(text, '^class\s+(\w+)', 1) AS c FROM l)
SELECT path, line, CASE WHEN f <> '' THEN 'function' ELSE 'class' END AS kind, CASE WHEN f <> '' THEN f ELSE c END AS name, CASE WHEN f <> '' THEN 'def ' || f || '(' || p || '):' ELSE 'class ' || c || ':' END AS signature FROM s WHERE f <> '' OR c <> ''""")
def source_symbols(spark, d):
    return C.symbols(code(spark, d))


@query("source_imports", ctes("code") + r""", l AS (SELECT path, unnest(string_split(content, chr(10))) AS text FROM code), m AS (SELECT DISTINCT path, CASE WHEN starts_with(text, 'from ') THEN regexp_extract(text, '^from\s+(\S+)', 1) ELSE regexp_extract(text, '^import\s+(\S+)', 1) END AS module FROM l WHERE starts_with(text, 'from ') OR starts_with(text, 'import ')) SELECT DISTINCT m.path AS src, c.path AS dst FROM m JOIN code c ON replace(regexp_replace(c.path, '\.py$', ''), '/', '.') = m.module WHERE m.path <> c.path""")
def source_imports(spark, d):
    return C.import_edges(code(spark, d))


@query("source_references", ctes("code") + rf""", r AS (SELECT path, unnest(list_concat(regexp_extract_all(content, '(?:\b|\.)([A-Za-z_][A-Za-z0-9_]{{2,}})\s*\(', 1), regexp_extract_all(content, '(?m)^\s*class\s+\w+\s*\(([^)]+)\)\s*:', 1))) AS name FROM code) SELECT path, string_agg(DISTINCT name, ' ' ORDER BY name) AS names FROM r WHERE name NOT IN ({GENERIC}) GROUP BY path""")
def source_references(spark, d):
    return code(spark, d).select("path", F.array_join(C.references(F.col("content")), " ").alias("names"))


@query("source_summaries", ctes("code") + " SELECT path, CASE WHEN starts_with(content, '#') THEN substr(trim(regexp_replace(string_split(content, chr(10))[1], '^[/*#]+', '')), 1, 100) END AS summary FROM code")
def source_summaries(spark, d):
    return code(spark, d).select("path", S.summary_line(F.col("content")).alias("summary"))


@query("source_edges_by_definition", ctes("code") + rf""", s AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '(?m)^(?:async\s+)?def\s+(\w+)', 1)) AS name FROM code), f AS (SELECT name FROM s GROUP BY name HAVING count(DISTINCT path) <= 4), r AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '(?:\b|\.)([A-Za-z_][A-Za-z0-9_]{{2,}})\s*\(', 1)) AS name FROM code) SELECT DISTINCT r.path AS src, s.path AS dst FROM r JOIN s USING (name) WHERE name IN (SELECT name FROM f) AND r.path <> s.path""")
def source_edges_by_definition(spark, d):
    from ..operators.graph import definers

    c = code(spark, d)
    defs = C.symbols(c).where("kind = 'function'").select("path", "name")
    refs = c.select("path", F.explode(C.all_of(F.col("content"), r"(?:\b|\.)([A-Za-z_][A-Za-z0-9_]{2,})\s*\(")).alias("name")).distinct()
    return definers(defs, refs)


LINES = "ln AS (SELECT path, language, unnest(string_split(content, chr(10))) AS text, CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INT) AS line FROM sources)"
SYMBOLS = LINES + r""", sy AS (
SELECT path, line, 'function' AS kind, regexp_extract(text, 'def (\w+)', 1) AS name, 'def ' || regexp_extract(text, 'def (\w+)', 1) || '(' || substr(regexp_extract(text, '\((.*)\)', 1), 1, 50) || CASE WHEN length(regexp_extract(text, '\((.*)\)', 1)) > 50 THEN '...' ELSE '' END || '):' AS signature FROM ln WHERE language = 'python' AND regexp_matches(text, '^(async )?def ')
UNION ALL SELECT path, line, 'class', regexp_extract(text, '^class (\w+)', 1), 'class ' || regexp_extract(text, '^class (\w+)', 1) || ':' FROM ln WHERE language = 'python' AND starts_with(text, 'class ')
UNION ALL SELECT path, line, 'function', regexp_extract(text, 'function (\w+)', 1), 'function ' || regexp_extract(text, 'function (\w+)', 1) || '()' FROM ln WHERE language = 'typescript' AND contains(text, 'function ')
UNION ALL SELECT path, line, 'function', regexp_extract(text, 'const (\w+)', 1), 'const ' || regexp_extract(text, 'const (\w+)', 1) || ' = () =>' FROM ln WHERE language = 'typescript' AND starts_with(text, 'const ')
UNION ALL SELECT path, line, 'class', regexp_extract(text, 'class (\w+)', 1), 'class ' || regexp_extract(text, 'class (\w+)', 1) FROM ln WHERE language IN ('javascript', 'dart') AND contains(text, 'class ')
UNION ALL SELECT path, line, 'struct', regexp_extract(text, '^type (\w+)', 1), 'type ' || regexp_extract(text, '^type (\w+)', 1) || ' struct' FROM ln WHERE language = 'go' AND starts_with(text, 'type ')
UNION ALL SELECT path, line, 'function', regexp_extract(text, '(Run_\d+)', 1), 'func ' || regexp_extract(text, '(Run_\d+)', 1) || '()' FROM ln WHERE language = 'go' AND starts_with(text, 'func ')
UNION ALL SELECT path, line, 'function', regexp_extract(text, '(load_\d+)', 1), regexp_extract(text, '(load_\d+)', 1) || '()' FROM ln WHERE language = 'dart' AND contains(text, 'Future<'))"""
EDGES = """gd AS (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, path, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path) AS n FROM sources WHERE language = 'go'),
ie AS (SELECT a.path AS src, b.path AS dst FROM sources a JOIN sources b ON b.doc_id = a.t WHERE a.language <> 'go' AND a.t <> a.doc_id UNION SELECT a.path, g.path FROM sources a JOIN gd g ON g.folder = 'pkg' || CAST(a.t % 9 AS VARCHAR) AND n <= 5 WHERE a.language = 'go' AND a.path <> g.path)"""
NAMED = rf"""rn AS (SELECT DISTINCT path, unnest(list_concat(list_concat(regexp_extract_all(content, '(?:\b|\.)([A-Za-z_][A-Za-z0-9_]{{2,}})\s*\(', 1), regexp_extract_all(content, '\bextends\s+(\w+)', 1)), list_concat(list_concat(string_split(regexp_extract(content, 'use\(([^)]*)\)', 1), ', '), string_split(regexp_extract(content, 'preHandler: \[([^]]*)\]', 1), ', ')), regexp_extract_all(content, '(?m)^class \w+\((\w+)\)', 1)))) AS name FROM sources), rf AS (SELECT path, name FROM rn WHERE name <> '' AND name NOT IN ({GENERIC}))"""
STRUCTURE = "df AS (SELECT name FROM sy GROUP BY name HAVING count(DISTINCT path) <= 4), se AS (SELECT src, dst FROM ie UNION SELECT rf.path, sy.path FROM rf JOIN sy USING (name) WHERE name IN (SELECT name FROM df) AND rf.path <> sy.path)"


@query("source_symbols_by_language", ctes("sources") + f", {SYMBOLS} SELECT * FROM sy")
def source_symbols_by_language(spark, d):
    return C.symbols(sources(spark, d))


#: A file's fingerprint: its first comment (docstrings too), classes, functions, imports.
FINGERPRINT = r"""array_to_string(list_concat(list_concat(list_filter(list_transform(list_transform(string_split(content, chr(10))[1:15], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: CASE WHEN starts_with(x, '\"\"\"') OR starts_with(x, repeat(chr(39), 3)) THEN nullif(substr(regexp_replace(trim(x, '\"' || chr(39)), '^\s+|\s+$', '', 'g'), 1, 150), '') WHEN starts_with(x, '#') AND NOT starts_with(x, '#!') THEN substr(regexp_replace(ltrim(x, '# '), '\s+$', ''), 1, 100) END), lambda x: x IS NOT NULL)[1:1], list_transform(regexp_extract_all(content, '(?m)^class\s+(\w+)', 1), lambda n: n || ' ' || lower(regexp_replace(n, '([a-z])([A-Z])', '\1 \2', 'g')))), list_concat(list_transform(list_filter(regexp_extract_all(content, '(?m)^(?:    )?def\s+(\w+)', 1), lambda n: NOT starts_with(n, '_'))[1:20], lambda n: n || ' ' || replace(n, '_', ' ')), list_filter(regexp_extract_all(content, '(?m)^(?:from\s+\S+\s+)?import\s+(\w+)', 1), lambda n: length(n) > 3 AND n NOT IN ('json', 'sys', 'os', 're', 'Path')))), ' ')""".replace('\\"', '"')


@query("source_fingerprints", ctes("code") + f" SELECT path, {FINGERPRINT} AS fingerprint FROM code")
def source_fingerprints(spark, d):
    return code(spark, d).select("path", C.fingerprint(F.col("content")).alias("fingerprint"))


@query("source_import_edges", ctes("sources") + f", {EDGES} SELECT src, dst FROM ie")
def source_import_edges(spark, d):
    return C.import_edges(sources(spark, d))


@query("source_references_by_language", ctes("sources") + f", {NAMED} SELECT path, coalesce(string_agg(name, ' ' ORDER BY name) FILTER (name IN (SELECT name FROM rf)), '') AS names FROM (SELECT path, name FROM rf UNION ALL SELECT path, NULL FROM sources) AS x GROUP BY path")
def source_references_by_language(spark, d):
    return sources(spark, d).select("path", F.array_join(C.references(F.col("content"), F.col("language")), " ").alias("names"))


@query("source_structural_edges", ctes("sources") + f", {SYMBOLS}, {EDGES}, {NAMED}, {STRUCTURE} SELECT src, dst FROM se")
def source_structural_edges(spark, d):
    return C.structural_edges(sources(spark, d))


@query("source_files_by_language", ctes("sources") + ", f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'x/node_modules/' || path ELSE path END AS path, language FROM sources) SELECT language, count(*) AS n FROM f WHERE NOT contains(path, 'node_modules/') GROUP BY language")
def source_files_by_language(spark, d):
    """Source files by language, without those of folders that are skipped."""
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x/node_modules/"), "path")).otherwise(F.col("path"))
    f = sources(spark, d).select(path.alias("path")).where(~C.in_folders(F.col("path"), C.SKIPPED))
    return f.groupBy(C.language(F.col("path")).alias("language")).agg(F.count("*").alias("n")).where("language IS NOT NULL")


@query("source_scores", ctes("sources") + f""", {SYMBOLS}, {EDGES}, {NAMED}, {STRUCTURE}, q AS (SELECT 'why does run_25 fail beside box and file_30' AS q), nb AS (SELECT dst AS path FROM se WHERE src = 'pkg7/file_25.py' UNION SELECT src FROM se WHERE dst = 'pkg7/file_25.py'),
ps AS (SELECT path, sum(3 * CAST(contains(q, lower(name)) AS INT) + len(list_filter(list_concat(string_split(lower(name), '_'), regexp_extract_all(name, '[A-Z][a-z]+')), lambda x: contains(q, lower(x))))) AS n FROM sy, q GROUP BY path)
SELECT s.path, round(0.1::DOUBLE + CASE WHEN s.path = 'pkg7/file_25.py' THEN 10 WHEN nb.path IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN contains(q, regexp_extract(s.path, '(file_\\d+)', 1)) THEN 5 ELSE 0 END + coalesce(n, 0), 6) AS score FROM sources s CROSS JOIN q LEFT JOIN nb ON nb.path = s.path LEFT JOIN ps ON ps.path = s.path""")
def source_scores(spark, d):
    """Files by their worth for a query with one active file; no ranks."""
    s = sources(spark, d)
    ranks = s.select("path").limit(0).withColumn("rank", F.lit(0.0))
    return C.file_scores(s, ranks, C.structural_edges(s), ["./pkg7/file_25.py"], "Why does run_25 fail beside box and file_30")


@query("notes_relationships", ctes("pages_md") + r""", r AS (SELECT path, content, list_sort(list_distinct(list_concat(regexp_extract_all(content, '`([a-zA-Z0-9_/.-]+\.[a-zA-Z]+)`', 1), regexp_extract_all(content, '\*\*Location\*\*:\s*`([^`]+)`', 1)))) AS f FROM pages_md) SELECT path, array_to_string(f, ' ') AS describes, array_to_string(list_filter(regexp_split_to_array(regexp_extract(content, '## (?:Auto-Generated )?Keywords?\s*\n([^\n#]+)', 1), '[,\s]+'), lambda w: w <> ''), ' ') AS keywords FROM r""")
def notes_relationships(spark, d):
    c = F.col("content")
    return md(spark, d).select("path", F.array_join(S.described_files(c), " ").alias("describes"), F.array_join(S.listed_keywords(c), " ").alias("keywords"))


@query("notes_contents", ctes("pages_md") + r""", l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM pages_md), h AS (SELECT *, trim(text) AS s, sum(CASE WHEN starts_with(trim(text), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY n) AS hd FROM l), k AS (SELECT *, sum(CASE WHEN s <> '' AND NOT starts_with(s, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY path, hd ORDER BY n) AS nth FROM h),
u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY n) AS used FROM k WHERE starts_with(s, '#') OR (s <> '' AND nth <= 2) OR ((starts_with(s, '-') OR starts_with(s, '*')) AND NOT starts_with(s, '---'))) SELECT path, md5(string_agg(text, chr(10) ORDER BY n)) AS toc_md5, count(*) AS lines FROM u WHERE used <= 500 GROUP BY path""")
def notes_contents(spark, d):
    return S.contents(md(spark, d), 500).select("path", F.md5("toc").alias("toc_md5"), "lines")


@query("notes_keywords")
def notes_keywords(spark, d):
    """Ordered and deduplicated over several fields; tests compare it with a plain version."""
    return md(spark, d).select("path", F.array_join(S.page_keywords(F.col("path"), F.col("content")), " ").alias("keywords"))


@query("notes_promotions", ctes("observations") + r""", n AS (SELECT id, substr(summary, 1, 80) AS note, CASE id % 3 WHEN 0 THEN NULL ELSE 'f' END AS target, CASE WHEN id % 3 = 1 THEN summary WHEN id % 2 = 0 THEN NULL ELSE 'nothing' END AS body FROM observations), w AS (SELECT *, list_filter(regexp_extract_all(lower(note), '[a-z0-9_./-]{4,}'), lambda w: w NOT IN ('that', 'this', 'with', 'from', 'have', 'been', 'will', 'must')) AS ws FROM n)
SELECT id, CASE WHEN target IS NULL THEN 'UNPROMOTED' WHEN body IS NOT NULL AND len(ws) > 0 AND len(list_filter(ws[1:12], lambda x: contains(lower(body), x))) >= greatest(2, least(3, len(ws))) THEN 'PROMOTED' ELSE 'CLAIMED' END AS state FROM w""")
def notes_promotions(spark, d):
    o = view(spark, d, "observations").selectExpr("id", "substring(summary, 1, 80) AS note", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'f' END AS target", "CASE WHEN id % 3 = 1 THEN summary WHEN id % 2 = 0 THEN NULL ELSE 'nothing' END AS body")
    return o.select("id", S.promotion(F.col("note"), F.col("target"), F.col("body")).alias("state"))


@query("turn_confidence", ctes("turns") + ", r AS (SELECT turn_id, CASE WHEN warm_count > 0 THEN hot_count / warm_count ELSE 1.0::DOUBLE END AS a, CASE WHEN hot_count > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (hot_count % 3) / hot_count) ELSE 1.0::DOUBLE END AS b, CASE WHEN waste_ratio >= 0 THEN 1.0::DOUBLE - CAST(waste_ratio AS DOUBLE) ELSE 1.0::DOUBLE END AS c FROM turns) SELECT turn_id, round(a, 3) AS relevance, round(b, 3) AS sufficiency, round(c, 3) AS precision FROM r")
def turn_confidence(spark, d):
    t = view(spark, d, "turns")
    c = S.confidence(F.col("warm_count"), F.col("hot_count"), F.col("hot_count") % 3, F.col("hot_count"), F.col("waste_ratio").cast("double"))
    return t.select("turn_id", c.alias("c")).select("turn_id", "c.relevance", "c.sufficiency", "c.precision")


@query("text_project_names", "WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C--Users-me-' || source WHEN 1 THEN '-home-me-' || source || '-x' WHEN 2 THEN '-home-me' WHEN 3 THEN '' ELSE source END AS f FROM documents) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN substr(f, 13) WHEN 1 THEN substr(f, 10) WHEN 2 THEN '~' WHEN 3 THEN 'unknown' ELSE f END AS project FROM f")
def text_project_names(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    f = F.expr("CASE doc_id % 5 WHEN 0 THEN 'C--Users-me-' || source WHEN 1 THEN '-home-me-' || source || '-x' WHEN 2 THEN '-home-me' WHEN 3 THEN '' ELSE source END")
    return docs.select("doc_id", S.project_name(f).alias("project"))


@query("text_namespaces", r"WITH c AS (SELECT page_id, lower(regexp_replace(url, '/+$', '')) AS c FROM pages) SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(string_split(c, '/')[-1], '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24), ''), 'repo') || '-' || substr(sha256(c), 1, 12) AS id FROM c")
def text_namespaces(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.namespace_id(F.col("url")).alias("id"))


@query("text_mentioned_files", ctes("pages_md") + r", m AS (SELECT doc_id, regexp_extract_all(regexp_replace(substr(content, 1, strpos(content, 'plain') - 1) || 'see http://x.com/a.py', '(?:https?|file)://\S+', ' ', 'g'), '(?:[\w./-]+/)?[\w.-]+\.(?:py|ts)') AS f FROM pages_md) SELECT doc_id, array_to_string(list_sort(list_distinct(f)), ' ') AS files FROM m")
def text_mentioned_files(spark, d):
    """Addresses of pages are left out. The part of each page that this reads is the view's own, not a document's."""
    own = F.concat(F.expr("substring(content, 1, instr(content, 'plain') - 1)"), F.lit("see http://x.com/a.py"))
    return md(spark, d).select("doc_id", F.array_join(S.mentioned_files(own), " ").alias("files"))


@query("text_hashed_words", ctes("prompts") + r", w AS (SELECT session_id, turn, unnest(list_filter(regexp_split_to_array(lower(prompt), '\s+'), lambda x: x <> '')) AS w FROM prompts), n AS (SELECT session_id, turn, CAST(('0x' || substr(md5(w), 31, 2))::INT AS INT) AS slot, count(*) AS n FROM w GROUP BY 1, 2, 3) SELECT session_id, turn, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY session_id, turn)), 9) AS weight FROM n")
def text_hashed_words(spark, d):
    return S.hashed_words(view(spark, d, "prompts"), ["session_id", "turn"], "prompt")


@query("learn_vocabulary", ctes("accesses") + ", c AS (SELECT path, count(*) AS n FROM accesses GROUP BY path) SELECT path, n, row_number() OVER (ORDER BY n DESC, path) + 1 AS id FROM c ORDER BY n DESC, path LIMIT 1998")
def learn_vocabulary(spark, d):
    """The commonest files with ids from 2 on; 0 and 1 stand for padding and unknown. The rank is given to at most 1,998 rows."""
    from pyspark.sql import Window

    c = view(spark, d, "accesses").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(1998)
    return c.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "path")) + 1)


@query("learn_training_sessions", ctes("accesses") + ", t AS (SELECT session_id, turn, string_agg(path, ' ' ORDER BY p) AS files FROM (SELECT session_id, turn, path, min(pos) AS p FROM accesses GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT session_id, count(*) AS turns, string_agg(files, '|' ORDER BY turn) AS files FROM t GROUP BY session_id HAVING count(*) >= 3")
def learn_training_sessions(spark, d):
    """Files of each turn in the order of their first use, sessions of at least three turns."""
    first = view(spark, d, "accesses").groupBy("session_id", "turn", "path").agg(F.min("pos").alias("p"))
    listed = lambda o, v: F.transform(F.array_sort(F.collect_list(F.struct(o, v))), lambda x: x[v])
    t = first.groupBy("session_id", "turn").agg(F.array_join(listed("p", "path"), " ").alias("files"))
    return t.groupBy("session_id").agg(F.count("*").alias("turns"), F.array_join(listed("turn", "files"), "|").alias("files")).where("turns >= 3")


@query("report_session_sizes", ctes("usage") + ", s AS (SELECT session_id, sum(input_tokens + output_tokens) AS t FROM usage GROUP BY 1) SELECT CASE WHEN t < 5000 THEN 'small' WHEN t < 20000 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM s GROUP BY 1")
def report_session_sizes(spark, d):
    s = view(spark, d, "usage").groupBy("session_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("t"))
    return s.groupBy(F.when(F.col("t") < 5000, "small").when(F.col("t") < 20000, "medium").otherwise("large").alias("size")).agg(F.count("*").alias("n"))


@query("monitor_last_calls", ctes("accesses") + ", r AS (SELECT user_id, pos, tool, path, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS n FROM accesses WHERE tool <> 'Error') SELECT user_id, pos, tool, path FROM r WHERE n = 1")
def monitor_last_calls(spark, d):
    """The newest call of each session that named a tool."""
    a = view(spark, d, "accesses").where("tool <> 'Error'")
    return top_n(a, ["user_id"], [F.desc("pos")], 1).select("user_id", "pos", "tool", "path")


@query("source_described_commits", ctes("sources") + ", r AS (SELECT doc_id, path, language FROM sources) SELECT CAST(doc_id AS VARCHAR) AS repo, 'Mend the parser ' || CAST(doc_id AS VARCHAR) AS prompt, path || ' b/C.PY' AS files FROM r WHERE language <> 'dart' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Mend the parser ' || CAST(doc_id AS VARCHAR), 'b/C.PY' FROM r WHERE language = 'dart'")
def source_described_commits(spark, d):
    """Commits with their subjects, from a log for each file: the second has no subject, the third no source file."""
    log = sources(spark, d).selectExpr("CAST(doc_id AS STRING) AS repo", "'---MSG---\nMend the parser ' || doc_id || '\n' || path || '\nnotes.md\nb/C.PY\n\n---MSG---\nshort\na.py\n---MSG---\nOnly words here\nx.md\n' AS value")
    return logs.described_commits(log).select("repo", "prompt", F.array_join("files", " ").alias("files"))


@query("source_pushed_commits", ctes("commits") + ", p AS (SELECT commit_idx, list_sort(list(path || CASE WHEN commit_idx % 4 = 0 THEN '.md' ELSE '.py' END)) AS files FROM commits WHERE commit_idx % 3 <> 0 GROUP BY commit_idx), k AS (SELECT * FROM p WHERE commit_idx % 4 <> 0 AND len(files) <= 4 ORDER BY commit_idx DESC LIMIT 500) SELECT 'r' || CAST(commit_idx % 9 AS VARCHAR) AS repo_name, 'change number ' || CAST(commit_idx AS VARCHAR) AS commit_message, array_to_string(files, ' ') AS changed_files, CAST(len(files) AS INT) AS file_count FROM k")
def source_pushed_commits(spark, d):
    c = view(spark, d, "commits").groupBy("commit_idx").agg(F.collect_list(F.expr("path || CASE WHEN commit_idx % 4 = 0 THEN '.md' ELSE '.py' END")).alias("files"))
    pushes = c.selectExpr("'r' || (commit_idx % 9) AS repo_name", "commit_idx AS created_at", "array(named_struct('message', 'change number ' || commit_idx, 'is_distinct', commit_idx % 3 <> 0, 'files', concat(files, files))) AS commits")
    return logs.pushed_commits(pushes, 500, most=4).withColumn("changed_files", F.array_join("changed_files", " "))


SCANNED = """d AS (SELECT path, line, end_line, depth, kind, name, signature FROM (
  SELECT path, unnest(CASE language
    WHEN 'python' THEN [{'line': 1, 'end_line': 4 + n, 'depth': 0, 'kind': 'class', 'name': 'C' || doc_id, 'signature': 'class C' || doc_id}, {'line': 3 + n, 'end_line': 4 + n, 'depth': 1, 'kind': 'function', 'name': 'run', 'signature': 'def run(self, a)'}, {'line': 5 + n, 'end_line': 5 + n, 'depth': 0, 'kind': 'function', 'name': 'top', 'signature': 'def top()'}]
    WHEN 'typescript' THEN [{'line': 2 + n, 'end_line': 4 + n, 'depth': 0, 'kind': 'class', 'name': 'S' || doc_id, 'signature': 'export class S' || doc_id}, {'line': 3 + n, 'end_line': 3 + n, 'depth': 1, 'kind': 'method', 'name': 'get', 'signature': 'get(k: string)'}]
    WHEN 'go' THEN [{'line': 2, 'end_line': 4 + n, 'depth': 0, 'kind': 'struct', 'name': 'T' || doc_id, 'signature': 'type T' || doc_id || ' struct'}, {'line': 5 + n, 'end_line': 5 + n, 'depth': 0, 'kind': 'function', 'name': 'Run', 'signature': 'func (t T) Run()'}]
    WHEN 'rust' THEN [{'line': 1, 'end_line': 3 + n, 'depth': 0, 'kind': 'impl', 'name': 'T' || doc_id, 'signature': 'impl T' || doc_id}, {'line': 2 + n, 'end_line': 2 + n, 'depth': 1, 'kind': 'function', 'name': 'go', 'signature': 'fn go(&self)'}]
    WHEN 'java' THEN [{'line': 1, 'end_line': 3 + n, 'depth': 0, 'kind': 'class', 'name': 'J' || doc_id, 'signature': 'class J' || doc_id}, {'line': 2 + n, 'end_line': 2 + n, 'depth': 1, 'kind': 'method', 'name': 'get', 'signature': 'int get(int a)'}]
    ELSE [{'line': 1, 'end_line': 1 + n, 'depth': 0, 'kind': 'function', 'name': 'f' || doc_id, 'signature': 'static int f' || doc_id || '(int a)'}] END, recursive := true) FROM modules))"""


@query("source_scanned_outlines", ctes("modules") + f", {SCANNED} SELECT path, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, CAST(depth AS INTEGER) AS depth, kind, name, signature FROM d")
def source_scanned_outlines(spark, d):
    """Definitions with their first and last lines, however long the comments and strings in them."""
    return O.outlines(view(spark, d, "modules"))


@query("source_outlines_in_lines", ctes("modules") + f", {SCANNED} SELECT path, string_agg(repeat('    ', CAST(depth AS INTEGER)) || signature, chr(10) ORDER BY line, depth, signature) AS outline FROM d GROUP BY path")
def source_outlines_in_lines(spark, d):
    """A file's signatures in lines."""
    return O.source_outlines(view(spark, d, "modules"))
