"""Queries of functions on prompts, texts and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import caps as CP
from ..functions import text as T
from ..functions import words as W
from ..operators import needles as N
from .registry import query
from .views import ctes, view

STOP = ", ".join(f"'{w}'" for w in W.STOP_WORDS)
INGEST = ", ".join(f"'{w}'" for w in W.INGEST_STOP_WORDS)
CONT = ", ".join(f"'{w}'" for w in W.CONTINUATION_WORDS)


def prompts(spark, d):
    return view(spark, d, "prompts")


def corpus(spark, d):
    return view(spark, d, "corpus")


def accesses(spark, d):
    return view(spark, d, "accesses")


def words_sql(col: str, stop: str, pattern: str = "[a-z][a-z0-9_-]{2,}") -> str:
    return f"list_filter(regexp_extract_all(lower({col}), '{pattern}'), lambda w: w NOT IN ({stop}))"


@query("text_prompt_words", ctes("prompts") + f" SELECT session_id, turn, array_to_string({words_sql('prompt', STOP)}, ' ') AS words FROM prompts")
def text_prompt_words(spark, d):
    return prompts(spark, d).select("session_id", "turn", F.array_join(T.prompt_words(F.col("prompt")), " ").alias("words"))


@query("text_keywords", ctes("prompts") + f" SELECT session_id, turn, array_to_string({words_sql('prompt', INGEST)}, ' ') AS words FROM prompts")
def text_keywords(spark, d):
    return prompts(spark, d).select("session_id", "turn", F.array_join(T.keywords(F.col("prompt")), " ").alias("words"))


@query("text_index_tokens", ctes("corpus") + " SELECT doc_id, len(regexp_extract_all(lower(content), '[a-z][a-z0-9_]{2,}')) AS n, len(list_distinct(regexp_extract_all(lower(content), '[a-z][a-z0-9_]{2,}'))) AS n_distinct FROM corpus")
def text_index_tokens(spark, d):
    return corpus(spark, d).withColumn("t", T.index_tokens(F.col("content"))).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("text_path_parts", ctes("accesses") + r""", p AS (SELECT DISTINCT path FROM accesses), q AS (SELECT path, string_split(path, '/')[-1] AS base FROM p), t AS (SELECT *, regexp_replace(base, '\.[^.]*$', '') AS stem, list_filter(regexp_split_to_array(lower(path), '[/\\._-]'), lambda x: length(x) >= 2) AS parts FROM q)
SELECT path, base, stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(base, '\.([^.]+)$', 1) AS ext, regexp_extract(base, '\.([^.]+)$', 1) IN ('py', 'js', 'ts', 'tsx', 'jsx', 'go', 'rs', 'java', 'c', 'cpp', 'rb') AS is_source,
array_to_string(CASE WHEN list_contains(parts, stem) THEN parts ELSE list_append(parts, stem) END, ' ') AS tokens FROM t""")
def text_path_parts(spark, d):
    p = F.col("path")
    return accesses(spark, d).select("path").distinct().select("path", T.basename(p).alias("base"), T.stem(p).alias("stem"), T.directory(p).alias("dir"), T.extension(p).alias("ext"), T.is_source(p).alias("is_source"), F.array_join(T.path_tokens(p), " ").alias("tokens"))


@query("text_file_references", r"""SELECT page_id, array_to_string(list_concat(regexp_extract_all(url, '[\w./\\-]+\.(?:py|js|ts|tsx|jsx|go|rs|java|c|cpp|h|rb|php|swift|kt|md|json|yaml|yml|toml)'), regexp_extract_all(url, '\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b')), ' ') AS refs FROM pages""")
def text_file_references(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.array_join(T.file_references(F.col("url")), " ").alias("refs"))


@query("text_keyword_matches", ctes("prompts") + r", k(keyword) AS (VALUES ('the'), ('and'), ('ation'), ('eresh')) SELECT keyword, count(*) AS n FROM k JOIN prompts ON CASE WHEN length(keyword) <= 4 THEN regexp_matches(lower(prompt), '\b' || keyword || '\b') ELSE contains(lower(prompt), keyword) END GROUP BY keyword")
def text_keyword_matches(spark, d):
    """Each keyword is looked up by its rarest piece; equal prompts are looked at once and counted each."""
    k = spark.createDataFrame([("the",), ("and",), ("ation",), ("eresh",)], "keyword string")
    low = prompts(spark, d).select(F.lower("prompt").alias("text"))
    return N.keyword_hits(low, k).join(low.groupBy("text").agg(F.count("*").alias("m")), "text").groupBy("keyword").agg(F.sum("m").alias("n"))


# the files' keywords: beginnings of their sources' words
FILE_WORDS = "fw AS (SELECT DISTINCT 'file_' || CAST(doc_id % 50 AS VARCHAR) AS file, substr(w, 1, CAST(2 + doc_id % 9 AS INT)) AS keyword FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents))"


@query("text_files_by_keywords", ctes("prompts") + f""", {FILE_WORDS}, lp AS (SELECT DISTINCT prompt, lower(prompt) AS p FROM prompts),
tok AS (SELECT DISTINCT prompt, unnest(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM lp), sub AS (SELECT DISTINCT prompt, substr(p, i, n) AS keyword FROM (SELECT prompt, p, unnest(range(1, length(p) + 1)) AS i FROM lp), range(5, 11) t(n) WHERE i + n - 1 <= length(p)),
hit AS (SELECT prompt, file FROM tok JOIN fw USING (keyword) WHERE length(keyword) <= 4 UNION SELECT prompt, file FROM sub JOIN fw USING (keyword)) SELECT file, count(*) AS prompts FROM hit GROUP BY file""")
def text_files_by_keywords(spark, d):
    """Files by the prompts that one of their keywords activates: all words of the corpus as keywords, without a loop over them."""
    w = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w"))
    words = w.select(F.concat(F.lit("file_"), (F.col("doc_id") % 50).cast("string")).alias("file"), F.expr("substring(w, 1, CAST(2 + doc_id % 9 AS INT))").alias("keyword"))
    return N.files_of(N.numbered(prompts(spark, d)), words).groupBy("file").agg(F.count("*").alias("prompts"))


@query("text_without_tags", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<nav>.*?</nav>', '', 'gs'), '<style>.*?</style>', '', 'gs'))) AS n FROM pages")
def text_without_tags(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.length(T.without_tags(F.col("html"), ["nav", "style"])).cast("long").alias("n"))


@query("text_backtick_references", r"SELECT doc_id, len(list_filter(regexp_extract_all(content, '`([^`\n]+)`', 1), lambda r: length(r) >= 3 AND NOT starts_with(r, '-') AND NOT starts_with(r, '$') AND (NOT contains(r, ' ') OR contains(r, '/')))) AS n FROM (" + ctes("corpus") + " SELECT * FROM corpus)")
def text_backtick_references(spark, d):
    return corpus(spark, d).select("doc_id", F.size(T.backtick_references(F.col("content"))).cast("long").alias("n"))


@query("text_continuations", ctes("prompts") + rf", b AS (SELECT session_id, turn, regexp_replace(trim(prompt), '[.!?,]+$', '') AS p FROM prompts), w AS (SELECT *, list_distinct(regexp_extract_all(lower(p), '[a-z]+')) AS ws FROM b) SELECT session_id, turn, length(p) <= 60 AND (len(ws) = 0 OR len(list_filter(ws, lambda x: x IN ({CONT}))) / len(ws) >= 0.5) AS continuation FROM w")
def text_continuations(spark, d):
    return prompts(spark, d).select("session_id", "turn", T.is_continuation(F.col("prompt")).alias("continuation"))


@query("text_effective_prompts", ctes("prompts") + rf""", b AS (SELECT session_id, turn, prompt, regexp_replace(trim(prompt), '[.!?,]+$', '') AS p FROM prompts), w AS (SELECT *, list_distinct(regexp_extract_all(lower(p), '[a-z]+')) AS ws FROM b),
c AS (SELECT session_id, turn, prompt, length(p) <= 60 AND (len(ws) = 0 OR len(list_filter(ws, lambda x: x IN ({CONT}))) / len(ws) >= 0.5) AS cont FROM w),
h AS (SELECT *, list(CASE WHEN NOT cont AND length(prompt) > 20 THEN prompt END) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM c), g AS (SELECT *, list_filter(before, lambda x: x IS NOT NULL) AS good FROM h)
SELECT session_id, turn, md5(CASE WHEN cont AND len(good) > 0 THEN array_to_string(good[-2:], ' ') || ' ' || prompt ELSE prompt END) AS prompt_md5 FROM g""")
def text_effective_prompts(spark, d):
    """A continuation is led by up to two substantial prompts of the three before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-3, -1)
    p = prompts(spark, d).withColumn("cont", T.is_continuation(F.col("prompt")))
    p = p.withColumn("good", F.collect_list(F.when(~F.col("cont") & (F.length("prompt") > 20), F.col("prompt"))).over(w))
    lead = F.array_join(F.slice("good", F.greatest(F.size("good") - 1, F.lit(1)), 2), " ")
    return p.select("session_id", "turn", F.md5(F.when(F.col("cont") & (F.size("good") > 0), F.concat_ws(" ", lead, "prompt")).otherwise(F.col("prompt"))).alias("prompt_md5"))


def task_sql() -> str:
    sums = [" + ".join(rf"CAST(regexp_matches(lower(content), '\b{w}\b') AS INT)" for w in ws) for ws in W.TASK_WORDS.values()]
    names = list(W.TASK_WORDS)
    cols = ", ".join(f"{s} AS n{k}" for k, s in enumerate(sums))
    top = "greatest(" + ", ".join(f"n{k}" for k in range(len(names))) + ")"
    return f"SELECT doc_id, CASE WHEN {top} = 0 THEN 'exploration' " + " ".join(f"WHEN n{k} = {top} THEN '{n}'" for k, n in enumerate(names)) + f" END AS task FROM (SELECT doc_id, {cols} FROM corpus)"


def task_sums() -> str:
    return ", ".join(" + ".join(rf"CAST(regexp_matches(lower(content), '\b{w}\b') AS INT)" for w in ws) + f" AS n_{n}" for n, ws in W.TASK_WORDS.items())


TASK_ROWS = ", ".join("{" + f"'name': '{n}', 'n': n_{n}" + {"config": " + settings", "review": " + tests"}.get(n, "") + ", 'place': " + (f"CASE WHEN n_review = 0 THEN 99 ELSE {k} END" if n == "review" else str(k)) + "}" for k, n in enumerate(W.TASK_WORDS))


@query("text_task_types", ctes("corpus") + " " + task_sql())
def text_task_types(spark, d):
    return corpus(spark, d).select("doc_id", T.task_type(F.col("content")).alias("task"))


@query("text_task_types_with_files", ctes("corpus") + r""", t AS (SELECT doc_id, {sums}, CASE doc_id % 4 WHEN 0 THEN 2 ELSE 0 END AS settings, CASE WHEN doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END AS tests FROM corpus), u AS (SELECT doc_id, unnest([{rows}], recursive := true) FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) AS k FROM u) SELECT doc_id, CASE WHEN n = 0 THEN 'exploration' ELSE name END AS task FROM r WHERE k = 1""".format(sums=task_sums(), rows=TASK_ROWS))
def text_task_types_with_files(spark, d):
    files = F.expr("CASE doc_id % 4 WHEN 0 THEN array('a/x.yaml', 'b.py') WHEN 1 THEN array('a/x.test.ts') WHEN 2 THEN array('y_test.py', '.json') END")
    return corpus(spark, d).select("doc_id", T.task_type(F.col("content"), files).alias("task"))


@query("text_intents", ctes("corpus") + " SELECT doc_id, concat_ws(' ', " + ", ".join(rf"CASE WHEN regexp_matches(lower(content), '(^|[^\pL\pN_])(?:{'|'.join(ws.split(' '))})($|[^\pL\pN_])') THEN '{n}' END" for n, ws in W.INTENT_WORDS.items()) + ") AS intents FROM corpus")
def text_intents(spark, d):
    return corpus(spark, d).select("doc_id", F.array_join(T.intents(F.col("content")), " ").alias("intents"))


@query("text_estimated_tokens", ctes("corpus") + r""", c AS (SELECT doc_id, content, length(content) AS n, length(regexp_replace(content, '[^{}\[\]();=<>|&!@#$%^*~`\\]', '', 'g')) AS code, length(regexp_replace(content, '[^#\-*_>]', '', 'g')) AS md, string_split(content, chr(10)) AS l FROM corpus),
f AS (SELECT *, least(1.0::DOUBLE, code / n * 10 + len(list_filter(l, lambda x: starts_with(x, '    ') OR starts_with(x, chr(9)))) / greatest(len(l) - 1, 1) * 0.5::DOUBLE) AS cf FROM c), g AS (SELECT *, least(1.0::DOUBLE - cf, md / n * 8) AS mf FROM f)
SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE greatest(1, CAST(floor(n / (cf * 2.5::DOUBLE + mf * 3.0::DOUBLE + (1.0::DOUBLE - cf - mf) * 4.0::DOUBLE)) AS BIGINT)) END AS tokens FROM g""")
def text_estimated_tokens(spark, d):
    return corpus(spark, d).select("doc_id", T.estimate_tokens(F.col("content")).alias("tokens"))


@query("text_tokens_from_chars", "SELECT doc_id, CAST(trunc(n_chars / 2.5::DOUBLE) AS BIGINT) AS code, CAST(trunc(n_chars / 4.0::DOUBLE) AS BIGINT) AS prose, CAST(trunc(n_chars / 3.0::DOUBLE) AS BIGINT) AS markdown, CAST(trunc(n_chars / 3.3::DOUBLE) AS BIGINT) AS mixed, CASE WHEN n_chars <= 6000 THEN n_chars ELSE 4240 END AS capped FROM documents")
def text_tokens_from_chars(spark, d):
    n = F.col("n_chars")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *[T.tokens_from_chars(n, k).alias(k) for k in T.CHARS_PER_TOKEN], T.capped_chars(n).alias("capped"))


@query("text_tiers", ctes("turns") + " SELECT turn_id, CASE WHEN confidence >= 0.8 THEN 'HOT' WHEN confidence >= 0.25 THEN 'WARM' WHEN confidence >= 0.15 THEN 'HINT' ELSE 'COLD' END AS tier FROM turns")
def text_tiers(spark, d):
    return view(spark, d, "turns").select("turn_id", T.tier(F.col("confidence")).alias("tier"))


@query("text_holdout_arms", ctes("accesses") + ", b AS (SELECT pos, CAST(('0x' || substr(sha256(session_id || chr(31) || path || chr(31) || CAST(turn AS VARCHAR)), 1, 8))::BIGINT % 100 AS INT) AS bucket FROM accesses) SELECT pos, bucket, CASE WHEN bucket < 10 THEN 'baseline' WHEN bucket < 13 THEN 'observed' ELSE 'treated' END AS arm FROM b")
def text_holdout_arms(spark, d):
    return accesses(spark, d).withColumn("bucket", T.bucket(F.col("session_id"), F.col("path"), F.col("turn").cast("string"))).select("pos", "bucket", T.holdout_arm(F.col("bucket")).alias("arm"))


@query("text_summaries", ctes("corpus") + " SELECT doc_id, md5(substr(array_to_string(string_split(content, chr(10))[1:5], ' '), 1, 500)) AS summary_md5, substr(sha256(content), 1, 16) AS content_hash FROM corpus")
def text_summaries(spark, d):
    c = F.col("content")
    return corpus(spark, d).select("doc_id", F.md5(T.summary(c)).alias("summary_md5"), F.substring(F.sha2(c, 256), 1, 16).alias("content_hash"))


@query("text_path_features", ctes("accesses") + r""", p AS (SELECT DISTINCT path, regexp_extract(path, '\.([^.]+)$', 1) AS ext FROM accesses) SELECT path, array_to_string([""" + ", ".join(f"CASE WHEN ext = '{e}' THEN 1.0 ELSE 0.0 END" for e in ("py", "js", "ts", "tsx", "go", "rs", "java", "md")) + r""", least(1.0, (len(string_split(path, '/')) - 1) / 8.0), CASE WHEN contains(path, 'test') THEN 1.0 ELSE 0.0 END, CASE WHEN regexp_matches(path, '(^|/)(__init__|index)[^/]*$') THEN 1.0 ELSE 0.0 END, CASE WHEN contains(path, 'config') OR contains(path, 'setting') THEN 1.0 ELSE 0.0 END]::DOUBLE[], ' ') AS features FROM p""")
def text_path_features(spark, d):
    return accesses(spark, d).select("path").distinct().select("path", F.array_join(F.transform(T.path_features(F.col("path")), lambda x: x.cast("string")), " ").alias("features"))


@query("text_outlines", ctes("corpus") + r", o AS (SELECT doc_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\s*(?:#+ |def |class |function |export |import |from )')) AS l FROM corpus) SELECT doc_id, len(l) AS n, md5(array_to_string(CASE WHEN len(l) <= 100 THEN l ELSE list_append(l[1:99], '... (' || CAST(len(l) - 99 AS VARCHAR) || ' more)') END, chr(10))) AS outline_md5 FROM o")
def text_outlines(spark, d):
    c = F.col("content")
    n = F.size(F.filter(F.split(c, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*(?:#+ |def |class |function |export |import |from )"))))
    return corpus(spark, d).select("doc_id", n.cast("long").alias("n"), F.md5(F.array_join(T.outline(c), "\n")).alias("outline_md5"))


@query("text_decay_rates", ctes("corpus") + " SELECT path, CASE WHEN starts_with(path, 'systems/') THEN 0.85::DOUBLE WHEN starts_with(path, 'modules/') THEN 0.7::DOUBLE WHEN starts_with(path, 'integrations/') THEN 0.8::DOUBLE WHEN starts_with(path, 'docs/') THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS rate FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'systems/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'integrations/' ELSE '' END || path AS path FROM corpus)")
def text_decay_rates(spark, d):
    p = F.expr("CASE doc_id % 4 WHEN 0 THEN 'systems/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'integrations/' ELSE '' END || path")
    return corpus(spark, d).select(p.alias("path")).select("path", T.decay_rate(F.col("path")).alias("rate"))


INPUTS = """ci AS (SELECT pos, session_id, k, CASE k % 9 WHEN 8 THEN 'Read' ELSE 'Bash' END AS tool, CASE k % 9 WHEN 0 THEN '{"command": "run ' || path || '"}' WHEN 1 THEN '{"command": "run", "run_in_background": true}' WHEN 2 THEN '{"command": "run # tracewell:full"}' WHEN 3 THEN '{"command": "trap x EXIT"}' WHEN 4 THEN '{"command": 7}' WHEN 5 THEN '[1]' WHEN 6 THEN '{"command": "  "}' WHEN 7 THEN '{"command": "strap", "note": "TraceWell:FULL", "run_in_background": false}' END AS input FROM accesses)"""


def inputs(spark, d):
    return accesses(spark, d).selectExpr("pos", "session_id", "k", "path", "CASE k % 9 WHEN 8 THEN 'Read' ELSE 'Bash' END AS tool", INPUTS[INPUTS.index("CASE k % 9 WHEN 0"):INPUTS.index(" AS input")] + " AS input")


@query("text_cap_refusals", ctes("accesses") + f", {INPUTS} SELECT pos, CASE k % 9 WHEN 8 THEN 'not the Bash tool' WHEN 1 THEN 'background command' WHEN 2 THEN 'the caller asked for the full output' WHEN 3 THEN 'the command sets its own trap' WHEN 4 THEN 'no command' WHEN 5 THEN 'no tool input' WHEN 6 THEN 'no command' END AS reason, coalesce(contains(lower(input), 'tracewell:full'), false) AS forced FROM ci")
def text_cap_refusals(spark, d):
    return inputs(spark, d).select("pos", CP.cap_refusal(F.col("tool"), F.col("input")).alias("reason"), CP.is_forced(F.col("input")).alias("forced"))


@query("text_cap_arms", ctes("accesses") + ", b AS (SELECT pos, CAST(('0x' || substr(sha256('tracewell-v1' || chr(31) || session_id || chr(31) || 'cap' || chr(31) || path), 1, 8))::BIGINT % 100 AS INT) AS bucket FROM accesses) SELECT pos, bucket, CASE WHEN bucket < 10 THEN 'held-out' ELSE 'cap' END AS arm FROM b")
def text_cap_arms(spark, d):
    return accesses(spark, d).select("pos", CP.cap_arm(F.col("session_id"), F.col("path")).alias("a")).select("pos", "a.*")


@query("text_read_keys", ctes("accesses") + ", a AS (SELECT pos, 'X/' || path AS p, CASE WHEN k % 3 = 0 THEN k END AS o, CASE WHEN k % 2 = 0 THEN k * 2 END AS l, session_id, CASE k % 3 WHEN 0 THEN 'a' || CAST(k AS VARCHAR) WHEN 1 THEN '' END AS agent FROM accesses) SELECT pos, md5(lower(p) || CASE WHEN coalesce(o, 0) <> 0 OR coalesce(l, 0) <> 0 THEN chr(31) || CAST(coalesce(o, 0) AS VARCHAR) || '-' || CAST(coalesce(l, 0) AS VARCHAR) ELSE '' END) AS key_md5, session_id || CASE WHEN coalesce(agent, '') <> '' THEN '.agent-' || agent ELSE '' END AS ledger FROM a")
def text_read_keys(spark, d):
    a = accesses(spark, d).selectExpr("pos", "'X/' || path AS p", "CASE WHEN k % 3 = 0 THEN k END AS o", "CASE WHEN k % 2 = 0 THEN k * 2 END AS l", "session_id", "CASE k % 3 WHEN 0 THEN 'a' || k WHEN 1 THEN '' END AS agent")
    return a.select("pos", F.md5(CP.read_key(F.col("p"), F.col("o"), F.col("l"))).alias("key_md5"), CP.ledger_id(F.col("session_id"), F.col("agent")).alias("ledger"))


@query("text_response_tokens", "SELECT doc_id, CAST(floor(CASE doc_id % 5 WHEN 0 THEN length(text) WHEN 1 THEN length(text) + length(source) WHEN 2 THEN length(text) WHEN 3 THEN length(text) + length(lang) ELSE 0 END / 2.5) AS BIGINT) AS tokens FROM documents")
def text_response_tokens(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    made = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.array("text"))).when(F.col("doc_id") % 5 == 1, F.to_json(F.struct(F.col("source").alias("content"), F.col("text").alias("stdout"), F.lit(3).alias("text")))).when(F.col("doc_id") % 5 == 2, F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("file")))).when(F.col("doc_id") % 5 == 3, F.to_json(F.array(F.struct("text"), F.struct(F.col("lang").alias("text"))))).otherwise("17")
    # a text by itself is what stands between the brackets of a list of one
    alone = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace(made, r"^\[|\]$", "")).otherwise(made)
    return docs.select("doc_id", CP.response_tokens(alone).alias("tokens"))
