"""The logical tables of the library over the driver's tables: one text for both engines.

Operators know only the logical columns; these views give them rows on tables that were not made for them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

#: name -> SQL over {table} names; understood by Spark and DuckDB alike.
VIEWS = {
    # one record for each model call
    "usage": f"""
SELECT ts, CAST(event_id AS STRING) AS request_id, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
  'proj' || CAST(user_id % 10 AS STRING) AS project, 'branch' || CAST({K} % 7 AS STRING) AS git_branch,
  CASE event_type WHEN 'click' THEN 'opus-4-6' WHEN 'view' THEN 'sonnet-4-5' WHEN 'purchase' THEN 'haiku-4-5' WHEN 'signup' THEN 'opus-4-1' ELSE 'unlisted' END AS model,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, {K} * 3 + 10 AS output_tokens,
  CASE WHEN {K} % 3 = 0 THEN 0 ELSE {K} * 2 END AS cache_creation_5m_tokens, CASE WHEN {K} % 3 = 0 THEN 0 ELSE {K} % 7 END AS cache_creation_1h_tokens,
  {K} * 2 + {K} % 7 AS cache_creation_tokens, {K} * 50 AS cache_read_tokens
FROM {{events}}""",
    # one file access in a session; turn counts the accesses' quarter hours of a day
    "accesses": f"""
SELECT event_id AS pos, ts, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, user_id, 'proj' || CAST(user_id % 10 AS STRING) AS project,
  CAST(extract(hour FROM ts) * 4 + floor(extract(minute FROM ts) / 15) AS INT) AS turn,
  CASE event_type WHEN 'click' THEN 'Edit' WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Bash' WHEN 'signup' THEN 'Compact' ELSE 'Error' END AS tool,
  'mod' || CAST({K} % 10 AS STRING) || '/file_' || CAST({K} AS STRING) || CASE {K} % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.ts' END AS path, {K} AS k, value
FROM {{events}}""",
    # one turn for each user and week: files injected and used
    "baskets": f"""
SELECT DISTINCT user_id AS turn_id, 'proj' || CAST(user_id % 3 AS STRING) AS project, 'file_' || CAST({K} AS STRING) AS path FROM {{events}}""",
    # files of a turn in the order in which they were injected
    "injections": f"""
SELECT user_id AS turn_id, 'proj' || CAST(user_id % 3 AS STRING) AS project, 'file_' || CAST({K} % 12 AS STRING) AS path, min(event_id) AS seen FROM {{events}} GROUP BY 1, 2, 3""",
    "prompts": """
SELECT conv_id AS session_id, turn, text AS prompt FROM {conversations} WHERE role = 'user'""",
    # turn records with what was injected and used
    "turns": f"""
SELECT event_id AS turn_id, ts, 'proj' || CAST(user_id % 10 AS STRING) AS project, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
  event_type = 'error' AS was_notification, CAST(floor(value * 37) AS BIGINT) AS injection_chars, {K} * 120 AS total_context_chars, {K} * 35 AS total_context_tokens,
  CASE WHEN {K} % 5 = 0 THEN -1.0 ELSE ({K} % 100) / 100.0 END AS waste_ratio, CAST({K} % 6 AS INT) AS hot_count, CAST({K} % 11 AS INT) AS warm_count, 'file_' || CAST({K} AS STRING) AS injected, 'file_' || CAST({K} - {K} % 2 AS STRING) AS used, ({K} % 10) / 10.0 AS confidence
FROM {{events}}""",
    "corpus": """
SELECT doc_id, source || '/' || lang || '/doc_' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.txt' END AS path, text AS content, lang AS doc_type FROM {documents}""",
    # directed edges between files: accesses that follow one another in a session
    "edges": f"""
SELECT DISTINCT src, dst FROM (SELECT 'file_' || CAST({K} AS STRING) AS src, 'file_' || CAST(lead({K}) OVER (PARTITION BY user_id ORDER BY event_id) AS STRING) AS dst FROM {{events}}) AS pairs WHERE dst IS NOT NULL AND src <> dst""",
    # commits: the parts that one order's items name
    "commits": """
SELECT DISTINCT l_orderkey AS commit_idx, 'part_' || CAST(l_partkey % 50 AS STRING) AS path FROM {lineitem}""",
    # one session of an experiment
    "experiment": f"""
SELECT CAST(user_id AS STRING) AS session_id, CASE user_id % 3 WHEN 0 THEN 'treated' WHEN 1 THEN 'baseline' ELSE 'observed' END AS grp, count(*) AS turns, sum({K} * 10 + 5) AS units, count(DISTINCT CAST(ts AS DATE)) AS windows, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS compactions, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS repeats
FROM {{events}} GROUP BY user_id""",
    "observations": """
SELECT doc_id AS id, source AS session_id, text AS summary, n_chars AS tokens, doc_id * 10 AS ts, lang AS kind FROM {documents}""",
    # a source file for each document, which imports and calls others
    "code": """
SELECT doc_id, 'pkg' || CAST(doc_id % 9 AS STRING) || '/file_' || CAST(doc_id AS STRING) || '.py' AS path,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE '# about ' || source || chr(10) END || 'from pkg' || CAST((doc_id - doc_id % 10) % 9 AS STRING) || '.file_' || CAST(doc_id - doc_id % 10 AS STRING) || ' import run_' || CAST(doc_id % 10 AS STRING) || chr(10) || 'import os' || chr(10)
  || 'class Box' || CAST(doc_id % 13 AS STRING) || '(Base' || CAST(doc_id % 3 AS STRING) || '):' || chr(10) || '    pass' || chr(10) || 'def run_' || CAST(doc_id % 10 AS STRING) || '(a, b):' || chr(10) || '    return job_' || CAST(doc_id - doc_id % 10 AS STRING) || '(a)' || chr(10) || 'async def job_' || CAST(doc_id AS STRING) || '():' || chr(10) || '    print(1)' || chr(10) AS content
FROM {documents}""",
    # source files of five languages, which import, call and define
    "sources": """
SELECT doc_id, path, language, CASE language
  WHEN 'python' THEN 'from ..pkg' || CAST(t % 9 AS STRING) || '.file_' || CAST(t AS STRING) || ' import run' || chr(10) || 'import os.path' || chr(10) || 'class Box_' || CAST(doc_id AS STRING) || '(Base_' || CAST(t AS STRING) || '):' || chr(10) || 'async def run_' || CAST(doc_id AS STRING) || '(first_parameter, second_parameter, third_parameter, more):' || chr(10) || '    return run_' || CAST(t AS STRING) || '(len(1))'
  WHEN 'typescript' THEN 'import x from ' || chr(39) || '../pkg' || CAST(t % 9 AS STRING) || '/file_' || CAST(t AS STRING) || '.js' || chr(39) || chr(10) || 'export async function run_' || CAST(doc_id AS STRING) || '(a)' || chr(10) || 'const arrow_' || CAST(doc_id AS STRING) || ' = async (a) => 1' || chr(10) || 'app.use(requireAuth, run_' || CAST(t AS STRING) || ')' || chr(10) || 'preHandler: [verifyJwt, Map]'
  WHEN 'javascript' THEN 'import React from "react"' || chr(10) || 'export * from "../pkg' || CAST(t % 9 AS STRING) || '/file_' || CAST(t AS STRING) || '"' || chr(10) || 'export class Js_' || CAST(doc_id AS STRING) || ' extends Js_' || CAST(t AS STRING)
  WHEN 'go' THEN 'import (' || chr(10) || '  "fmt"' || chr(10) || '  "example.org/x/pkg' || CAST(t % 9 AS STRING) || '"' || chr(10) || ')' || chr(10) || 'type T_' || CAST(doc_id AS STRING) || ' struct' || chr(10) || 'func (s *S) Run_' || CAST(doc_id AS STRING) || '()'
  ELSE 'import ' || chr(39) || 'package:app/svc/file_' || CAST(t AS STRING) || '.dart' || chr(39) || ';' || chr(10) || 'import ' || chr(39) || 'dart:io' || chr(39) || ';' || chr(10) || 'abstract class W_' || CAST(doc_id AS STRING) || '' || chr(10) || '  Future<int> load_' || CAST(doc_id AS STRING) || '()' || chr(10) || '  void print(int a)' END AS content, t
FROM (SELECT doc_id, (doc_id - 5 * (CAST(floor(doc_id / 5) AS BIGINT) % 3)) AS t, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' WHEN 3 THEN 'go' ELSE 'dart' END AS language,
  CASE WHEN doc_id % 5 = 4 THEN 'apps/a' || CAST(doc_id % 3 AS STRING) || '/lib/svc' ELSE 'pkg' || CAST(doc_id % 9 AS STRING) END || '/file_' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' WHEN 3 THEN '.go' ELSE '.dart' END AS path FROM {documents}) AS s""",
    # modules of six languages that hold a document's text in a comment or string; n counts its lines' ends
    "modules": """
SELECT doc_id, 'm/' || CAST(doc_id AS STRING) AS path, language, n, CASE language
  WHEN 'python' THEN 'class C' || CAST(doc_id AS STRING) || ':' || chr(10) || '    ""' || '"' || t || '""' || '"' || chr(10) || '    def run(self, a):' || chr(10) || '        return ' || chr(123) || '"x": "def no():"' || chr(125) || '' || chr(10) || 'def top(): pass'
  WHEN 'typescript' THEN '/* ' || t || ' */' || chr(10) || 'export class S' || CAST(doc_id AS STRING) || ' ' || chr(123) || '' || chr(10) || '  get(k: string) ' || chr(123) || ' return `' || chr(125) || '` ' || chr(125) || '' || chr(10) || '' || chr(125) || ''
  WHEN 'go' THEN '// x ' || chr(123) || '' || chr(10) || 'type T' || CAST(doc_id AS STRING) || ' struct ' || chr(123) || '' || chr(10) || '  v int /* ' || t || ' */' || chr(10) || '' || chr(125) || '' || chr(10) || 'func (t T) Run() ' || chr(123) || '' || chr(125) || ''
  WHEN 'rust' THEN 'impl T' || CAST(doc_id AS STRING) || ' ' || chr(123) || ' /* ' || t || ' */' || chr(10) || '  fn go(&self) ' || chr(123) || ' ' || chr(125) || '' || chr(10) || '' || chr(125) || ''
  WHEN 'java' THEN 'class J' || CAST(doc_id AS STRING) || ' ' || chr(123) || ' String s; /* ' || t || ' */' || chr(10) || '  int get(int a) ' || chr(123) || ' return 1; ' || chr(125) || '' || chr(10) || '' || chr(125) || ''
  ELSE 'static int f' || CAST(doc_id AS STRING) || '(int a) ' || chr(123) || ' /* ' || t || ' */ return 0; ' || chr(125) || '' END AS content
FROM (SELECT doc_id, t, length(t) - length(replace(t, chr(10), '')) AS n, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' WHEN 4 THEN 'java' ELSE 'c' END AS language FROM (SELECT doc_id, replace(replace(coalesce(text, ''), '"', ''), '*/', '') AS t FROM {documents}) AS q) AS s""",
    # a page of notes for each document
    "pages_md": """
SELECT doc_id, source || '/my-note_' || CAST(doc_id AS STRING) || '.md' AS path,
  '# Title of ' || source || chr(10) || 'first line' || chr(10) || chr(10) || 'second line' || chr(10) || 'third line' || chr(10) || '## Keywords' || chr(10) || 'alpha, beta' || CAST(doc_id % 6 AS STRING) || chr(10) || '### Deep-part ' || lang || chr(10) || '- point **Strong term** `mod' || CAST(doc_id % 10 AS STRING) || '/file_' || CAST(doc_id % 100 AS STRING) || '.py`' || chr(10) || '**Location**: `src/x y.ts`' || chr(10) || 'plain' || chr(10) || '* star `tick_word`' || chr(10) || text AS content
FROM {documents}""",
}
TABLES = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table; only the columns that a query uses are read."""
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(TABLES.findall(text))}
    return spark.sql(text, **tables)


def ctes(*names: str) -> str:
    """The same tables for the SQL of a query."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES.sub(lambda m: m[1], VIEWS[n])})" for n in names)
