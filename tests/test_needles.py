"""Needles, keywords and globs in texts against loops over all pairs."""

import fnmatch
import itertools
import random
import re
from pathlib import PurePosixPath

import pytest

from tracewell.operators import needles as N

TEXTS = ["", "a", "abc", "src/app/main.py", "src/app/main_test.py", "lib/x.ts", "lib/[x].ts", "a\\b.c", "The C++ code, or c", "für alle", "foo_bar foo", "x" * 3000 + "needle" + "y" * 3000, "\\E\\Q", "line\nnext.py", "-", "]", "ab]c", None]
GLOBS = ["*", "", "?", "*.py", "src/*", "src/*/main*.py", "[xl]ib/*", "lib/[!a-w].ts", "lib/[[]x].ts", "*[]]*", "[", "*[", "a\\b.*", "*\\E*", "????", "**", "*needle*", "[z-a]*", "line?next.py", "[!]-]", "*.PY", "src/app/main.py", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t, k % 2, "x") for k, t in enumerate(TEXTS + TEXTS[:5])], "text string, g int, tid string")


def test_globs(spark, texts):
    globs = spark.createDataFrame([(g, k % 2, "y") for k, g in enumerate(GLOBS + GLOBS[1:6])], "glob string, g int, gram string")
    want = {(t, g) for t, g in itertools.product(TEXTS, GLOBS) if t is not None and g is not None and fnmatch.fnmatchcase(t, g)}
    assert {tuple(r) for r in N.glob_hits(texts, globs).collect()} == want
    groups = [(k % 2, t) for k, t in enumerate(TEXTS + TEXTS[:5])], [(k % 2, g) for k, g in enumerate(GLOBS + GLOBS[1:6])]
    want = {(a, t, g) for (a, t), (b, g) in itertools.product(*groups) if a == b and (t, g) in want}
    assert {tuple(r) for r in N.glob_hits(texts, globs, ["g"]).collect()} == want
    assert N.glob_hits(texts, globs.limit(0)).count() == N.glob_hits(texts.limit(0), globs).count() == N.glob_hits(texts, globs.limit(0), ["g"]).count() == 0


def test_read_files(spark):
    r = random.Random(4)
    paths = [f"{r.choice(['src', 'lib', 'a/b'])}/{r.choice('xyz')}{r.randrange(12)}.{r.choice(['py', 'ts'])}" for _ in range(60)]
    globs = ["src/x*", "other/[xy]1?.py", "*.ts/", "z?.*", "lib/y3.py"]
    reads = paths[:3]
    p, rd, g = (spark.createDataFrame([(x,) for x in rows], f"{c} string") for rows, c in ((paths, "path"), (reads, "path"), (globs, "glob")))
    want = {x for x in paths if x in reads or any(fnmatch.fnmatchcase(x, y) or fnmatch.fnmatchcase(PurePosixPath(x).name, PurePosixPath(y).name) for y in globs)}
    assert {x.path for x in N.read_files(p, rd, g).collect()} == want


def test_keywords(spark, texts):
    words = ["c", "c++", "foo", "foo_bar", "r", "für", "alle", "main", "main.py", "needle", "", None, "abc", "code", ", or", "\\E", "app/main"]
    k = spark.createDataFrame([(w, "z") for w in words], "keyword string, core string")
    want = {(t, w) for t, w in itertools.product(TEXTS, words) if t is not None and w and (re.search(rf"\b{re.escape(w)}\b", t) if len(w) <= 4 else w in t)}
    assert {tuple(r) for r in N.keyword_hits(texts, k).collect()} == want
    files = spark.createDataFrame([("one", "MAIN"), ("one", "code"), ("two", "Foo"), ("three", "absent")], "file string, keyword string")
    prompts = spark.createDataFrame([("Main code",), ("FOO",), (None,)], "prompt string")
    assert {tuple(r) for r in N.activated(prompts, files).collect()} == {("Main code", "one"), ("FOO", "two")}


def test_no_nested_loop_and_linear(spark):
    """A hundred thousand keywords are looked up, not tried one by one."""
    texts = spark.range(2000).selectExpr("concat('text about word', id * 37 % 100000, ' and word', id * 101 % 100000, 'x') AS text")
    words = spark.range(100_000).selectExpr("concat('word', id) AS keyword")
    found = N.keyword_hits(texts, words)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    want = sum(1 for k in range(2000) for n in {str(k * 37 % 100000)[: j + 1] for j in range(5)} | {str(k * 101 % 100000)[: j + 1] for j in range(5)} if n and (n == "0" or n[0] != "0"))
    assert found.count() == want


def test_unread_edits(spark):
    calls = [("s", 1, "Edit", "a/b.py"), ("s", 2, "Glob", "*.py"), ("s", 3, "Edit", "a/b.py"), ("s", 4, "Edit", "c.ts"), ("s", 5, "Read", "c.ts"), ("s", 6, "Edit", "c.ts"), ("t", 7, "Edit", "c.ts"), ("t", 8, "Glob", "x/[cd].ts"), ("t", 9, "Edit", "c.ts")]
    df = spark.createDataFrame(calls, "session_id string, pos long, tool string, path string")
    assert sorted(tuple(r) for r in N.unread_edits(df).collect()) == [("s", 1, "a/b.py"), ("s", 4, "c.ts"), ("t", 7, "c.ts")]


def test_files_of_prompts(spark):
    """Every keyword of each length against a loop; hits move as numbers, without their texts, whatever pieces the keywords share."""
    r = random.Random(6)
    texts = [t for t in TEXTS if t] + ["".join(r.choice("ab c+.\u00fc_") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    keywords = {(f"f{r.randrange(150)}", t[i : i + n]) for t in texts for n in (1, 2, 3, 4, 5, 7, 12, 13, 30) for i in [r.randrange(len(t))]} | {("f1", "X" * 13), ("f2", "\u00dcR"), ("f3", ""), (None, "code"), ("f4", None)}
    want = {(t, f) for t in texts for f, w in keywords if w and (re.search(rf"\b{re.escape(w.lower())}\b", t.lower()) if len(w) <= 4 else w.lower() in t.lower())}
    k = spark.createDataFrame(sorted(keywords, key=str), "file string, keyword string")
    got = [tuple(x) for x in N.activated(spark.createDataFrame([(t,) for t in texts + texts[:3]], "prompt string"), k).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hits_move_without_their_texts(spark):
    """Prompts are not shuffled by their text, and hits carry a number instead."""
    prompts = spark.range(300).selectExpr("concat('prompt of abcdefgh ', id) AS prompt")
    keywords = spark.range(400).selectExpr("concat('file', id) AS file", "substring('abcdefgh', 1 + CAST(id % 2 AS INT), 5) AS keyword")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.activated(prompts, keywords).groupBy("file").count()
        assert found.where("count = 300").count() == 400
        assert "hashpartitioning(text" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
