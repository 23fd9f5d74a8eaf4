"""Source files of several languages: values worked out by hand."""

from pyspark.sql import functions as F

from tracewell.functions import code as C

FILES = "path string, content string"


def files(spark, **rows):
    return spark.createDataFrame(list(rows.items()), FILES).withColumn("path", F.replace("path", F.lit("__"), F.lit("/"))).withColumn("path", F.regexp_replace("path", "_(py|ts|tsx|js|go|dart)$", ".$1")).withColumn("language", C.language(F.col("path")))


def edges(df):
    return sorted(tuple(r) for r in C.import_edges(df).collect())


def test_python_imports(spark):
    f = files(spark, a__b__x_py="from . import y, z as q, *\nfrom ..lib import w\nimport a.b.gone\nfrom ...far import v\n  import late", a__b__y_py="", a__b__z_py="import a.b.y", a__lib_py="", far_py="", late_py="", empty_py=None)
    assert edges(f) == [("a/b/x.py", "a/b/y.py"), ("a/b/x.py", "a/b/z.py"), ("a/b/x.py", "a/lib.py"), ("a/b/x.py", "far.py"), ("a/b/z.py", "a/b/y.py")]


def test_script_imports(spark):
    f = files(spark, src__a_ts="import { x } from '../lib/auth.js'\nexport * from './foo'\nimport y from 'react'\nimport './a'", lib__auth_ts="", lib__auth_js="", src__foo__index_tsx="")
    assert edges(f) == [("src/a.ts", "lib/auth.ts"), ("src/a.ts", "src/foo/index.tsx")]


def test_go_and_dart_imports(spark):
    go = {f"internal__auth__f{k}_go": "" for k in range(7)}
    f = files(spark, main_go='import (\n\t"fmt"\n\t"host/org/internal/auth"\n)\nfunc main() {}\nvar s = "other"', other__o_go='import "x/other"', app__lib__s__t_dart="import 'package:app/s/u.dart';\nimport 'dart:io';\nimport '../v.dart';", app__lib__s__u_dart="", app__lib__v_dart="", **go)
    assert edges(f) == [("app/lib/s/t.dart", "app/lib/s/u.dart"), ("app/lib/s/t.dart", "app/lib/v.dart")] + [("main.go", f"internal/auth/f{k}.go") for k in range(5)]


def test_symbols(spark):
    f = files(spark, a_py="async def f(a, b):\n  def inner():\nclass C(B):", b_ts="export async function g(\n  const h = async (x) => 1\nexport class D", c_go="import (\nfunc hidden()\n)\nfunc (s *S) Run() {\ntype T interface {", d_dart="abstract class W {\n  Future<int> fetch()\n  void print(int a)")
    got = {(r.path, r.line, r.kind, r.name, r.signature) for r in C.symbols(f).collect()}
    assert got == {("a.py", 0, "function", "f", "def f(a, b):"), ("a.py", 2, "class", "C", "class C:"), ("b.ts", 0, "function", "g", "function g()"), ("b.ts", 1, "function", "h", "const h = () =>"), ("b.ts", 2, "class", "D", "class D"), ("c.go", 3, "function", "Run", "func Run()"), ("c.go", 4, "interface", "T", "type T interface"), ("d.dart", 0, "class", "W", "class W"), ("d.dart", 1, "function", "fetch", "fetch()")}


def test_references(spark):
    text = "app.use(requireAuth, len)\nrouter.get('/x', requireRole)\npreHandler: [verifyJwt, Map]\nclass A(Base):\nclass X extends Y1z {\nfoo(1)"
    row = spark.createDataFrame([(text,)], "t string").select(C.references(F.col("t"), F.lit("python")).alias("p"), C.references(F.col("t"), F.lit("tsx")).alias("s")).first()
    assert row.s == ["Y1z", "foo", "requireAuth", "requireRole", "verifyJwt"]
    assert set(row.p) - set(row.s) == {"Base"}


def test_scores(spark):
    f = files(spark, a_py="def _run_Job():", b_py="", c_py="")
    ranks = spark.createDataFrame([("b.py", 0.5)], "path string, rank double")
    got = dict(C.file_scores(f, ranks, spark.createDataFrame([("a.py", "b.py")], "src string, dst string"), ["a.py"], "the job of C").collect())
    # a: 0.1 + 10, the letter a is no part of the query; parts '', 'job', 'job'. b: rank, neighbour. c: its name
    assert got == {"a.py": 13.1, "b.py": 9.5, "c.py": 5.1}


def test_fingerprint(spark):
    text = '#!/usr/bin/python\n""""""\n  """Signs users in."""\nimport json\nfrom a.b import Thing\nimport numpy as np\nclass AuthHandler:\n    def update_attention(self):\n    def _hidden(self):\n        def nested():\ndef run():'
    rows = [(text, '#  First words #\n"""not this"""', None)]
    row = spark.createDataFrame(rows, "a string, b string, c string").select(*[C.fingerprint(F.col(k)).alias(k) for k in "abc"]).first()
    assert row.a == "Signs users in. AuthHandler auth handler update_attention update attention run run Thing numpy"
    assert (row.b, row.c) == ("First words #", "")
