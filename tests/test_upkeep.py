"""Upkeep and interchange: values worked out by hand."""

from pyspark.sql import functions as F

from tracewell.operators import interchange as I
from tracewell.operators import monitors as M
from tracewell.operators import upkeep as U
from tracewell.streaming import monitors as S


def test_leads_out(spark):
    rows = ["a/b", "../a", "a/../..", "a/../b", "/etc", "./a", "a/../../a/b", ""]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, p string")
    assert [r.o for r in df.orderBy("k").select(U.leads_out(F.col("p")).alias("o")).collect()] == [False, True, True, False, True, False, True, False]


def test_sweep_and_nudge(spark):
    o = spark.createDataFrame([("d", f"{k}", 1000 - k) for k in range(5)], "folder string, name string, written long")
    assert sorted(r.name for r in U.swept(o, ["folder"], F.lit(1000), keep=3).collect()) == ["3", "4"]
    assert sorted(r.name for r in U.swept(o, ["folder"], F.lit(1000), seconds=2).collect()) == ["3", "4"]
    t = spark.createDataFrame([(0, True, 9, 9, 99), (1, False, 5, 0, 99), (2, False, 0, 1, 24), (3, False, 6, 0, 25)], "k int, noted boolean, e int, c int, n int")
    assert [r.d for r in t.orderBy("k").select(U.nudge(F.col("noted"), F.col("e"), F.col("c"), F.col("n"))["due"].alias("d")).collect()] == [False, False, False, True]


def test_settings(spark):
    runs = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"a": "1"}), (2, {"a": "1"}, {"a": "1"})], "n int, new map<string,string>, previous map<string,string>")
    assert {r.n: r.changes for r in U.changed_settings(runs.withColumn("g", F.lit(0)), ["g"], "n").collect()} == {1: "b:-->2", 2: "no change"}
    got = U.overrides(spark.createDataFrame([({"HOT": "4", "X": "1"},)], "settings map<string,string>"), {"HOT": "3"}).collect()
    assert sorted(tuple(r) for r in got) == [("HOT", "4", "3"), ("X", "1", "?")]


def test_paths(spark):
    asked = spark.createDataFrame([("./a/b.py",), ("/home/me/a/b.py",), ("b.py",), ("zb.py",)], "asked string")
    got = U.indexed_paths(asked, spark.createDataFrame([("a/b.py",), ("c/b.py",)], "path string")).collect()
    assert {r.asked: r.path for r in got} == {"./a/b.py": "a/b.py", "/home/me/a/b.py": "a/b.py", "b.py": "a/b.py"}
    f = spark.createDataFrame([(p,) for p in ["src/app/x.py", "src/app/a/b/c/d/e.py", "src/y.py", "z.py", "src/app/.h/x.py", "src/app/x.md"]], "path string")
    assert dict(U.focus_scores(f, "src/app").collect()) == {"src/app/x.py": 0.65, "src/app/a/b/c/d/e.py": 0.3, "src/y.py": 0.2}


def test_fields_and_back(spark, tmp_path):
    ours = spark.createDataFrame([("1", "Edit", ["x"])], "id string, tool_name string, related_files array<string>")
    row = I.to_foreign(ours).first()
    assert (row.id, row.tool, row.files, row.session_id, row.type, row.raw_tokens) == ("1", "Edit", ["x"], "unknown", "info", 0)
    assert I.from_foreign(I.to_foreign(ours)).first().related_files == ["x"]
    rows = I.ledger_rows(spark.createDataFrame([("w", "f", 0.56), ("w", "g", 0.5)], "word string, path string, affinity double"), spark.createDataFrame([("a", "b", 0.31)], "src string, dst string, weight double"), spark.createDataFrame([("found", None)], "description string, path string"))
    I.save_ledger(rows, str(tmp_path / "l"))
    a, e, d = I.learned_from_ledger(I.load_ledger(spark, str(tmp_path / "l")))
    assert [tuple(r) for r in a.collect()] == [("w", "f", 0.56)] and [tuple(r) for r in e.collect()] == [("a", "b", 0.31)] and [tuple(r) for r in d.collect()] == [("found", "")]
    m = I.merged(spark.createDataFrame([("w", 1.0)], "k string, v double"), spark.createDataFrame([("w", 2.0), ("x", 0.5)], "k string, v double"), ["k"], "v")
    assert dict(m.collect()) == {"w": 2.0, "x": 0.5}


def test_counts_and_handoff(spark):
    one = U.learned_counts(spark.range(3), spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string"), spark.range(0)).first()
    assert tuple(one) == (3, 1, 0)
    h = spark.range(1).select(I.handoff(F.lit("s"), F.array(F.lit("d")), F.array(F.lit("n"))).alias("h")).first().h
    assert (h.type, h.content, h.metadata.decisions, h.metadata.next_steps) == ("handoff", "s", ["d"], ["n"])


def test_similar_signatures(spark):
    sigs = ["Bash|run|a:b|", "Bash|run|a:b:c|", "Bash|run||", "Edit|f|1|", "Edit|f||", "Edit|f|2|", "Edit|g|1|", "x|y", "x|z"]
    df = spark.createDataFrame([(a, b) for a in sigs for b in sigs], "a string, b string")
    for r in df.select("a", "b", M.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == S.alike(r.a, r.b), r
    # three commands that name nearly the same
    rows = [("s", k, "f", f"Bash|run|a:b:c:d:e:x{k}|") for k in range(3)]
    got = M.loops(spark.createDataFrame(rows, "session_id string, pos int, path string, signature string")).collect()
    assert [(r.pos, r["count"]) for r in got] == [(2, 3)]
