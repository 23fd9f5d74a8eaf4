"""Joins by containment, matching of predictions, caps: against plain versions and values worked out by hand."""

import json
import random

from pyspark.sql import functions as F

from tracewell.functions import caps as C
from tracewell.functions import text as T
from tracewell.operators import joins as J
from tracewell.operators import learning as L


def test_contained(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab/.") for _ in range(n))
    texts = [(r.randrange(3), word(r.randrange(0, 30))) for _ in range(200)] + [(0, None), (1, "")]
    needles = [(r.randrange(3), word(r.randrange(0, 9))) for _ in range(100)] + [(0, None), (1, "zz")]
    t, n = spark.createDataFrame(texts, "g int, text string"), spark.createDataFrame(needles, "g int, needle string")
    plain = {(a, b) for _, a in texts for _, b in needles if a and b and b in a}
    assert {tuple(x) for x in J.contained(t, n).collect()} == plain
    within = {(g, a, b) for g, a in texts for h, b in needles if g == h and a and b and b in a}
    assert sorted(tuple(x) for x in J.contained(t, n, ["g"]).collect()) == sorted(within)


def plain_matches(predicted, actual):
    actual, taken, hits = sorted(set(actual)), [], 0
    for p in sorted(set(predicted)):
        free = [a for a in actual if a not in taken]
        ends = [a for a in free if a.endswith(p) or p.endswith(a)]
        named = [a for a in free if a.split("/")[-1].lower() == p.split("/")[-1].lower()]
        hit = p if p in actual else (ends or named or [None])[0]
        if hit is not None:
            hits += 1
            if hit not in taken:
                taken.append(hit)
    return hits, len(taken)


def test_matched_predictions(spark):
    r = random.Random(7)
    path = lambda: "/".join(r.choice(["a", "b", "src", "X.py", "x.py", "y.ts"]) for _ in range(r.randrange(1, 4)))
    rows = [(k, [path() for _ in range(r.randrange(6))], [path() for _ in range(r.randrange(6))]) for k in range(200)]
    got = spark.createDataFrame(rows, "k int, p array<string>, a array<string>").select("k", J.matched_predictions(F.col("p"), F.col("a")).alias("m")).select("k", "m.*").collect()
    assert {x.k: (x.hits, x.matched) for x in got} == {k: plain_matches(p, a) for k, p, a in rows}


def test_first_six_files_of_a_turn(spark):
    # the seventh file of a turn links with nothing
    rows = [(t, f"f{k}", k) for t in range(3) for k in range(7)]
    got = L.coactivation(spark.createDataFrame(rows, "turn_id int, path string, n int"), ["turn_id"], "n").collect()
    assert {x for e in got for x in (e.src, e.dst)} == {f"f{k}" for k in range(6)} and len(got) == 30


def test_task_type_by_files(spark):
    rows = [("fix it", ["a.json"]), ("", ["x.test.ts"]), ("fix", ["x_test.go"]), ("review", ["x_test.go"]), ("", None), ("config", ["y_test.py"])]
    got = spark.createDataFrame(rows, "t string, f array<string>").select(T.task_type(F.col("t"), F.col("f")).alias("x")).collect()
    assert [r.x for r in got] == ["config", "review", "bug_fix", "review", "exploration", "config"]


def test_caps(spark):
    inputs = [{"command": "ls"}, {"command": "ls", "run_in_background": 1}, {"command": "ls", "run_in_background": ""}, {"command": "trap"}, {"command": None}, {}, None, {"command": "x", "n": {"deep": C.MARKER}}, {"command": "x", "n": C.MARKER.upper()}, {"command": C.MARKER}]
    df = spark.createDataFrame([(k, "Bash", json.dumps(i)) for k, i in enumerate(inputs)] + [(98, "Read", "{}"), (99, "Bash", "no json")], "k int, tool string, i string")
    got = {r.k: (r.why, r.forced) for r in df.select("k", C.cap_refusal(F.col("tool"), F.col("i")).alias("why"), C.is_forced(F.col("i")).alias("forced")).collect()}
    assert [got[k][0] for k in range(10)] == [None, "background command", None, "the command sets its own trap", "no command", "no command", "no tool input", None, None, "the caller asked for the full output"]
    assert [k for k in got if got[k][1]] == [8, 9]
    assert got[98][0] == "not the Bash tool" and got[99] == ("no tool input", False)
    assert [C.holdout_percent(x)[0] for x in (None, "25%", "0", "100", "101", "ten")] == [10, 25, 0, 100, 10, 10]
    assert C.holdout_percent("101")[1] and C.holdout_percent("ten")[1] and not C.holdout_percent("25%")[1]


def test_read_keys_and_responses(spark):
    df = spark.createDataFrame([("/A/b", None, None, None, None), ("/A/b", 1, None, "s", ""), ("/A/b", 0, 0, "s", "q")], "p string, o int, l int, s string, a string")
    assert [tuple(r) for r in df.select(C.read_key(F.col("p"), F.col("o"), F.col("l")), C.ledger_id(F.col("s"), F.col("a"))).collect()] == [("/a/b", "x"), ("/a/b\x1f1-0", "s"), ("/a/b", "s.agent-q")]
    rs = ["x" * 10, {"file": {"content": "y" * 5}, "stdout": "z" * 5, "other": "no"}, [{"text": "a" * 6}, "no", {"text": "b" * 4}], 5, None]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rs)] + [(9, "no json"), (10, None)], "k int, r string")
    assert {r.k: r.n for r in df.select("k", C.response_tokens(F.col("r")).alias("n")).collect()} == {0: 4, 1: 4, 2: 4, 3: 0, 4: 0, 9: 0, 10: 0}
