"""Repeats within the last distinct signatures against a plain list."""

import random
from collections import OrderedDict

import pytest

from tracewell.operators import reuse as U

CALLS = "session_id string, pos long, signature string, compaction boolean, block int, recent string"


def plain(rows, bound):
    out, by = [], {}
    for s, pos, sig, compaction, *_ in sorted(rows, key=lambda r: (r[0] or "", r[1], not r[3], r[2] or "\0")):
        state = by.setdefault(s or "", [OrderedDict(), 0, 0])
        if compaction:
            state[1], state[2] = state[1] + 1, 0
            continue
        state[2] += 1
        out.append((s or "", pos, sig, state[1], state[2], sig in state[0]))
        state[0].pop(sig, None)
        state[0][sig] = None
        while len(state[0]) > bound:
            state[0].popitem(last=False)
    return out


def rows_of(n, seed, sessions=("a", "b", None)):
    r = random.Random(seed)
    out = []
    for k in range(n):
        s = sessions[0] if r.random() < 0.7 else r.choice(sessions)
        out.append((s, 2**60 + k, None if r.random() < 0.02 else f"sig{int(r.paretovariate(0.6)) % 60}", r.random() < 0.01, 1, "x"))
    return out + [(s, p, f"tie{k}", False, 1, "x") for k, (s, p, *_) in enumerate(out[:20])]


@pytest.mark.parametrize("bound, rows", [(5, 50), (1, 7), (30, 10**9), (400, 40)])
def test_plain_list(spark, bound, rows):
    calls = rows_of(1200, bound)
    got = [tuple(r) for r in U.repeats(spark.createDataFrame(calls, CALLS).repartition(3), bound=bound, rows=rows).collect()]
    assert sorted(got, key=str) == sorted(plain(calls, bound), key=str)


def test_ledger(spark):
    calls = [("s", 0, "old", False), ("s", 1, "lost", False), ("s", 2, None, True)] + [("s", 3 + k, f"n{k % 50}" if k else "old", False) for k in range(60)] + [("s", 100, None, True), ("s", 101, "lost", False)]
    df = spark.createDataFrame(calls, "session_id string, pos long, signature string, compaction boolean")
    got = sorted(tuple(r) for r in U.compaction_ledger(U.repeats(df, bound=10)).collect())
    assert got == [("s", 1, 40, 1, 0.025, True), ("s", 2, 1, 0, 0.0, False)]
    assert U.compaction_ledger(U.repeats(df.limit(0))).count() == 0


def test_one_long_session(spark):
    """A session of a million calls is gone through in blocks, with a list of 400 signatures each."""
    df = spark.sql("SELECT 'one' AS session_id, id AS pos, 'sig' || CAST(pmod(hash(id), 900) AS STRING) AS signature, id % 5000 = 4999 AS compaction FROM range(1000000)")
    found = U.repeats(df)
    ranged = found.groupBy("window").count().count()
    assert ranged == 201 or ranged == 200
    assert 0.25 < found.selectExpr("avg(CAST(repeat AS INT))").first()[0] < 0.55


def test_task_words_once(spark):
    """Task words between ASCII borders, looked for only where a text has them at all; null is exploration."""
    from tracewell.functions import text as T

    rows = [("fix the bug", "bug_fix"), ("prefix debugs", "exploration"), ("look  at it, look_at", "exploration"), ("please LOOK AT", "review"), ("éfixé", "bug_fix"), ("", "exploration"), (None, "exploration"), ("add fix", "bug_fix"), ("new_add", "exploration")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", T.task_type(df.t).alias("got")).collect()] == rows
    plan = df.select(T.task_type(df.t))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" in plan.lower()
