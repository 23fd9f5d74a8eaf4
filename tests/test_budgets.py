"""Fills and diverse choices against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import budgets as B

LINES = "g string, h int, o long, size long, phase int, left string, kept string"


def plain_fill(rows, budget, reserve, strict, phases, least):
    out, by = [], {}
    for g, h, o, size, phase, *_ in sorted(rows, key=lambda r: (str(r[0]), r[1] or 0, (r[4] or 0) if phases else 0, r[2])):
        s = by.setdefault((g, h), {"left": max(0, budget - reserve), "at": 0, "open": True})
        p = (phase or 0) if phases else 0
        if p != s["at"]:
            s["at"], s["open"] = p, s["left"] > least
        fits = s["open"] and size is not None and (size < s["left"] if strict else size <= s["left"])
        s["left"] -= size if fits else 0
        out.append((str(g), h, o, fits, s["left"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget, reserve, strict, phases, least", [(100, 0, False, False, 0), (100, 30, True, True, 20), (0, 5, False, False, 0), (10**6, 0, False, True, 0)])
def test_fill(spark, budget, reserve, strict, phases, least):
    r = random.Random(budget + least)
    rows = [(r.choice(["a", "b", None]), r.choice([1, 2]), k, r.choice([None, 0, 3, 10, 40, 90]), r.choice([0, 1, None]), "x", "y") for k in range(300)]
    df = spark.createDataFrame(rows, LINES).drop("left", "kept").withColumn("_n", F.lit(1)).repartition(3)
    got = B.fill(df, ["g", "h"], ["o"], "size", budget, reserve, strict, "phase" if phases else None, least)
    assert sorted(((str(x.g), x.h, x.o, x.kept, x.left) for x in got.collect()), key=str) == plain_fill(rows, budget, reserve, strict, phases, least)
    assert B.fill(df.limit(0), ["g"], ["o"], "size", 5).count() == 0


def test_handback_counts_what_it_dropped(spark):
    rows = [("s", k, n) for k, n in enumerate([50, 60, 30, 200, 5])] + [("t", 0, 500)]
    df = spark.createDataFrame(rows, "g string, o long, size long")
    assert sorted(tuple(x) for x in B.handback(df, ["g"], ["o"], "size", 100, 10).select("g", "o", "left", "dropped").collect()) == [("s", 0, 40, 2), ("s", 2, 10, 2), ("s", 4, 5, 2)]


def test_a_long_group_is_linear(spark):
    df = spark.sql("SELECT 'one' AS g, id AS o, 1 + id % 7 AS size FROM range(1000000)")
    got = B.fill(df, ["g"], ["o"], "size", 2_000_000).agg(F.sum(F.when(F.col("kept"), F.col("size"))).alias("used"), F.count("*").alias("n"), F.min("left").alias("left")).first()
    assert got.n == 1_000_000 and got.used + got.left == 2_000_000 and got.left == 0


def greedy(rows, k, per_dir=3):
    """Step by step over what is left."""
    if len(rows) <= k:
        return [(p, None, False) for p, _, _ in rows]
    left, taken, out = list(rows), {}, []
    while len(out) < k and left:
        open_ = [(round(0.7 * s - 0.045 * taken.get(d, 0), 9), -i) for i, (_, d, s) in enumerate(left) if taken.get(d, 0) < per_dir]
        i = -max(open_)[1] if open_ else 0
        p, d, _ = left.pop(i)
        out.append((p, max(open_)[0] if open_ else None, not open_))
        taken[d] = taken.get(d, 0) + 1
    return out


def test_diverse_is_greedy(spark):
    r = random.Random(11)
    groups = {}
    for g in range(60):
        n = r.choice([0, 3, 8, 9, 20, 40])
        rows = [(f"p{g}_{k:02d}", r.choice("abc"[: r.randrange(1, 4)]), r.choice([0.1, 0.5, 0.52, 0.9, round(r.random(), 2)])) for k in range(n)]
        groups[g] = sorted(rows, key=lambda x: (-x[2], x[0]))
    df = spark.createDataFrame([(g, *x) for g, rows in groups.items() for x in rows], "g int, path string, dir string, score double").repartition(4)
    got = {}
    for x in B.diverse(df, ["g"], 8).orderBy("g", "rank").collect():
        got.setdefault(x.g, []).append((x.path, x.value, x.fallback))
    assert got == {g: greedy(rows, 8) for g, rows in groups.items() if rows}
    assert any(f for rows in got.values() for _, _, f in rows)
