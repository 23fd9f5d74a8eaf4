"""Logs of changes: repeated batches, updates of some columns, compaction, retention; the advisor's suggestions over it."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import advisor as A
from tracewell.sources import status_log as S

ROWS = "id string, seq long, status string, note string"


def state(spark, path):
    return {r.id: (r.seq, r.status, r.note) for r in S.states(spark, path, "id", "seq").collect()}


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROWS)


def test_batches(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with pytest.raises(ValueError, match="no log"):
        S.states(spark, path, "id", "seq")
    assert S.append(spark, path, rows(spark, ("a", 1, "pending", "x"), ("b", 1, "pending", None), (None, 9, "lost", "lost")), 0)
    assert S.append(spark, path, rows(spark, ("a", 2, "applied", None), ("b", 0, "older", "y")), 1)
    want = {"a": (2, "applied", "x"), "b": (1, "pending", "y")}
    assert state(spark, path) == want
    # a batch that comes again changes nothing, whatever it holds
    assert not S.append(spark, path, rows(spark, ("a", 9, "again", "z")), 1)
    assert S.compact(spark, path, "id", "seq") and state(spark, path) == want
    assert not S.append(spark, path, rows(spark, ("a", 9, "again", "z")), 0) and not S.compact(spark, path, "id", "seq")
    assert S.append(spark, path, rows(spark, ("a", 3, None, "new"), ("c", 3, "pending", None), ("c", 3, "pending", None)), 2)
    want = {"a": (3, "applied", "new"), "b": (1, "pending", "y"), "c": (3, "pending", None)}
    assert state(spark, path) == want
    assert S.vacuum(spark, path) == 2 and state(spark, path) == want
    assert S.compact(spark, path, "id", "seq", keep=2)
    assert state(spark, path) == {k: want[k] for k in "ac"}
    assert not S.append(spark, path, rows(spark, ("d", 1, "late", None)), 0)
    # more columns later
    S.append(spark, path, rows(spark, ("a", 4, "applied", "new")).withColumn("owner", F.lit("me")), "named")
    assert {r.id: r.owner for r in S.states(spark, path, "id", "seq").collect()} == {"a": "me", "c": None}


def test_as_a_sink(spark, tmp_path):
    """A stream that is run again from its begin writes each batch once."""
    path, src = f"file://{tmp_path}/log", str(tmp_path / "in")
    spark.range(100).selectExpr("CAST(id % 7 AS STRING) AS id", "id AS seq", "CAST(id AS STRING) AS status", "'n' AS note").write.parquet(src)
    for run in range(2):
        q = spark.readStream.schema(ROWS).parquet(src).writeStream.option("checkpointLocation", str(tmp_path / f"state{run}")).foreachBatch(lambda df, n: S.append(spark, path, df, n) and None).trigger(availableNow=True).start()
        q.awaitTermination()
    assert S.changes(spark, path).count() == 100
    assert state(spark, path) == {str(k): (s, str(s), "n") for k in range(7) for s in [max(x for x in range(100) if x % 7 == k)]}


def turns(spark, n, **more):
    base = {"hot": ["h.md"], "injected": ["w.md", "u.md"], "used": ["u.md"], "words": ["run", "the", "tests", "now"]} | more
    return spark.createDataFrame([(k, *base.values()) for k in range(n)], "turn_id long, hot array<string>, injected array<string>, used array<string>, words array<string>")


def test_advisor(spark, tmp_path):
    assert A.suggestions(turns(spark, 9)).count() == 0
    found = {r.id: (r.type, r.subject, r.n, r.of) for r in A.suggestions(turns(spark, 60)).collect()}
    assert found.pop("always_hot_h.md") == ("always_hot", "h.md", 20, 20) and found.pop("high_waste_w.md") == ("high_waste", "w.md", 0, 50)
    assert sorted(v[1:3] for v in found.values()) == [("run the tests", 50), ("the tests now", 50)]
    path = f"file://{tmp_path}/log"
    assert A.suggest(spark, path, turns(spark, 12), 0, F.lit(1)) and not A.suggest(spark, path, turns(spark, 12), 0, F.lit(1))
    told = spark.createDataFrame([("high_waste_w.md", "applied", 2), ("always_hot_h.md", "dismissed", 2), ("unknown", "applied", 2), ("phrase_x", "odd", 2)], "id string, status string, seq int")
    A.decide(spark, path, told, 1)
    assert [r.path for r in A.demoted(spark, path).collect()] == ["w.md"]
    A.suggest(spark, path, turns(spark, 40, hot=["h.md", "new.md"]), 2, F.lit(3))
    assert {r.id for r in A.listed(spark, path, "pending").where("type = 'always_hot'").collect()} == {"always_hot_new.md"}
    assert {r.id for r in A.listed(spark, path, "dismissed").collect()} == {"always_hot_h.md"}


def test_usage_of_the_newest_turn(spark):
    t = spark.createDataFrame([(1, 10, ["a", "b", "c"]), (2, 10, ["a", "b", "c"])], "turn_id long, injection_chars long, files_injected array<string>")
    for files, chars, want in ((["a"], 10, 0.667), ([], 10, 1.0), (None, 10, 1.0), (["a"], 0, 0.0)):
        usage = spark.createDataFrame([(files, 4)], "files_used array<string>, tool_calls long")
        got = A.with_usage(t.withColumn("injection_chars", F.lit(chars)), usage).orderBy("turn_id").collect()
        assert [(r.waste_ratio, r.tool_calls) for r in got] == [(None, None), (want, 4)]
