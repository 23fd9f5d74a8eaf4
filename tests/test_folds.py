"""Folds of long keys: Python holds a batch, not a key's rows."""

import pandas as pd

from tracewell.streaming import monitors as S
from tracewell.streaming import registry as R


def test_a_key_comes_in_batches(spark):
    """A key over many batches gives what one fold over all its rows gives; turns that batches cut stay whole; the steps see few rows each."""
    rows = [(k, p, p // 3, f"f{p % 2}" if p % 7 else None, f"Edit|{p % 2}" if p % 7 else None) for k in (1, 2, None) for p in range(200)]
    calls = spark.createDataFrame(rows, "session_id long, pos long, turn long, file string, signature string").repartition(3)
    want = []
    for k in (1, 2, None):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == k], columns=["pos", "turn", "file", "signature"])
        want += [(k, *o) for o in S.fold_loops(R.LOOPS.start(), own)]
    size = R.TurnMonitor("size", "session_id", "pos", "n long", dict, lambda state, rows: [(len(rows),)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = sorted(map(tuple, R.in_batch(R.LOOPS, calls).collect()), key=str)
        sizes = [r.n for r in R.in_batch(size, calls).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want, key=str) and len(got) > 50
    assert max(sizes) <= 10 and sum(sizes) == 600


def test_rows_in_order():
    frames = [pd.DataFrame({"pos": [5, 1, 9], "path": ["a", None, "b"]}), pd.DataFrame({"pos": [2, 7], "path": ["b", "c"]})]
    parts = list(S.in_order(iter(frames), "pos", 2))
    assert [len(p) for p in parts] == [2, 2, 1]
    assert [(r.pos, r.path) for p in parts for r in p.itertuples()] == [(1, None), (2, "b"), (5, "a"), (7, "c"), (9, "b")]
    assert list(S.in_order(iter([]), "pos")) == []
