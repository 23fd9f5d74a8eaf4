"""Monitors of one's own run alike in batch and as a stream."""

import pytest
from conftest import SF

from tracewell.plans import registry as Q
from tracewell.streaming.registry import DEFAULT, LOOPS, Registry, TurnMonitor, in_batch


def test_loops_in_batch_and_stream(spark):
    one, two = (sorted(tuple(r) for r in Q.QUERIES[n](spark, SF).collect()) for n in ("monitor_loop_stages", "stream_loop_stages"))
    assert one == two and {r[5] for r in one} >= {"detected"}


def test_registry(spark):
    assert [m.name for m in DEFAULT.active()] == ["loops", "read_ledger"]
    r = Registry()
    r.register(LOOPS)
    r.enable("loops", False)
    assert r.active() == []
    with pytest.raises(KeyError):
        r.enable("other")
    with pytest.raises(ValueError):
        r.register(TurnMonitor("no name", "k", "o", "n int", dict, lambda s, p: []))


def test_own_monitor(spark):
    count = TurnMonitor("count", "k", "o", "n int", lambda: {"n": 0}, lambda s, p: [(len(p),)])
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    assert sorted(map(tuple, in_batch(count, df).collect())) == [("a", 2), ("b", 1)]
