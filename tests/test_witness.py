"""Markers and hooks as two streams: late, missing and doubled ones."""

from datetime import datetime, timedelta


from tracewell.streaming import monitors as S
from tracewell.streaming import witness as W

T0 = datetime(2026, 1, 1)
HOOKS, MARKERS = "session_id string, hook long, ts timestamp", "session_id string, marker long, ts timestamp"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


HOOK_BATCHES = [[("a", 1, at(0)), ("a", 1, at(0)), ("b", 2, at(1))], [("a", 3, at(30)), (None, 9, at(30))], [("b", 4, at(58)), ("z", 99, at(500))], [("a", 5, at(60))]]
MARKER_BATCHES = [[("a", 10, at(1)), ("b", 20, at(20)), ("b", 20, at(21))], [("a", 11, at(28)), (None, 30, at(30))], [("b", 21, at(60)), ("a", 12, at(61)), ("z", 98, at(500))], [("a", 13, at(40))]]


def test_table(spark):
    hooks = spark.createDataFrame([r for b in HOOK_BATCHES for r in b], HOOKS)
    markers = spark.createDataFrame([r for b in MARKER_BATCHES for r in b], MARKERS)
    got = {(r.session_id, r.marker): (r.missed, r.so_far) for r in W.missed(W.witnessed(hooks, markers)).collect()}
    assert got == {("a", 10): (False, 0), ("a", 11): (False, 0), ("a", 13): (True, 1), ("a", 12): (False, 1), ("b", 20): (True, 1), ("b", 21): (False, 1), ("z", 98): (False, 0), (None, 30): (True, 1)}


def test_streams(spark, tmp_path):
    """Batch by batch: what is late in time waits for its partner, a marker without one comes once the watermark is past, a row behind the watermark is left out."""
    for n, (h, m) in enumerate(zip(HOOK_BATCHES, MARKER_BATCHES, strict=True)):
        spark.createDataFrame(h, HOOKS).coalesce(1).write.json(str(tmp_path / f"new/h{n}"))
        spark.createDataFrame(m, MARKERS).coalesce(1).write.json(str(tmp_path / f"new/m{n}"))
    for kind in "hm":
        (tmp_path / kind).mkdir()
    read = lambda kind, schema: spark.readStream.schema(schema).json(str(tmp_path / kind))
    rows = []
    stream = W.witnessed(read("h", HOOKS), read("m", MARKERS))
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: rows.extend(map(tuple, df.collect()))).start()
    seen = []
    for n in range(4):
        for kind in "hm":
            for f in (tmp_path / f"new/{kind}{n}").glob("part-*.json"):
                f.rename(tmp_path / kind / f"{n}-{f.name}")
        q.processAllAvailable()
        seen.append({(s, m, h) for s, m, _, h in rows})
    q.stop()
    assert ("a", 10, 1) in seen[0] and ("b", 20, None) not in seen[0] and ("a", 11, 3) in seen[1]
    assert {("b", 20, None), ("b", 21, 4), ("z", 98, 99)} <= seen[2]
    assert not any(m == 13 for _, m, _ in seen[3])  # behind the watermark
    assert len(rows) == len(set(rows)) and sum(m == 20 for _, m, _, _ in rows) == 1
    # the hook at 60 came when the watermark was at 490
    assert ("a", 12, None) in seen[3]


def test_spans_of_time(spark):
    """Rows of a session meet those of near times only, and what decides about a marker gives what all pairs give: at borders, before the epoch, with hooks that come twice."""
    times = [timedelta(seconds=s) for s in (-301, -300, -299, -1, 0, 1, 299, 300, 301, 599, 600, 601, 900)]
    zero = datetime(1970, 1, 1)
    hooks = spark.createDataFrame([(s, k, zero + t) for s in "ab" for k, t in enumerate(times[:6] if s == "a" else times[::5])] + [("a", 0, zero + timedelta(hours=3)), (None, 1, zero), ("a", None, zero + timedelta(hours=9)), ("a", 77, None)], HOOKS)
    markers = spark.createDataFrame([(s, k * 10 + n, zero + t + timedelta(microseconds=n - 1)) for s in ("a", "b", "c", None) for k, t in enumerate(times) for n in range(3)] + [("a", 900, zero + timedelta(hours=3)), ("a", 901, zero + timedelta(hours=9))], MARKERS)
    h, m = [r for r in hooks.collect() if r.ts and r.session_id and r.hook is not None], markers.collect()
    first = {}
    for r in h:
        first[r.session_id, r.hook] = min(r.ts, first.get((r.session_id, r.hook), r.ts))
    want = {(r.session_id, r.marker): not any(s == r.session_id and abs(t - r.ts) <= timedelta(minutes=5) for (s, _), t in first.items()) for r in m}
    pairs = W.witnessed(hooks, markers)
    assert {(r.session_id, r.marker): r.missed for r in W.missed(pairs).collect()} == want
    assert {(r.session_id, r.marker): r.missed for r in W.counted(W.unwitnessed(hooks, markers)).collect()} == want
    assert "_at" in pairs._jdf.queryExecution().optimizedPlan().toString()
