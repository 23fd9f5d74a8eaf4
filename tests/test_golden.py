"""Values worked out by hand for usage, cost, monitors and contrasts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import experiments as E
from tracewell.operators import monitors as M
from tracewell.operators import usage as U
from tracewell.sources import logs
from tracewell.streaming import monitors as S

NOW = datetime(2026, 1, 10, 12)
RECORD = "ts timestamp, request_id string, session_id string, project string, git_branch string, model string, input_tokens long, output_tokens long, cache_creation_5m_tokens long, cache_creation_1h_tokens long, cache_creation_tokens long, cache_read_tokens long"


def records(spark, *rows):
    base = {"ts": NOW, "request_id": None, "session_id": "s", "project": "p", "git_branch": "b", "model": "opus-4-6", "input_tokens": 0, "output_tokens": 0, "cache_creation_5m_tokens": 0, "cache_creation_1h_tokens": 0, "cache_creation_tokens": 0, "cache_read_tokens": 0}
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], RECORD)


def test_window_stats(spark):
    r = records(spark, dict(input_tokens=100, output_tokens=50, cache_creation_tokens=200, cache_read_tokens=10000), dict(input_tokens=150, output_tokens=75, cache_creation_tokens=300, cache_read_tokens=15000))
    total = U.window_stats(r).where("level = 'total'").first()
    assert (total.window_tokens, total.input_tokens, total.output_tokens, total.cache_creation_tokens, total.cache_read_tokens, total.api_calls) == (25875, 250, 125, 500, 25000, 2)


def test_burn_rate(spark):
    r = records(spark, dict(ts=NOW - timedelta(minutes=10), input_tokens=200), dict(ts=NOW, input_tokens=400))
    one = U.burn_rate(r, F.lit(NOW)).first()
    assert (one.tokens_per_minute, one.sample_count) == (60.0, 2)
    assert U.burn_rate(records(spark, dict(input_tokens=1)), F.lit(NOW)).count() == 0


def test_costs(spark):
    def cost(**r):
        return U.estimate_cost(records(spark, r)).where("level = 'total'").first().cost

    assert cost(input_tokens=1_000_000, output_tokens=100_000) == 7.50
    assert cost(model="sonnet-4-5", input_tokens=1_000_000, output_tokens=100_000) == 4.50
    assert cost(model="haiku-4-5", input_tokens=1_000_000, output_tokens=1_000_000) == 6.00
    assert cost(cache_creation_tokens=1_000_000, cache_read_tokens=1_000_000) == 6.75


def test_audit(spark):
    a = U.billing_audit(records(spark, dict(input_tokens=1_000_000, output_tokens=100_000, cache_creation_tokens=1_000_000, cache_read_tokens=10_000_000))).first()
    assert (a.cost_input, a.cost_output, a.cost_cache_creation, a.cost_cache_read, a.cost_total) == (5.0, 2.5, 6.25, 5.0, 18.75)


def test_requests_once(spark):
    r = records(spark, dict(request_id="a", input_tokens=1), dict(request_id="a", input_tokens=2, ts=NOW + timedelta(1)), dict(request_id=""), dict(request_id=None))
    assert sorted(x.input_tokens for x in U.first_of_requests(r, ["ts"]).collect()) == [0, 0, 1]


def test_loops(spark):
    def worst(n):
        rows = [("s", i, "f", "x") for i in range(n)]
        got = M.loops(spark.createDataFrame(rows, "session_id string, pos int, path string, signature string")).orderBy("pos").collect()
        return got[-1].severity if got else None

    assert [worst(n) for n in (2, 3, 5, 7)] == [None, "NOTICE", "WARNING", "CRITICAL"]
    other = spark.createDataFrame([("s", i, "f", str(i)) for i in range(5)], "session_id string, pos int, path string, signature string")
    assert M.loops(other).count() == 0


def test_loop_stages():
    import pandas as pd

    def stages(turns):
        state = {"attempts": [], "file": None, "severity": None, "stage": None, "idle": 0}
        rows = pd.DataFrame([(i, i, "f" if t else None, t) for i, t in enumerate(turns)], columns=["pos", "turn", "file", "signature"])
        return [o[4] for o in S.fold_loops(state, rows)]

    assert stages(["x"] * 3) == ["detected"]
    assert stages(["x"] * 5) == ["detected", "detected", "escalated"]
    assert stages(["x"] * 3 + [None]) == ["detected", "cooling"]


def test_read_ledger(spark):
    rows = [(1, "read", 2000), (2, "read", 2000), (3, "read", 2000), (4, "edit", 0), (5, "read", 2000), (6, "compact", 0), (7, "read", 2000), (8, "read", 2000)]
    e = spark.createDataFrame([("l", p, k, "f", 0, 0, t) for p, k, t in rows], "ledger string, pos int, event string, path string, range int, stat int, tokens long")
    got = {r.pos: (r.action, r.saved_tokens_est) for r in M.read_decisions(e, ["ledger"], "pos").collect()}
    notice = ("NOTICE", 1960)
    assert got == {1: ("ALLOW", 0), 2: notice, 3: ("ALLOW", 0), 5: ("ALLOW", 0), 7: ("ALLOW", 0), 8: notice}
    assert {o[0]: o[1:] for o in S.fold_ledger({"compactions": 0, "edits": {}, "entries": {}}, e.toPandas())} == got


def test_edits_without_read(spark):
    c = spark.createDataFrame([("s", 1, 1, "Edit", "a"), ("s", 2, 1, "Read", "b"), ("s", 3, 2, "Edit", "b")], "session_id string, pos int, turn int, tool string, path string")
    assert {r.path: r.severity for r in M.edits_without_read(c).collect()} == {"a": "CRITICAL", "b": "NOTICE"}


def test_bootstrap_interval(spark):
    rows = [(f"t{i}", "treated", 10, 6000 + 20 * i) for i in range(5)] + [(f"b{i}", "baseline", 10, 10000 + 30 * i) for i in range(5)]
    s = spark.createDataFrame(rows, "session_id string, grp string, turns int, units int")
    ci = E.bootstrap(s).first()
    assert -0.45 < ci.low <= ci.high < -0.35
    few = E.bootstrap(s.where("session_id IN ('t1', 't2', 'b1')")).first()
    assert few.low is None and few.high is None


def test_tiers(spark):
    got = spark.createDataFrame([(0.8,), (0.7999,), (0.25,), (0.15,), (0.1,)], "s double").select(T.tier(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["HOT", "WARM", "WARM", "HINT", "COLD"]


def test_durations():
    assert [T.duration_seconds(x) for x in ("2h", "30m", "1d", "soon", None)] == [7200, 1800, 86400, 3600, 3600]


LINES = """
{"type":"assistant","timestamp":"2026-01-10T12:00:00Z","requestId":"r1","sessionId":"s","cwd":"/home/u/proj/x","message":{"model":"opus-4-6","content":[{"type":"tool_use","id":"t1","name":"Read","input":{"file_path":"a"}}],"usage":{"input_tokens":100,"output_tokens":50,"cache_creation_input_tokens":200,"cache_read_input_tokens":1000}}}
{"type":"user","timestamp":"2026-01-10T12:00:01","sessionId":"s","message":{"content":"hello"}}
not json
{"type":"user","timestamp":"","message":{"content":[{"type":"tool_result","tool_use_id":"t1","content":[{"type":"text","text":"abc"}]}]}}
{"type":"assistant","timestamp":"bad","message":{"model":"x","usage":{"input_tokens":1,"cache_creation":{"ephemeral_5m_input_tokens":5,"ephemeral_1h_input_tokens":7}}}}
"""


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(LINES.strip() + "\n")
    lines = logs.read_log(spark, str(tmp_path), logs.TRANSCRIPT).cache()
    assert lines.where("_corrupt IS NOT NULL").count() == 1
    u = logs.usage_records(lines).orderBy("input_tokens").collect()
    assert [(r.cache_creation_tokens, r.ts is None) for r in u] == [(12, True), (200, False)]
    assert u[1].project == "proj" and u[1].ts == datetime(2026, 1, 10, 12)
    b = logs.blocks(lines.where("_corrupt IS NULL AND message.content IS NOT NULL")).select("block.type", "block.text", logs.block_text(F.col("block.content")).alias("result")).collect()
    assert sorted((r.type, r.text, r.result) for r in b if r.type == "text") == [("text", "hello", None)]
    assert [r.result for r in b if r.type == "tool_result"] == ["abc"]


def test_event_log(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"v":1,"component":"a"}\n{"v":2}\n{bad\n')
    good, counts = logs.good_events(logs.read_log(spark, str(tmp_path), logs.EVENT).cache())
    assert good.count() == 1 and tuple(counts.first()) == (1, 1)


def test_git_log(spark):
    t = spark.createDataFrame([("COMMIT 1\na.py\nb.py\n\nCOMMIT 2\nb.py\n",)], "value string")
    assert sorted(tuple(r) for r in logs.commits_of(t).collect()) == [(0, "a.py"), (0, "b.py"), (1, "b.py")]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([('a,"b"', 1)], "x string, n int")
    logs.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().x == 'a,"b"'
    import pytest

    with pytest.raises(ValueError):
        logs.export(df, str(tmp_path / "d"), "xml")


def test_neighbours_in_time(spark):
    from tracewell.operators.joins import neighbours_in_time

    rows = [(1, "s", 10), (2, "s", 10), (3, "s", 10), (4, "s", 20), (5, "s", 30), (6, "t", 10), (7, "s", None)]
    got = {r.id: (r.before, r.after) for r in neighbours_in_time(spark.createDataFrame(rows, "id long, session_id string, t long"), 2, "session_id", "t").collect()}
    assert got == {1: ([], [4, 5]), 2: ([], [4, 5]), 3: ([], [4, 5]), 4: ([3, 2], [5]), 5: ([4, 3], []), 6: ([], []), 7: ([], [])}


def test_run_once_without_rows(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "none"))
    assert S.run_once(stream).collect() == []
