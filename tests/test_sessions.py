"""The session processor: decisions against a plain ledger, the stream against the batch over many triggers."""

import hashlib
import random

from tracewell.streaming import sessions as N

EVENTS = "session_id string, pos long, event string, path string, range string, tokens long, context long, kind string"


def events_of(n, seed=3):
    r = random.Random(seed)
    out = []
    for k in range(n):
        e = r.choice(["read"] * 8 + ["edit", "commit", "note", "stop", "stop", "precompact", "start", "marker", "output", "unknown", None])
        out.append((r.choice(["a", "b", None]), 2**55 + k, e, r.choice(["x", "y", "z", None]), r.choice(["1-9", None]), r.choice([None, 100, 400, 9000]), r.choice([None, 0, 900, 1000]), "q"))
    return out


def reads_plainly(rows, acting):
    """(session, pos, kind, value) of reads by dictionaries."""
    out = []
    for s in {r[0] or "" for r in rows}:
        known, edits, turn, pending = {}, {}, 0, 0
        for _, pos, e, path, part, tokens, *_ in sorted((r for r in rows if (r[0] or "") == s), key=lambda r: r[1]):
            if e == "stop":
                turn += 1
            elif e in ("precompact", "start"):
                known, edits = {}, {}
            elif e == "marker":
                pending += 1
            elif e == "edit":
                edits[path or ""] = edits.get(path or "", 0) + 1
            elif e == "read" and path:
                if pending:
                    known, edits, pending = {}, {}, 0
                key = path + "\x1f" + (part or "")
                seen = known.get(key)
                if seen and seen["edits"] == edits.get(path, 0) and seen["tokens"] >= 400 and not seen["told"]:
                    held = int(hashlib.sha256(f"{s}\x1f{key}\x1f{turn}".encode()).hexdigest()[:8], 16) % 100 < 13
                    out.append((s, pos, "held" if held else "deny" if acting else "notice", seen["tokens"] - 40))
                    if held:
                        known[key] = {"edits": edits.get(path, 0), "tokens": tokens or 0, "told": False}
                    else:
                        seen["told"] = True
                else:
                    out.append((s, pos, "allow", 0))
                    known[key] = {"edits": edits.get(path, 0), "tokens": tokens or 0, "told": False}
    return sorted(out)


def test_reads(spark):
    rows = events_of(1500)
    df = spark.createDataFrame(rows, EVENTS).repartition(4)
    for acting in (False, True):
        got = sorted(tuple(r) for r in N.messages(df, acting=acting).collect() if r.kind in ("allow", "notice", "deny", "held"))
        assert got == reads_plainly(rows, acting)
        assert {k for *_, k, _ in got} == {"allow", "held", "deny" if acting else "notice"}


def test_stream_equals_batch(spark, tmp_path):
    rows = events_of(900, 5)
    for k in range(6):
        spark.createDataFrame(rows[150 * k : 150 * (k + 1)], EVENTS).coalesce(1).write.json(str(tmp_path / f"new/{k}"))
    (tmp_path / "in").mkdir()
    got = []
    stream = N.message_stream(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")), limit=1000, expire=False)
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: got.extend(map(tuple, df.collect()))).start()
    for k in range(6):
        for f in (tmp_path / f"new/{k}").glob("part-*.json"):
            f.rename(tmp_path / "in" / f"{k}.json")
        q.processAllAvailable()
    q.stop()
    batch = sorted(map(tuple, N.messages(spark.createDataFrame(rows, EVENTS), limit=1000).collect()))
    assert sorted(got) == batch and {"alert", "void", "handback", "cap", "allow"} <= {k for *_, k, _ in batch}


def test_alert_and_nudge():
    """One alert a window; a nudge waits behind it, and for 25 turns."""
    s = N.Session("s", 1000, False)
    said = []
    for _ in range(6):
        said += s.step("edit", "f", None, None, None)
    for _ in range(30):
        said += s.step("stop", None, None, None, 900)
    assert said == [("alert", 900), ("nudge", 6)] and s.n["since"] == 5
    said = [*s.step("precompact", None, None, None, 950), *s.step("start", None, None, None, None), *s.step("stop", None, None, None, 100)]
    assert said == [("handback", 1), ("nudge", 6)] and s.compacted == [950]
    said = [*s.step("note", None, None, None, None), *s.step("start", None, None, None, None), *s.step("stop", None, None, None, 850)]
    assert said == [("handback", 1), ("alert", 850)]
    own = N.Session("t", None, False)
    own.compacted = [2000, 500]
    assert [*own.step("stop", None, None, None, 399), *own.step("stop", None, None, None, 400)] == [("alert", 400)]


def test_state_is_bounded():
    s = N.Session("s", None, False)
    for k in range(N.KEPT + 50):
        list(s.step("read", f"f{k}", None, 500, None))
        list(s.step("edit", f"f{k}", None, None, None))
    assert len(s.reads) == len(s.edited) == N.KEPT and N.Session("s", None, False, s.state()).state() == s.state()


def test_no_events(spark):
    assert N.messages(spark.createDataFrame([], EVENTS)).count() == 0
