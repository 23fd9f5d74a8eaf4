"""Growing logs: what a stream gives over triggers and restarts equals a full read."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.sources import tail


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tail.register(spark)


class Stream:
    """A stream into memory of the driver, trigger by trigger."""

    def __init__(self, spark, logs, state, **options):
        self.rows, self.batches = [], 0

        def take(df, batch):
            got = df.collect()
            self.rows += [(r.path.rsplit("/", 1)[1], r.offset, r.line, r.complete) for r in got]
            self.batches += bool(got)

        self.query = spark.readStream.format("tail").options(path=str(logs), **options).load().writeStream.option("checkpointLocation", f"file://{state}").foreachBatch(take).start()

    def settle(self):
        self.query.processAllAvailable()
        return self.rows

    def stop(self):
        self.query.stop()


def full(logs):
    out = []
    for p in sorted(logs.glob("*.jsonl")):
        at = 0
        for x in p.read_bytes().split(b"\n")[:-1]:
            out.append((p.name, at, x.decode(errors="replace").rstrip("\r")))
            at += len(x) + 1
    return out


def test_growing_log(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    r = random.Random(3)
    stream = Stream(spark, logs, tmp_path / "state", firstLook="all", maxBytes="300")
    files = [(logs / f"{n}.jsonl").open("ab") for n in "ab"]
    for k in range(6):
        for f in files:
            f.write(b"".join(json.dumps({"n": k, "x": "ü" * r.randrange(60)}).encode() + b"\n" for _ in range(r.randrange(8))))
            f.write(b'{"half": ')  # the rest comes later
            f.flush()
        stream.settle()
        assert not any(line.endswith('{"half": ') for _, _, line, _ in stream.rows)
        for f in files:
            f.write(b"1}\n")
            f.flush()
    files[0].write(b"y" * 5000 + b"\nlast\r\n" + b"bad \xff byte\n\n")
    files[0].flush()
    got = stream.settle()
    stream.stop()
    assert sorted(x[:3] for x in got) == sorted(full(logs)) and all(x[3] for x in got)
    assert stream.batches > 6
    batch = spark.read.format("tail").options(path=str(logs), maxBytes="100").load()
    assert sorted((r.path.rsplit("/", 1)[1], r.offset, r.line) for r in batch.collect()) == sorted(full(logs))


def test_restart_and_rotation(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    one = logs / "one.jsonl"
    one.write_bytes(b"".join(b"line %04d\n" % k for k in range(50)))
    first = Stream(spark, logs, tmp_path / "state", firstLook="95", maxBytes="400")
    first.settle()
    first.stop()
    # the first look begins at a whole line, and says that it is not complete
    assert [x[2:] for x in first.rows] == [(f"line {k:04d}", False) for k in range(41, 50)]
    with one.open("ab") as f:
        f.write(b"".join(b"line %04d\n" % k for k in range(50, 150)) + b"half")
    again = Stream(spark, logs, tmp_path / "state", firstLook="95", maxBytes="400")
    again.settle()
    assert [x[2] for x in sorted(again.rows)] == [f"line {k:04d}" for k in range(50, 150)]
    one.write_bytes(b"new 1\nnew 2\n")
    (logs / "two.jsonl").write_bytes(b"other\n")
    (logs / "no.txt").write_bytes(b"not a log\n")
    again.settle()
    again.stop()
    assert sorted(again.rows)[100:] != [] and sorted(x[1:] for x in again.rows if x[2].startswith(("new", "other", "half", "not"))) == [(0, "new 1", True), (0, "other", True), (6, "new 2", True)]


def test_since(spark, tmp_path, monkeypatch):
    start = datetime(2026, 1, 1)
    one = tmp_path / "big.jsonl"
    one.write_text("".join(json.dumps({"timestamp": (start + timedelta(seconds=k)).isoformat() + "Z", "pad": "x" * 900}) + "\n" for k in range(20_000)))
    since = start + timedelta(seconds=15_000)
    got = spark.read.format("tail").options(path=str(one), since=since.isoformat() + "Z").load().withColumn("ts", F.get_json_object("line", "$.timestamp"))
    rows = got.where(F.col("ts") >= since.isoformat() + "Z")
    assert rows.count() == 5000
    assert 5000 <= got.count() < 5000 + 2 * tail.BACK_OFF // 900 and not got.where("complete").count()
    early = spark.read.format("tail").options(path=str(one), since="2020-01-01T00:00:00Z").load()
    assert early.count() == 20_000


def test_nothing_there(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_bytes(b"")
    assert spark.read.format("tail").options(path=str(tmp_path)).load().count() == 0
    assert spark.read.format("tail").options(path=str(tmp_path / "absent")).load().count() == 0
    (tmp_path / "end.jsonl").write_bytes(b"whole\nno end")
    assert [r.line for r in spark.read.format("tail").options(path=str(tmp_path)).load().collect()] == ["whole", "no end"]


def test_long_line_within_a_span():
    """A line longer than a span is taken whole once its end is there, and waits before."""
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(b"short\n" + b"z" * 1000)
        f.flush()
        file = tail.pa.fs.LocalFileSystem().open_input_file(f.name)
        assert tail.span_end(file, 0, 1006, 50) == 6 and tail.span_end(file, 6, 1006, 50) == 6
        f.write(b"\n")
        f.flush()
        file = tail.pa.fs.LocalFileSystem().open_input_file(f.name)
        assert tail.span_end(file, 6, 1007, 50) == 1007
