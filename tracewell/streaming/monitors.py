"""Structured Streaming: usage windows and monitors that carry state. Each gives what its batch form gives on the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import total_tokens
from ..sources.shared import shared_dir


def distinct_requests(records: DataFrame, late: str = "5 hours") -> DataFrame:
    """The first record of each request; what state keeps is bounded by the watermark."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def sliding_usage(records: DataFrame, length: str = "5 hours", slide: str = "1 hour", late: str = "5 hours") -> DataFrame:
    """Tokens and calls of sliding windows by project."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "project").agg(F.sum(total_tokens()).alias("tokens"), F.count("*").alias("api_calls")).select(F.col("w.start").alias("start"), "project", "tokens", "api_calls")


def daily_usage(records: DataFrame, late: str = "1 day") -> DataFrame:
    return records.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum(total_tokens()).alias("tokens")).select(F.col("w.start").alias("day"), "tokens")


LEDGER_OUT = "ledger string, pos long, action string, saved_tokens_est long"
#: State is kept as JSON: {compactions, edits by path, entries by key}.
STATE = "state string"


def fold_ledger(state: dict, rows: pd.DataFrame, notice_least: int = 400, notice_cost: int = 40) -> list[tuple]:
    """Decisions on rows in order; state: compactions, edits by path, entries by key (epoch, tokens, noticed)."""
    out = []
    for r in rows.itertuples(index=False):
        if r.event == "compact":
            state["compactions"] += 1
            state["entries"].clear()
            state["edits"].clear()
            continue
        if r.event == "edit":
            state["edits"][r.path] = state["edits"].get(r.path, 0) + 1
            continue
        if r.event != "read":
            continue
        key, epoch = f"{r.path}\x1f{r.range}\x1f{r.stat}", str(state["edits"].get(r.path, 0))
        prior = state["entries"].get(key)
        if prior and prior[0] == epoch and prior[1] >= notice_least and not prior[2]:
            state["entries"][key] = (epoch, prior[1], True)
            out.append((r.pos, "NOTICE", max(0, prior[1] - notice_cost)))
        else:
            state["entries"][key] = (epoch, int(r.tokens), False)
            out.append((r.pos, "ALLOW", 0))
    return out


def in_order(frames: Iterator[pd.DataFrame], order: str, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """A key's rows in order, some at a time. Until the last has come they are held as numbers: each different string once, and four bytes where it stands."""
    known: dict[str, dict] = {}
    held: dict[str, list[np.ndarray]] = {}
    for frame in frames:
        for c in frame:
            if pd.api.types.is_numeric_dtype(frame[c]):
                held.setdefault(c, []).append(frame[c].to_numpy())
                continue
            codes, values = pd.factorize(frame[c])
            ids = known.setdefault(c, {})
            at = np.array([*(ids.setdefault(v, len(ids)) for v in values), -1], "int32")
            held.setdefault(c, []).append(at[codes])  # the last one stands for null
    columns = {c: np.concatenate(held.pop(c)) for c in list(held)}
    values = {c: np.array([*ids, None], object) for c, ids in known.items()}
    place = np.argsort(columns[order], kind="stable") if columns else []
    for k in range(0, len(place), rows):
        part = place[k:k + rows]
        yield pd.DataFrame({c: values[c][v[part]] if c in values else v[part] for c, v in columns.items()})


def ledger_decisions(events: DataFrame, expire: bool = True) -> DataFrame:
    """Read decisions by ledger with keyed state: an entry for each file of the present compaction window; with `expire` gone after a day without events (such a stream runs on; without it, one over what there is now can end).

    events: ledger, pos, event, path, range, stat, tokens; the rows of a trigger are taken in order of pos.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {"compactions": 0, "edits": {}, "entries": {}}
        for rows in in_order(frames, "pos"):
            yield pd.DataFrame([(key[0], *o) for o in fold_ledger(now, rows)], columns=["ledger", "pos", "action", "saved_tokens_est"])
        state.update((json.dumps(now),))
        if expire:
            state.setTimeoutDuration(86_400_000)

    return events.groupBy("ledger").applyInPandasWithState(step, LEDGER_OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


LOOP_OUT = "session_id string, pos long, file string, count int, severity string, stage string"


def alike(a: str, b: str) -> float:
    """The similarity of two signatures, as the window form has it."""
    x, y = a.split("|"), b.split("|")
    if min(len(x), len(y)) < 4:
        return float(a == b)
    if x[:2] != y[:2]:
        return 0.0
    p, q = x[2], y[2]
    if x[0] != "Bash":
        return 0.5 if bool(p) != bool(q) else 1.0 if p == q else 0.3
    if not p or not q:
        return float(p == q)
    p, q = set(p.split(":")), set(q.split(":"))
    return len(p & q) / len(p | q)


def fold_loops(state: dict, rows: pd.DataFrame, last: int = 20, per_file: int = 9) -> list[tuple]:
    """The stages of a loop over turns in order. rows: pos, turn, file and signature (None for a turn without work).

    A turn without calls cools an active loop, a second one ends it; work on other files ends it; a repeated loop of another severity escalates.
    """
    out = []
    rows = rows[rows["turn"].notna()].sort_values("turn", kind="stable")
    for _, turn in groupby(zip(rows["turn"], rows["pos"], rows["file"], rows["signature"], strict=True), key=itemgetter(0)):
        turn = list(turn)
        work = [(f, s) for _, _, f, s in turn if s is not None and s == s]
        pos = int(max(r[1] for r in turn))
        if not work:
            if state["file"]:
                state["idle"] += 1
                if state["stage"] == "cooling" or state["idle"] >= 2:
                    state.update(file=None, severity=None, stage=None, idle=0)
                else:
                    state["stage"] = "cooling"
                    out.append((pos, state["file"], 0, state["severity"], "cooling"))
            continue
        state["idle"] = 0
        if state["file"] and all(state["file"] != f for f, _ in work):
            state.update(file=None, severity=None, stage=None)
            continue
        state["attempts"] = (state["attempts"] + [list(a) for a in work])[-last:]
        found = None
        for f in dict.fromkeys(a[0] for a in state["attempts"]):
            sigs = [s for g, s in state["attempts"] if g == f][-per_file:]
            if len(sigs) < 3:
                continue
            most = max(sigs.count(s) for s in sigs)
            n = len(sigs) if len(set(sigs[-3:])) == 1 else most if most >= 3 else 0
            if not n:
                like = sum(alike(sigs[-1], s) >= 0.7 for s in sigs)
                n = like if like >= 3 else 0
            if n:
                found = (f, n)
                break
        if not found:
            state.update(file=None, severity=None, stage=None)
            continue
        severity = "CRITICAL" if found[1] >= 7 else "WARNING" if found[1] >= 5 else "NOTICE"
        stage = "detected"
        if state["file"] == found[0]:
            stage = "escalated" if severity != state["severity"] else "detected" if state["stage"] == "cooling" else state["stage"]
        state.update(file=found[0], severity=severity, stage=stage)
        out.append((pos, found[0], found[1], severity, stage))
    return out


def loop_stages(calls: DataFrame) -> DataFrame:
    """Stages of loops by session with keyed state of the last 20 attempts. A turn is whole within a trigger."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("pos")
        now = json.loads(state.get[0]) if state.exists else {"attempts": [], "file": None, "severity": None, "stage": None, "idle": 0}
        out = fold_loops(now, rows)
        state.update((json.dumps(now),))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["session_id", "pos", "file", "count", "severity", "stage"])

    return calls.groupBy("session_id").applyInPandasWithState(step, LOOP_OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str = "append", idle: bool = False) -> DataFrame:
    """Runs a stream over what there is now; returns its result, written as Parquet to the shared folder. With `idle`, trigger after trigger until nothing new comes, for sources that bound what a trigger takes.

    Each batch has a folder of its own, which a repeated batch writes anew; in mode complete the last one holds the result.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    batches = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/{batch}")
        if batch not in batches:
            batches.append(batch)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write)
    if idle:
        query = writer.start()
        query.processAllAvailable()
        query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{path}/rows/{b}" for b in (batches[-1:] if mode == "complete" else batches)))


def stream_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parque[t]")
