"""One processor for all events of a session: the read ledger with its arms, voids by unseen compactions, alerts, nudges, hand-backs and caps, with typed state in batch and as a stream.

Events (session_id, pos, event, path, range, tokens, context), in order of pos:
`read` a read is about to be made, and its tokens; `edit`, `commit`, `note`; `stop` a turn ends, with the context's tokens; `precompact` and `start` a compaction is about to be made, or was; `marker` a transcript's sign of one; `output` a command's output, with its characters in tokens.

Messages (session_id, pos, kind, value):
`allow`, `notice` (logged), `deny` (acted on) and `held` (a held-out read that would have been noticed) with the tokens saved; `void` with the number of markers since the last read: what the ledger knew is gone; `alert` once a window, at 80 percent of the limit (the setting, else the least context of the last eight compactions); `nudge` where a window has no note after six edits or a commit, every 25 turns, and never together with an alert; `handback` after a compaction; `cap` with the characters that are left of a long output.

A session's state is a few numbers, the last eight compactions' sizes, and the files read and edited since the last compaction, the newest KEPT of each. As a stream it ends after a day without events, unless `expire` is off. Unknown events are passed over; a null session is one session.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Least tokens of a noticed read and what a notice costs; share of the limit; edits, turns; compactions kept; output limits; arms in percent.
NOTICE_LEAST, NOTICE_COST, ALERT_AT, EDITS, TURNS, COMPACTIONS = 400, 40, 0.8, 6, 25, 8
CAP_LEAST, CAP_LEFT = 6000, 1500 + 2500 + 240
BASELINE, OBSERVED = 10, 3
KEPT = 2000
COLUMNS = ["session_id", "pos", "event", "path", "range", "tokens", "context"]
OUT = "session_id string, pos long, kind string, value long"
STATE = "numbers array<long>, compacted array<long>, reads array<struct<key: string, path: string, epoch: long, tokens: long, noticed: boolean>>, edited array<struct<path: string, n: long>>"
NUMBERS = ("turn", "window", "edits", "commits", "noted", "alerted", "since", "pending", "missed")


def held_out(session: str, key: str, turn: int) -> bool:
    """Whether a read is left alone so that its arm shows the world without the ledger: the buckets of `holdout_arm`."""
    digest = hashlib.sha256(f"{session}\x1f{key}\x1f{turn}".encode()).hexdigest()
    return int(digest[:8], 16) % 100 < BASELINE + OBSERVED


class Session:
    """The state of a session, and its step over an event."""

    def __init__(self, name: str, limit: int | None, acting: bool, state: tuple | None = None) -> None:
        self.name, self.limit, self.acting = name, limit, acting
        numbers, compacted, reads, edited = state or (None, [], [], [])
        self.n = dict(zip(NUMBERS, numbers or [0, 0, 0, 0, -1, -1, 0, 0, 0], strict=True))
        self.compacted = list(compacted)
        self.reads = OrderedDict((r[0], (r[1], r[2], r[3], r[4])) for r in reads)  # key: path, epoch, tokens, noticed
        self.edited = OrderedDict((e[0], e[1]) for e in edited)

    def state(self) -> tuple:
        return ([self.n[k] for k in NUMBERS], self.compacted, [(k, *v) for k, v in self.reads.items()], list(self.edited.items()))

    def forget(self) -> None:
        self.reads.clear()
        self.edited.clear()

    def remember(self, key: str, entry: tuple) -> None:
        self.reads[key] = entry
        self.reads.move_to_end(key)
        if len(self.reads) > KEPT:
            self.reads.popitem(last=False)

    def read(self, path: str, part: str | None, tokens: int) -> Iterator[tuple[str, int]]:
        if self.n["pending"]:
            self.forget()
            self.n["missed"] += self.n["pending"]
            yield "void", self.n["pending"]
            self.n["pending"] = 0
        key, epoch = f"{path}\x1f{part or ''}", self.edited.get(path, 0)
        prior = self.reads.get(key)
        if not prior or prior[1] != epoch or prior[2] < NOTICE_LEAST or prior[3]:
            self.remember(key, (path, epoch, tokens, False))
            yield "allow", 0
            return
        saved = max(0, prior[2] - NOTICE_COST)
        if held_out(self.name, key, self.n["turn"]):
            self.remember(key, (path, epoch, tokens, False))
            yield "held", saved
        else:
            self.remember(key, (path, epoch, prior[2], True))
            yield "deny" if self.acting else "notice", saved

    def stop(self, context: int) -> Iterator[tuple[str, int]]:
        n = self.n
        n["turn"] += 1
        n["since"] += 1
        limit = self.limit or min(self.compacted, default=0)
        if limit and context and context >= int(limit * ALERT_AT) and n["alerted"] != n["window"]:
            n["alerted"] = n["window"]
            yield "alert", context
        elif n["noted"] != n["window"] and (n["edits"] >= EDITS or n["commits"]) and n["since"] >= TURNS:
            n["since"] = 0
            yield "nudge", n["edits"]

    def step(self, event: str, path: str | None, part: str | None, tokens: int | None, context: int | None) -> Iterator[tuple[str, int]]:
        n = self.n
        if event == "read" and path:
            yield from self.read(path, part, tokens or 0)
        elif event == "edit":
            n["edits"] += 1
            self.edited[path or ""] = self.edited.pop(path or "", 0) + 1
            if len(self.edited) > KEPT:
                self.edited.popitem(last=False)
        elif event == "commit":
            n["commits"] += 1
        elif event == "note":
            n["noted"] = n["window"]
        elif event == "stop":
            yield from self.stop(context or 0)
        elif event == "precompact":
            self.forget()
            if context:
                self.compacted = [*self.compacted, context][-COMPACTIONS:]
            n["window"] += 1
        elif event == "start":
            self.forget()
            n["since"] = TURNS  # a fresh window may be nudged
            yield "handback", n["window"]
        elif event == "marker":
            n["pending"] += 1
        elif event == "output" and (tokens or 0) > CAP_LEAST:
            yield "cap", CAP_LEFT


def own_columns(events: DataFrame) -> DataFrame:
    kinds = {"pos": "long", "tokens": "long", "context": "long"}
    return events.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c == "session_id" else F.col(c).cast(kinds.get(c, "string"))).alias(c) for c in COLUMNS])


def messages(events: DataFrame, limit: int | None = None, acting: bool = False) -> DataFrame:
    """Messages of all events: sessions are sorted by the shuffle and streamed through the step, with one session's state at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = None
        for b in batches:
            out = []
            for s, pos, *event in zip(*(b.column(c).to_pylist() for c in range(len(COLUMNS))), strict=True):
                if session is None or session.name != s:
                    session = Session(s, limit, acting)
                out += [(s, pos, kind, value) for kind, value in session.step(*event)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["session_id", "pos", "kind", "value"])

    return own_columns(events).repartition("session_id").sortWithinPartitions("session_id", "pos").mapInArrow(go, OUT)


def message_stream(events: DataFrame, limit: int | None = None, acting: bool = False, expire: bool = True) -> DataFrame:
    """The same of a stream; the rows of a trigger are taken in order of pos."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session(key[0], limit, acting, tuple(state.get) if state.exists else None)
        rows = sorted((tuple(None if x is None or x != x else x for x in r) for f in frames for r in f[COLUMNS[1:]].itertuples(index=False, name=None)), key=lambda r: r[0])
        out = []
        for pos, event, path, part, tokens, context in rows:
            whole = lambda x: None if x is None else int(x)
            out += [(key[0], int(pos), kind, value) for kind, value in session.step(event, path, part, whole(tokens), whole(context))]
        state.update(session.state())
        if expire:
            state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame(out, columns=["session_id", "pos", "kind", "value"])

    return own_columns(events).groupBy("session_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)
