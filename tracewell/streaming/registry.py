"""Monitors of one's own: a fold over a key's rows, run in batch or as a stream with the same results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .monitors import fold_ledger, fold_loops, in_order


@dataclass(frozen=True)
class TurnMonitor:
    """What a monitor is: a key, an order, the columns it returns behind the key, its first state (JSON), and a step that folds rows in order into state and returns rows. Rows with equal values of a unit, where there is one, go into a step together."""

    name: str
    key: str
    order: str
    output: str
    start: Callable[[], dict]
    step: Callable[[dict, pd.DataFrame], list[tuple]]
    unit: str | None = None

    @property
    def columns(self) -> list[str]:
        return [self.key, *[c.strip().split(" ")[0] for c in self.output.split(",")]]

    def schema(self, df: DataFrame) -> str:
        return f"{self.key} {df.schema[self.key].dataType.simpleString()}, {self.output}"


def in_batch(monitor: TurnMonitor, df: DataFrame) -> DataFrame:
    """A key's rows are sorted by Spark and folded as they come, so a task's Python holds a batch and one state; rows of one unit stay together."""
    unit = [monitor.unit] if monitor.unit else []
    dealt = df.withColumn("_key", F.col(monitor.key).cast("string")).repartition("_key").sortWithinPartitions("_key", *unit, monitor.order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, rest = None, monitor.start(), None
        columns = ["_key", *monitor.columns[1:]]
        fold = lambda rows: [(key, *o) for o in monitor.step(now, rows)]
        for frame in frames:
            keys, out = [None if k is None or k != k else k for k in frame["_key"]], []
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                rows = frame.iloc[a:z]
                if keys[a] != key:
                    if rest is not None:
                        out += fold(rest)
                    key, now, rest = keys[a], monitor.start(), None
                if rest is not None:
                    rows, rest = pd.concat([rest, rows]), None
                if monitor.unit and z == len(keys):  # its last unit may go on in the next frame
                    last = rows[monitor.unit].eq(rows[monitor.unit].iloc[-1])
                    rows, rest = rows[~last], rows[last]
                out += fold(rows)
            yield pd.DataFrame(out, columns=columns)
        if rest is not None:
            yield pd.DataFrame(fold(rest), columns=columns)

    out = dealt.mapInPandas(run, f"_key string, {monitor.output}")
    return out.select(F.col("_key").cast(df.schema[monitor.key].dataType).alias(monitor.key), *monitor.columns[1:])


def as_stream(monitor: TurnMonitor, df: DataFrame) -> DataFrame:
    """Rows arrive in order of triggers; within a trigger they are put in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else monitor.start()
        # rows of one unit stay together
        parts = [pd.concat(list(frames)).sort_values(monitor.order)] if monitor.unit else in_order(frames, monitor.order)
        for rows in parts:
            yield pd.DataFrame([(key[0], *o) for o in monitor.step(now, rows)], columns=monitor.columns)
        state.update((json.dumps(now),))

    return df.groupBy(monitor.key).applyInPandasWithState(run, monitor.schema(df), "state string", "append", GroupStateTimeout.NoTimeout)


LEDGER = TurnMonitor("read_ledger", "ledger", "pos", "pos long, action string, saved_tokens_est long", lambda: {"compactions": 0, "edits": {}, "entries": {}}, fold_ledger)
LOOPS = TurnMonitor("loops", "session_id", "pos", "pos long, file string, count int, severity string, stage string", lambda: {"attempts": [], "file": None, "severity": None, "stage": None, "idle": 0}, fold_loops, "turn")


@dataclass
class Registry:
    """Monitors by name; a disabled one stays known but does not run."""

    monitors: dict[str, TurnMonitor] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, monitor: TurnMonitor) -> TurnMonitor:
        if not monitor.name.isidentifier():
            raise ValueError(f"{monitor.name!r} is no name for a monitor")
        self.monitors[monitor.name] = monitor
        return monitor

    def enable(self, name: str, on: bool = True) -> None:
        if name not in self.monitors:
            raise KeyError(name)
        (self.disabled.discard if on else self.disabled.add)(name)

    def active(self) -> list[TurnMonitor]:
        return [m for n, m in sorted(self.monitors.items()) if n not in self.disabled]


DEFAULT = Registry()
DEFAULT.register(LEDGER)
DEFAULT.register(LOOPS)
