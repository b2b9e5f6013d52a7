"""Small state machines, one a key, with event-time timers that end what nobody ends.

Keys are dealt into ``BUCKETS`` by hash; those of one bucket share a call, a row of state and a timer, the
earliest of theirs, so work outside the machines grows with rows and not with calls a key.

A machine is told a batch's rows of its key in order, and the time when a deadline that it
named has passed. A row that comes later than such a deadline finds the key as new, whether its timer has
run or not, so results don't depend on how rows are cut into batches. When it answers with no state, the key is gone from the store; so the store
holds no more keys than were lately active. Rows older than the watermark are left.
Timers need the store of ``STORE``; ``timers`` sets it for the queries started inside it.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"

Said = tuple[list[tuple], tuple | None, int | None]
#: Time of each row in milliseconds, for deadlines. Spark hands rows over by name, and names there begin with a letter.
NOW = "now_ms"
#: Buckets of keys. A batch that touches a bucket rewrites the state of its keys that are active; a checkpoint is good for one number only.
BUCKETS = 1024
#: A row's key as text and its bucket.
KEY, BUCKET = "key_text", "key_bucket"


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with their key as text, and its bucket; a null key is a key."""
    text = F.base64(by) if rows.schema[by].dataType.simpleString() == "binary" else F.col(by).cast("string")
    return rows.withColumns({KEY: text, BUCKET: F.pmod(F.hash(by), F.lit(BUCKETS))})


def key_of_text(by: str, kind: str) -> Column:
    return (F.unbase64(KEY) if kind == "binary" else F.col(KEY).cast(kind)).alias(by)


class Machine(ABC):
    """Rules of one key; must be picklable. Answers are (rows of the result, state or None, deadline in ms or None)."""

    #: Columns that rows are told with, in this order; those they are sorted by, and in which direction.
    columns: list[str]
    order: list[str]
    ascending: list[bool] | bool = True
    #: DDL of the state and of the result without its key.
    state: str
    result: str

    @abstractmethod
    def told(self, state: tuple | None, rows: list[tuple]) -> Said:
        """``rows`` of ``columns``, with their time in milliseconds behind."""

    def expired(self, state: tuple, now: int) -> Said:
        """The deadline has passed."""
        return [], None, None


class _Timed(StatefulProcessor):
    """The machines of a bucket's keys. Its timer runs a millisecond before their earliest deadline, as Spark ends timers that lie before the watermark."""

    def __init__(self, machine: Machine, result: list[str]):
        self.machine, self.result = machine, result

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("states", f"keys array<struct<name string, deadline long, state struct<{self.machine.state}>>>")

    def _states(self) -> dict[str | None, tuple[tuple, int | None]]:
        return {name: (tuple(state), deadline) for name, deadline, state in self.held.get()[0]} if self.held.exists() else {}

    def _settled(self, states: dict[str | None, tuple[tuple, int | None]], said: list[tuple[str | None, Said]]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for name, (rows, state, deadline) in said:
            out += [(name, *r) for r in rows]
            if state is None:
                states.pop(name, None)
            else:
                states[name] = tuple(state), deadline
        if states:
            self.held.update(([(name, deadline, state) for name, (state, deadline) in states.items()],))
        else:
            self.held.clear()
        due = min((d - 1 for _, d in states.values() if d is not None), default=None)
        for t in list(self.handle.listTimers()):
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None:
            self.handle.registerTimer(due)
        yield framed(out, [KEY, *self.result])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        m, states = self.machine, self._states()
        sorted_ = pd.concat(list(rows)).sort_values(m.order, ascending=m.ascending, kind="stable")
        told: dict[str | None, list[tuple]] = {}
        for name, row in zip(sorted_[KEY].tolist(), zip(*(sorted_[c].tolist() for c in [*m.columns, NOW]), strict=True), strict=True):
            told.setdefault(name, []).append(row)
        yield from self._settled(states, [(name, m.told(states[name][0] if name in states else None, own)) for name, own in told.items()])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        states, now = self._states(), timerValues.getCurrentWatermarkInMs()
        yield from self._settled(states, [(name, self.machine.expired(state, deadline)) for name, (state, deadline) in states.items() if deadline is not None and deadline <= now])

    def close(self) -> None:
        pass


def framed(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """``rows`` as a frame in which whole numbers stay whole beside missing ones."""
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pd.DataFrame({c: pd.Series(v, dtype=object if not v or None in v and any(type(x) is int for x in v) else None) for c, v in zip(columns, values, strict=True)})


def run(rows: DataFrame, by: str, ts: str, machine: Machine, late: str) -> DataFrame:
    """(by, ``machine.result``): a machine a key over a stream with event time ``ts``; rows without a time are left."""
    kind = rows.schema[by].dataType.simpleString()
    timed = dealt(rows, by).withColumn("event_time", F.col(ts).cast("timestamp")).where("event_time IS NOT NULL").withColumn(NOW, F.unix_millis("event_time")).withWatermark("event_time", late)
    columns = [BUCKET, KEY, *dict.fromkeys([*machine.columns, *machine.order, NOW]), "event_time"]
    result = [c.strip().split(" ")[0] for c in machine.result.split(",")]
    found = timed.select(columns).groupBy(BUCKET).transformWithStateInPandas(_Timed(machine, result), f"{KEY} string, {machine.result}", "append", "eventTime")
    return found.select(key_of_text(by, kind), *result)


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that start inside may use timers."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, STORE)
    try:
        yield
    finally:
        spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)


class Speech(Machine):
    """Hysteresis; an open segment of a key that falls silent for ``idle`` ms comes out at its last window."""

    def __init__(self, at: str, p: str, time: str, enter: float, leave: float, hang: int, idle: int):
        self.columns, self.order, self.enter, self.leave, self.hang, self.idle = [at, p], [at], enter, leave, hang, idle
        self.state, self.result = f"start {time}, end {time}, missed int, last long", f"start {time}, end {time}"

    def told(self, state: tuple | None, rows: list[tuple]) -> Said:
        start, end, missed, last = state or (None, None, 0, 0)
        opened, out = state is not None, []
        for t, p, now in rows:
            if opened and now - last > self.idle:
                out.append((start, end))
                opened = False
            last = max(last, now)
            if not opened:
                if p >= self.enter:
                    opened, start, end, missed = True, t, t, 0
            elif p >= self.leave:
                end, missed = t, 0
            else:
                missed += 1
                if missed >= self.hang:
                    out.append((start, end))
                    opened = False
        return (out, (start, end, missed, last), last + self.idle) if opened else (out, None, None)

    def expired(self, state: tuple, now: int) -> Said:
        return [state[:2]], None, None


class Ring(Machine):
    """Facts with the newest state before them, from the last ``entries`` states of ``seconds``; the newest stays until the key is silent for ``idle`` ms."""

    def __init__(self, at: str, value: str, is_state: str, kind: str, entries: int, seconds: int, idle: int):
        self.columns, self.order, self.ascending = [at, value, is_state], [at, is_state], [True, False]
        self.entries, self.micros, self.idle = entries, seconds * 1_000_000, idle
        self.state, self.result = f"times array<long>, vals array<{kind}>, last long", f"{at} long, {value} {kind}, predated boolean"

    def told(self, state: tuple | None, rows: list[tuple]) -> Said:
        ring = list(zip(state[0], state[1], strict=True)) if state else []
        last, out = state[2] if state else 0, []
        for t, v, s, now in rows:
            if now - last > self.idle:
                ring = []
            last = max(last, now)
            if s:
                ring.append((t, v))
                ring = [x for x in ring[-self.entries :] if x[0] >= t - self.micros] or ring[-1:]
            elif ring:
                before = [x for x in ring if x[0] <= t]
                out.append((t, (before or ring[:1])[-1][1], not before))
        return (out, ([x[0] for x in ring], [x[1] for x in ring], last), last + self.idle) if ring else (out, None, None)


class Still(Machine):
    """Files seen again with the same size and time, ``settle`` ms after they were first seen so; forgotten ``forget`` ms after they were last seen."""

    columns, order = ["size", "mtime"], [NOW]
    state, result = "size long, mtime long, since long, last long, told boolean", "size long, mtime long"

    def __init__(self, settle: int, forget: int):
        self.settle, self.forget = settle, forget

    def told(self, state: tuple | None, rows: list[tuple]) -> Said:
        size, mtime, since, last, done = state or (None, None, 0, 0, False)
        out = []
        for s, m, now in rows:
            if (s, m) != (size, mtime) or now - last > self.forget:
                size, mtime, since, done = s, m, now, False
            elif not done and now - since >= self.settle:
                out.append((s, m))
                done = True
            last = max(last, now)
        return out, (size, mtime, since, last, done), last + self.forget


class Focus(Machine):
    """Episodes of looking at the same items: they end when the focus changes or goes, or ``idle`` ms after the last sign of life."""

    columns, order = ["items", "source"], [NOW]
    state, result = "items array<long>, source string, start long, last long", "item long, source string, start long, elapsed_ms long"

    def __init__(self, idle: int, least: int):
        self.idle, self.least = idle, least

    def _ended(self, state: tuple, now: int) -> list[tuple]:
        items, source, start, last = state
        elapsed = min(now, last + self.idle) - start
        return [(i, source, start, elapsed) for i in items] if elapsed >= self.least else []

    def told(self, state: tuple | None, rows: list[tuple]) -> Said:
        out = []
        for items, source, now in rows:
            items = [] if items is None or isinstance(items, float) else sorted({int(i) for i in items if i is not None and i == i})
            if state and (items != list(state[0]) or source != state[1] or now - state[3] > self.idle):
                out += self._ended(state, now)
                state = None
            if items:
                state = (items, source, state[2] if state else now, now)
        return out, state, state[3] + self.idle if state else None

    def expired(self, state: tuple, now: int) -> Said:
        return self._ended(state, now), None, None
