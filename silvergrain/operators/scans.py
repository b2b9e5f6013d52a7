"""Folds along the order of a key's rows, in many tasks at once.

Rows are dealt by ranges of (key, order), sorted, and written once; so a stretch of one key's rows
may lie in many tasks. Such a fold goes three steps. Each task sums up what its stretch does to
whatever state it is entered with: a summary, which composes with the next one. One pass over
the summaries, one row a task, tells the true state at the beginning of every stretch. Then
each task replays its stretch from there. Rows are shuffled once, and no task holds more than one
batch of them; a lost executor costs its stretches.

A fold is a ``Fold``: its summaries form a monoid that acts on states.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

KEY, PART, AT = "__key", "__part", "__at"


class Fold(ABC):
    """What a stretch of rows does to a state; rows come as frames in order, without their key."""

    start: Any = None
    #: Columns of the result besides the key, as DDL.
    schema: str

    @abstractmethod
    def summary(self, rows: pd.DataFrame) -> Any:
        """What ``rows`` do to a state."""

    @abstractmethod
    def composed(self, first: Any, then: Any) -> Any:
        """The summary of two stretches in a row."""

    @abstractmethod
    def after(self, state: Any, summary: Any) -> Any:
        """The state behind a stretch that was entered with ``state``."""

    @abstractmethod
    def replay(self, state: Any, rows: pd.DataFrame) -> tuple[pd.DataFrame, Any]:
        """The result's rows of a stretch, and the state behind it."""

    def finish(self, state: Any) -> pd.DataFrame | None:
        """The result's rows when a key ends."""
        return None


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[int, int] | None, str | None, pd.DataFrame]]:
    """(place of a new stretch or None, key, rows of that key only): a stretch begins where the task's rows or a written part do."""
    last = None
    for pdf in frames:
        if not len(pdf):
            continue
        keys, parts = pdf[KEY].to_numpy(object), pdf[PART].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pdf)], strict=True):
            yield (int(parts[a]), int(pdf[AT].iloc[a])) if parts[a] != last else None, keys[a], pdf.iloc[a:b]
            last = parts[a]


def fold(rows: DataFrame, by: str, order: list[str], how: Fold, columns: list[str]) -> DataFrame:
    """(by, ``how.schema``): the fold of ``columns`` of each key's rows in the order of ``order``; a null key is a key."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(list(dict.fromkeys([by, *order, *columns]))).repartitionByRange(n, by, *order).sortWithinPartitions(by, *order)
    placed = written(placed.withColumns({KEY: F.col(by).cast("string"), PART: F.spark_partition_id(), AT: F.monotonically_increasing_id()}), "stretches")
    placed = placed.select(KEY, PART, AT, *dict.fromkeys([*order, *columns]))

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each stretch its place, its first and last key, the summary of the first key's rows, and the state behind the last key's rows if that is another."""
        out: list[tuple] = []
        place = first = key = lead = state = None
        for new, k, piece in _pieces(frames):
            s = how.summary(piece)
            if new is not None:
                if place is not None:
                    out.append((*place, *map(pickle.dumps, (first, key, lead, state))))
                place, first, key, lead, state = new, k, k, s, None
            elif k != key:
                key, state = k, (how.after(how.start, s),)
            elif state is None:
                lead = how.composed(lead, s)
            else:
                state = (how.after(state[0], s),)
        if place is not None:
            out.append((*place, *map(pickle.dumps, (first, key, lead, state))))
        yield pd.DataFrame(out, columns=["part", "at", "first", "last", "lead", "state"])

    told = placed.mapInPandas(summed, "part int, at long, first binary, last binary, lead binary, state binary").collect()  # a row for each part a task reads
    stretches = [(r["part"], r["at"], *(pickle.loads(bytes(r[c])) for c in ("first", "last", "lead", "state"))) for r in sorted(told, key=lambda r: (r["part"], r["at"]))]
    begin: dict[tuple[int, int], tuple[Any, bool]] = {}
    key, state = None, how.start
    for i, (part, at, first, last, lead, own) in enumerate(stretches):
        entered = state if i and first == key else how.start
        begin[part, at] = entered, i + 1 == len(stretches) or stretches[i + 1][2] != last
        key, state = last, how.after(entered, lead) if own is None else own[0]
    shared = spark.sparkContext.broadcast(begin)

    def replayed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def keyed(k: str | None, found: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
            if found is not None and len(found):
                found.insert(0, KEY, pd.Series([k] * len(found), index=found.index, dtype=object))
                yield found

        key, state, ends = None, how.start, False
        begun = False
        for new, k, piece in _pieces(frames):
            if new is not None:
                if begun and ends:
                    yield from keyed(key, how.finish(state))
                (state, ends), begun = shared.value[new], True
            elif k != key:
                yield from keyed(key, how.finish(state))
                state = how.start
            key = k
            found, state = how.replay(state, piece)
            yield from keyed(k, found)
        if begun and ends:
            yield from keyed(key, how.finish(state))

    out = placed.mapInPandas(replayed, f"{KEY} string, {how.schema}")
    return out.select(F.col(KEY).cast(rows.schema[by].dataType).alias(by), *out.columns[1:])


@dataclass(frozen=True)
class RateMap:
    """What measured rates do to a smoothed one: an affine map; behind a restart a constant. ``fresh`` is what they make of none."""

    weight: float
    reset: bool = False
    rate: float | None = None
    factor: float = 1.0
    shift: float = 0.0
    fresh: float | None = None

    def _blend(self, rate: float | None, x: float) -> float:
        return x if rate is None else rate + self.weight * (x - rate)

    def __call__(self, rate: float | None) -> float | None:
        return self.rate if self.reset else self.fresh if rate is None else self.factor * rate + self.shift

    def step(self, x: float | None) -> RateMap:
        """With one rate more; None for a restart."""
        if x is None:
            return RateMap(self.weight, True)
        if self.reset:
            return RateMap(self.weight, True, self._blend(self.rate, x))
        return RateMap(self.weight, False, None, self.factor * (1 - self.weight), self._blend(self.shift, x), self._blend(self.fresh, x))

    def then(self, other: RateMap) -> RateMap:
        if other.reset or self.reset:
            return RateMap(self.weight, True, other(self.rate))
        return RateMap(self.weight, False, None, self.factor * other.factor, other.factor * self.shift + other.shift, other(self.fresh))


class SmoothedRate(Fold):
    """An exponentially smoothed rate a second of a growing counter.

    A counter that falls starts anew; of rows at one time the first counts. State: (time, count, rate)
    of the last row that counted. A summary has the first two rows that count apart, as what they do
    depends on the row before the stretch, and a map for those behind them.
    """

    def __init__(self, t: str, amount: str, weight: float):
        self.t, self.amount, self.weight, self.schema = t, amount, weight, f"{t} timestamp, rate double"

    def _steps(self, rows: pd.DataFrame) -> tuple[np.ndarray, list[int], list]:
        """(each row's step, times and counts of the steps)."""
        times, counts = rows[self.t].to_numpy().astype("datetime64[ns]").astype(np.int64), rows[self.amount].to_numpy()
        own = np.r_[True, times[1:] != times[:-1]]
        return np.cumsum(own) - 1, times[own].tolist(), counts[own].tolist()

    @staticmethod
    def _rate(before: tuple, now: tuple) -> float | None:
        return None if now[1] < before[1] else (now[1] - before[1]) / ((now[0] - before[0]) / 1e9)

    def summary(self, rows: pd.DataFrame) -> tuple[list, tuple, RateMap]:
        _, t, n = self._steps(rows)
        steps, rest = list(zip(t, n, strict=True)), RateMap(self.weight)
        for a, b in zip(steps[1:], steps[2:], strict=False):
            rest = rest.step(self._rate(a, b))
        return steps[:2], steps[-1], rest

    def composed(self, first: tuple, then: tuple) -> tuple:
        (head, last, rest), (head2, last2, rest2) = first, then
        head = list(head)
        for step in head2:
            if step[0] == last[0]:
                continue
            if len(head) < 2:
                head.append(step)
            else:
                rest = rest.step(self._rate(last, step))
            last = step
        return head, last2 if last2[0] != last[0] else last, rest.then(rest2)

    def after(self, state: tuple | None, summary: tuple) -> tuple:
        head, last, rest = summary
        for step in head:
            state = self._entered(state, step)
        return (last if last[0] != state[0] else state[:2]) + (rest(state[2]),)

    def _entered(self, state: tuple | None, step: tuple) -> tuple:
        if state is None or step[1] < state[1] and step[0] != state[0]:
            return (*step, None)
        if step[0] == state[0]:
            return state
        return (*step, RateMap(self.weight, fresh=state[2]).step(self._rate(state, step)).fresh)

    def replay(self, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        step, t, n = self._steps(rows)
        rates = []
        for at in zip(t, n, strict=True):
            state = self._entered(state, at)
            rates.append(state[2])
        return pd.DataFrame({self.t: rows[self.t], "rate": np.array(rates, float)[step]}), state


class Hysteresis(Fold):
    """Segments that open at ``enter`` and close after ``hang`` rows in a row below ``leave``, at the last row above.

    State: None, or (start, end, rows below since). Rows above ``leave`` with fewer than ``hang``
    others between them form an island; a segment lies inside one island, from the first row at
    ``enter`` to the last. A summary has the rows before the first island and behind the last one, and of
    both islands where a segment would open and where they end: that is the table of what
    becomes of each of the states in which the stretch may be entered.
    """

    def __init__(self, at: str, p: str, time: str, enter: float, leave: float, hang: int):
        if enter < leave:
            raise ValueError("a segment can't open below where it may close")
        self.at, self.p, self.enter, self.leave, self.hang = at, p, enter, leave, hang
        self.schema = f"start {time}, end {time}"

    def _islands(self, rows: pd.DataFrame) -> tuple[list[tuple], int, int]:
        """([(opens at or None, last)], rows before the first island, rows behind the last)."""
        at, p = rows[self.at].tolist(), rows[self.p].to_numpy(float)
        with np.errstate(invalid="ignore"):
            hit, opens = np.flatnonzero(p >= self.leave), np.flatnonzero(p >= self.enter)
        if not len(hit):
            return [], len(at), 0
        begin = np.flatnonzero(np.r_[True, np.diff(hit) > self.hang])
        first, last = hit[begin], hit[np.r_[begin[1:], len(hit)] - 1]
        k = np.searchsorted(opens, first)
        open_at = [at[opens[i]] if i < len(opens) and opens[i] <= b else None for i, b in zip(k.tolist(), last.tolist(), strict=True)]
        return [(a, at[b]) for a, b in zip(open_at, last.tolist(), strict=True)], int(hit[0]), len(at) - 1 - int(hit[-1])

    def summary(self, rows: pd.DataFrame) -> tuple:
        islands, before, behind = self._islands(rows)
        return (islands[:1] + islands[-1:] if len(islands) > 1 else islands), before, behind

    def composed(self, first: tuple, then: tuple) -> tuple:
        (a, before, behind), (b, before2, behind2) = first, then
        if not a:
            return b, before + before2, behind2
        if not b:
            return a, before, behind + before2
        if behind + before2 < self.hang:
            middle = a[-1][0] if a[-1][0] is not None else b[0][0], b[0][1]
            joined = [*a[:-1], middle, *b[1:]]
        else:
            joined = [*a, *b]
        return joined[:1] + joined[-1:] if len(joined) > 1 else joined, before, behind2

    def _run(self, state: tuple | None, islands: list[tuple], before: int, behind: int) -> tuple[list[tuple], tuple | None]:
        """(segments that close, the state behind)."""
        closed = []
        if not islands:
            if state is None or state[2] + before < self.hang:
                return [], state and (*state[:2], state[2] + before)
            return [state[:2]], None
        if state is not None:
            if state[2] + before < self.hang:
                islands = [(state[0], islands[0][1]), *islands[1:]]
            else:
                closed.append(state[:2])
        closed += [i for i in islands[:-1] if i[0] is not None]
        last = islands[-1]
        if last[0] is None:
            return closed, None
        return (closed, (*last, behind)) if behind < self.hang else ([*closed, last], None)

    def after(self, state: tuple | None, summary: tuple) -> tuple | None:
        return self._run(state, *summary)[1]

    def replay(self, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None]:
        closed, state = self._run(state, *self._islands(rows))
        return pd.DataFrame(closed, columns=["start", "end"]), state

    def finish(self, state: tuple | None) -> pd.DataFrame | None:
        return None if state is None else pd.DataFrame([state[:2]], columns=["start", "end"])
