"""Sessions, bursts, and joins by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import TUNING
from . import scans


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp, with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / 1e6


def sessions(events: DataFrame, who: str, ts: str = "ts", gap: int = TUNING.session_gap_seconds) -> DataFrame:
    """(who, start, end, n): a session ends when the next activity is ``gap`` seconds or more away.

    The session's end is its last activity. ``session_window`` closes only beyond its gap, so
    it gets a gap that is one microsecond shorter; it aggregates before the shuffle.
    """
    window = F.session_window(F.col(ts), f"{gap * 1_000_000 - 1} microseconds")
    return events.groupBy(F.col(who), window.alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).select(who, "start", "end", "n")


def bursts(rows: DataFrame, folder: str, ts: str, item: str, gap: int = TUNING.session_gap_seconds, least: int = TUNING.burst_size) -> DataFrame:
    """(folder, start, n, members): runs in a folder whose gaps are at most ``gap`` seconds, of ``least`` items or more."""
    window = F.session_window(F.col(ts), f"{gap} seconds")
    found = rows.where(F.col(ts).isNotNull()).groupBy(F.col(folder), window.alias("w")).agg(F.min(ts).alias("start"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(item)).alias("members"))
    return found.where(F.col("n") >= least).select(folder, "start", "n", "members")


def as_of(facts: DataFrame, states: DataFrame, by: str, ts: str, key: str, state_ts: str, value: str, bucket_seconds: int = 86_400) -> DataFrame:
    """``facts`` with the newest state not after each, or the oldest state and ``predated`` where all are later.

    Both sides are sorted together within buckets of time, so a key with very many rows is
    spread over tasks; the last state of each bucket, one row a bucket, is carried forward. No
    pairs are formed. Facts of a key without any state have a null state.
    """
    kept = [c for c in facts.columns if c not in (by, ts)]
    bucket = lambda c: F.floor(micros(c) / (bucket_seconds * 1_000_000)).alias("__b")
    left = facts.select(by, bucket(ts), F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*kept).alias("__fact"), F.lit(None).cast("long").alias("__k"), F.lit(None).cast(states.schema[value].dataType).alias("__v"))
    right = states.select(by, bucket(state_ts), F.col(state_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__fact"].dataType).alias("__fact"), F.col(key).cast("long").alias("__k"), F.col(value).alias("__v"))
    both = left.unionByName(right)
    state = F.when(F.col("__side") == 0, F.struct("__t", "__k", "__v"))
    inside = both.withColumn("__in", F.last(state, ignorenulls=True).over(W.partitionBy(by, "__b").orderBy("__t", "__side", "__k").rowsBetween(W.unboundedPreceding, 0))).where("__side = 1")
    buckets = both.groupBy(by, "__b").agg(F.max(state).alias("__last"))
    carried = buckets.select(by, "__b", F.last("__last", ignorenulls=True).over(W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    oldest = right.groupBy(by).agg(F.min(F.struct("__t", "__k", "__v")).alias("__first"))
    joined = inside.join(carried, [by, "__b"], "left").join(oldest, by, "left")
    found = F.coalesce("__in", "__before")
    return joined.select(by, F.col("__t").alias(ts), "__fact.*", F.coalesce(found, F.col("__first"))["__v"].alias(value), (found.isNull() & F.col("__first").isNotNull()).alias("predated"))


def link_intervals(spans: DataFrame, candidates: DataFrame, by: str, gap: int = TUNING.link_gap_seconds, gate: str | None = None) -> DataFrame:
    """(id, candidate): for each span (by, id, start, end) the candidate it overlaps most, else the nearest within ``gap`` seconds.

    Ties go to the greatest candidate id. The nearest only counts where ``gate`` (a column of
    both) is equal. Both sides are dealt into time buckets that a span and its surroundings
    touch, so only neighbours in time meet.
    """
    width = max(60, 6 * gap)
    bucket = lambda c: F.floor(micros(c) / (width * 1_000_000))
    wide = spans.withColumn("__b", F.explode(F.sequence(bucket(F.col("start")) - 1, bucket(F.col("end")) + 1)))
    near = candidates.select(F.col(by), F.col("id").alias("candidate"), F.col("start").alias("__cs"), F.col("end").alias("__ce"), *([F.col(gate).alias("__gate")] if gate else []))
    near = near.withColumn("__b", F.explode(F.sequence(bucket(F.col("__cs")), bucket(F.col("__ce")))))
    overlap = seconds_between(F.least("end", "__ce"), F.greatest("start", "__cs"))
    pairs = wide.join(near, [by, "__b"]).where(F.col("id") != F.col("candidate")).withColumn("__o", overlap)
    away = F.greatest(-F.col("__o"), F.lit(0.0))
    allowed = (F.col("__o") > 0) | ((away <= gap) & (F.col(gate).eqNullSafe(F.col("__gate")) if gate else F.lit(True)))
    rank = F.struct(F.when(F.col("__o") > 0, 1).otherwise(0), F.when(F.col("__o") > 0, F.col("__o")).otherwise(-away), "candidate")
    return pairs.where(allowed).groupBy("id").agg(F.max(rank).alias("r")).select("id", F.col("r.candidate").alias("candidate"))


def nearest_onset(marks: DataFrame, onsets: DataFrame, by: str, most: int = 2) -> DataFrame:
    """(id, onset): for each mark (by, id, ts) the nearest onset (by, id, ts) within ``most`` seconds; ties to the lesser id.

    Both sides are sorted together within buckets of time not shorter than ``most``; the first and the
    last onset of a bucket, one row a bucket, reach into its neighbours. No pairs are formed.
    """
    width = max(int(most * 1_000_000), 1)
    bucket = F.floor(F.col("__t") / width)
    onset = F.when(F.col("__side") == 0, F.struct("__t", F.col("id").alias("onset")))
    # of onsets at one time only the least can be the nearest
    sides = onsets.where(F.col(by).isNotNull()).select(by, micros("ts").alias("__t"), "id").groupBy(by, "__t").agg(F.min("id").alias("id")).withColumn("__side", F.lit(0)).unionByName(marks.where(F.col(by).isNotNull()).select(by, micros("ts").alias("__t"), "id", F.lit(1).alias("__side"))).withColumn("__b", bucket)
    order = W.partitionBy(by, "__b").orderBy("__t", "__side")
    before = F.last(onset, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    # an onset at the mark's own time lies before it in this order, and is seen there
    after = F.first(onset, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    inside = sides.select(by, "__b", "__t", "id", "__side", before.alias("__before"), after.alias("__after")).where("__side = 1 AND __t IS NOT NULL")
    ends = sides.where("__side = 0").groupBy(by, "__b").agg(F.min(F.struct("__t", F.col("id").alias("onset"))).alias("__first"), F.max(F.struct("__t", F.col("id").alias("onset"))).alias("__last"))
    near = inside.join(ends.select(by, (F.col("__b") + 1).alias("__b"), "__last"), [by, "__b"], "left").join(ends.select(by, (F.col("__b") - 1).alias("__b"), "__first"), [by, "__b"], "left")
    skew = lambda c: F.when(F.abs(F.col(c)["__t"] - F.col("__t")) <= most * 1_000_000, F.struct(F.abs(F.col(c)["__t"] - F.col("__t")).alias("s"), F.col(c)["onset"].alias("onset")))
    found = near.select("id", F.least(*map(skew, ("__before", "__after", "__last", "__first"))).alias("r")).where("r IS NOT NULL")
    return found.groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.onset").alias("onset"))


def smoothed_rate(samples: DataFrame, by: str, t: str, amount: str, weight: float = 0.3) -> DataFrame:
    """(by, t, rate): exponentially smoothed rate a second of a growing counter, per key.

    A counter that falls starts anew, a clock that stands still changes nothing. A key's rows may lie
    in many tasks (``scans``).
    """
    return scans.fold(samples, by, [t, amount], scans.SmoothedRate(t, amount, weight), [t, amount])


def segments(probabilities: DataFrame, by: str, at: str, p: str, enter: float = TUNING.vad_enter, leave: float = TUNING.vad_exit, hang: int = TUNING.vad_hang) -> DataFrame:
    """(by, start, end): speech by hysteresis: opens at ``enter``, closes after ``hang`` windows below ``leave``, at the last one above.

    A segment still open when the key ends is closed there. A key's windows may lie in many tasks.
    """
    return scans.fold(probabilities, by, [at], scans.Hysteresis(at, p, probabilities.schema[at].dataType.simpleString(), enter, leave, hang), [at, p])


#: Seconds after which a write that failed so many times is tried again, then always the last.
BACKOFF = (1, 5, 30, 300)


def retry_at(failed: Column, attempts: Column) -> Column:
    """When a write that has failed ``attempts`` times (1 or more), the last time at ``failed``, may be tried again; null if none failed."""
    steps = F.array(*map(F.lit, BACKOFF))
    wait = F.element_at(steps, F.least(attempts, F.lit(len(BACKOFF))).cast("int"))
    return F.when(attempts >= 1, F.timestamp_micros(micros(failed) + wait * 1_000_000))


def debounced(marks: DataFrame, by: str, ts: str = "ts", quiet: float = 2.0, cap: float = 5.0, immediate: str | None = None) -> DataFrame:
    """(by, first, last, due): writes due ``quiet`` seconds after a key's last mark, ``cap`` seconds after the first of a run at most.

    Marks more than ``quiet`` apart are separate runs; a run longer than the cap is written
    every ``cap`` seconds, each write starting the next run with the first mark after it. A mark whose
    column ``immediate`` is true is due itself and ends its run; of marks at one time it is the last.
    """
    flagged = marks.select(by, ts, (F.coalesce(immediate, F.lit(False)) if immediate else F.lit(False)).alias("__now"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, last, out = None, None, None, []
        q, c = pd.Timedelta(seconds=quiet), pd.Timedelta(seconds=cap)
        for pdf in batches:
            for k, t, now in zip(pdf[by].tolist(), pdf[ts].tolist(), pdf["__now"].tolist(), strict=True):
                if first is not None and (k != key or t > min(last + q, first + c)):
                    out.append((key, first, last, min(last + q, first + c)))
                    first = None
                if first is None:
                    key, first = k, t
                last = t
                if now:
                    out.append((key, first, last, t))
                    first = None
            yield pd.DataFrame(out, columns=[by, "first", "last", "due"])
            out = []
        if first is not None:
            yield pd.DataFrame([(key, first, last, min(last + q, first + c))], columns=[by, "first", "last", "due"])

    kind = marks.schema[by].dataType.simpleString()
    return flagged.repartition(by).sortWithinPartitions(by, ts, "__now").mapInPandas(fold, f"{by} {kind}, first timestamp, last timestamp, due timestamp")


def dwell(episodes: DataFrame, item: str, elapsed_ms: str, rate: Column, ts: str, cap: int = TUNING.dwell_cap_ms, least_ms: int = 250) -> DataFrame:
    """(item, dwell_ms, episodes, last_ts): credited looking time; episodes under ``least_ms`` don't count."""
    credit = F.least(F.lit(cap), F.floor(rate * F.greatest(F.col(elapsed_ms), F.lit(0)))).cast("long")
    return episodes.where(F.col(elapsed_ms) >= least_ms).groupBy(item).agg(F.sum(credit).alias("dwell_ms"), F.count(F.lit(1)).alias("episodes"), F.max(ts).alias("last_ts"))
