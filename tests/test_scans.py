"""Folds that run in many tasks equal the plain loop over each key's rows."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silvergrain.operators import scans, temporal


def slow_rate(rows, weight=0.3):
    out, last = [], {}
    for k, t, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        state = last.get(k)
        if state is None or n < state[1]:
            last[k] = (t, n, None)
        elif t > state[0]:
            now = (n - state[1]) / (t - state[0])
            last[k] = (t, n, now if state[2] is None else state[2] + weight * (now - state[2]))
        out.append((k, t, last[k][2]))
    return out


def slow_segments(rows, enter, leave, hang):
    out, state, key = [], None, object()
    for k, t, p in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if k != key:
            if state:
                out.append((key, *state[:2]))
            key, state = k, None
        if state is None:
            state = (t, t, 0) if p >= enter else None
        elif p >= leave:
            state = (state[0], t, 0)
        else:
            state = (*state[:2], state[2] + 1)
            if state[2] >= hang:
                out.append((key, *state[:2]))
                state = None
    return out + ([(key, *state[:2])] if state else [])


def near(a, b):
    return a == b or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a))


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(3))
def test_rates(small_batches, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for key in ("a", None, "b"):
        t = 0
        for _ in range(rng.choice([3, 150])):
            t += rng.choice([0, 0, 1, 5])
            n = rng.randrange(50) if rng.random() < 0.05 else n + rng.randrange(9)
            rows.append((key, t, n))
    df = small_batches.createDataFrame(rows, "k string, t long, n long").withColumn("t", F.timestamp_seconds("t"))
    got = sorted(((r.k, r.s, r.rate) for r in temporal.smoothed_rate(df, "k", "t", "n").select("k", F.unix_seconds("t").alias("s"), "rate").collect()), key=lambda r: (str(r[0]), r[1], str(r[2])))
    want = sorted(slow_rate(rows), key=lambda r: (str(r[0]), r[1], str(r[2])))
    assert len(got) == len(want) and all(a[:2] == b[:2] and near(a[2] if a[2] == a[2] else None, b[2]) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_segments(small_batches, seed):
    rng = random.Random(seed)
    rows = [(key, t, rng.choice([0.1, 0.1, 0.2, 0.4, 0.4, 0.9])) for key in (1, 2**60 + 1, None) for t in range(rng.choice([2, 400]))]
    df = small_batches.createDataFrame(rows, "k long, t long, p double")
    got = [tuple(r) for r in temporal.segments(df, "k", "t", "p", enter=0.8, leave=0.35, hang=3).collect()]
    assert sorted(got, key=repr) == sorted(slow_segments(rows, 0.8, 0.35, 3), key=repr)
    assert temporal.segments(df.limit(0), "k", "t", "p").count() == 0
    with pytest.raises(ValueError):
        temporal.segments(df, "k", "t", "p", enter=0.1, leave=0.5)


@pytest.mark.parametrize("seed", range(200))
def test_summaries_compose(seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 40)
    cuts = sorted(rng.sample(range(1, n), 2))
    t = np.cumsum([rng.choice([0, 1, 2]) for _ in range(n)])
    frame = pd.DataFrame({"t": pd.to_datetime(t, unit="s"), "n": [rng.randrange(30) for _ in range(n)], "at": range(n), "p": [rng.choice([0.1, 0.4, 0.9]) for _ in range(n)]})
    frame = frame.sort_values(["t", "n"], kind="stable").reset_index(drop=True)
    frame["at"] = range(n)
    a, b, c = frame[: cuts[0]], frame[cuts[0] : cuts[1]], frame[cuts[1] :]
    for how in (scans.SmoothedRate("t", "n", 0.3), scans.Hysteresis("at", "p", "long", 0.8, 0.35, rng.choice([1, 2, 4]))):
        enters = [how.start]
        for part in (a, b):
            enters.append(how.after(enters[-1], how.summary(part)))
        bc = how.composed(how.summary(b), how.summary(c))
        for one, two in ((how.after(enters[1], bc), how.after(enters[2], how.summary(c))), (how.after(enters[1], bc), how.replay(how.replay(enters[1], b)[1], c)[1]), (how.after(how.start, how.composed(how.summary(a), bc)), how.after(enters[1], bc))):
            assert one == two or all(near(x, y) for x, y in zip(one, two, strict=True))


def test_one_key_runs_in_many_tasks(spark):
    """A key that holds all rows is dealt over the tasks, and neither fold has a task with more than its share."""
    n = 200_000
    rows = spark.range(n).select(F.lit(7).alias("k"), F.timestamp_seconds(F.col("id") * 3).alias("t"), (F.col("id") * 5 + F.col("id") % 4).alias("n"), F.col("id").alias("at"), (F.abs(F.sin("id"))).alias("p"))
    began = time.time()
    rates = temporal.smoothed_rate(rows, "k", "t", "n")
    shares = rates.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in shares) == n and len(shares) >= 4 and max(r["count"] for r in shares) < n / 2
    assert temporal.segments(rows, "k", "at", "p", hang=3).count() == len(slow_segments([(7, i, abs(np.sin(i))) for i in range(n)], 0.5, 0.35, 3))
    assert time.time() - began < 120
