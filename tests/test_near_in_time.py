"""Joins by nearness in time, against plain loops; rows far apart in time don't meet."""

import datetime
import random

from pyspark.sql import functions as F

from silvergrain.operators import catalog as C
from silvergrain.operators import temporal as T
from silvergrain.streaming import streams as R

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_moves_meet_in_time(spark):
    rng = random.Random(1)
    gone = [(i % 2, f"a{i}", at(rng.randrange(300))) for i in range(60)]
    came = [(i % 2, f"b{i}" if i % 9 else f"a{i}", at(rng.randrange(300))) for i in range(80)]
    schema = "image long, rel_path string, ts timestamp"
    found = C.correlate_moves(spark.createDataFrame(gone, schema), spark.createDataFrame(came, schema), window=10)
    want = sorted((k, p, q) for k, p, t in gone for m, q, u in came if k == m and p != q and abs((t - u).total_seconds()) <= 10)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50
    keys = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(keys) == 1 and keys[0].count("__b") == 2  # the bucket is a key of the join


def test_streamed_moves_meet_in_time(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 2, ("gone", "came")[i % 3 == 0], f"p{i}", at(i + rng.randrange(20))) for i in range(200)]
    df = spark.createDataFrame(rows, "image long, kind string, path string, ts timestamp")
    df.where("ts < '2024-01-01 00:01:40'").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("ts >= '2024-01-01 00:01:40'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda kind: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where(F.col("kind") == kind)
    moves = R.moves(stream("gone"), stream("came"), "image", within=10, late="5 minutes")
    assert "__b" in next(line for line in moves._jdf.queryExecution().analyzed().toString().splitlines() if "Join Inner" in line)
    got = sorted(map(tuple, R.run_available(moves, "moves-test").collect()))
    want = sorted((k, p, q) for k, a, p, t in rows for m, b, q, u in rows if (a, b) == ("gone", "came") and k == m and abs((t - u).total_seconds()) <= 10)
    assert got == want and len(want) > 50


def test_nearest_onset_equals_all_pairs_without_pairs(spark):
    rng = random.Random(3)
    for most in (1, 3, 7):
        marks = [(rng.randrange(3), i, at(rng.randrange(400) / 2)) for i in range(150)] + [(None, 900, at(1)), (0, 901, None)]
        onsets = [(rng.randrange(3), rng.randrange(10**6), at(rng.randrange(400) / 2)) for i in range(90)] + [(None, 5, at(1)), (0, 6, None)]
        schema = "lane long, id long, ts timestamp"
        found = T.nearest_onset(spark.createDataFrame(marks, schema), spark.createDataFrame(onsets, schema), "lane", most=most)
        want = {}
        for lane, i, t in marks[:150]:
            near = [(abs((t - u).total_seconds()), o) for m, o, u in onsets[:90] if m == lane and abs((t - u).total_seconds()) <= most]
            if near:
                want[i] = min(near)[1]
        assert {r.id: r.onset for r in found.collect()} == want and len(want) > 40
    # many marks and onsets at one time make no pairs: joins only bring one row a bucket
    crowd = spark.range(4000).select(F.lit(1).alias("lane"), "id", F.lit(START).alias("ts"))
    plan = T.nearest_onset(crowd, crowd, "lane")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan
