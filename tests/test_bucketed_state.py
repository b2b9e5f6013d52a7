"""Keys of a bucket share calls and rows of state, and don't disturb one another."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import temporal
from silvergrain.streaming import streams, timed

T0 = dt.datetime(2026, 1, 1)
BIG = 2**53 + 1


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def played(spark, tmp_path):
    """Batches of rows, one file each, through an operator; (rows out, state rows after each batch)."""

    def play(batches, schema, operator, name="t"):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}"))
        with timed.timers(spark):
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-log").trigger(availableNow=True).start()
            q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}-out").collect()), key=repr), held

    return play


FOCUS = "who long, ts timestamp, items array<long>, source string"


def test_debounced_state_has_no_row_for_each_key(played):
    marks = [(k, at(k % 7), k % 3 == 0) for k in range(3000)]
    rows, held = played([marks, [(-1, at(100), False)]], "who long, ts timestamp, now boolean", lambda s: streams.debounced(s, "who", immediate="now"))
    assert rows == sorted([(k, t, t, t if now else t + dt.timedelta(seconds=2)) for k, t, now in marks], key=repr)
    assert 0 < max(held) <= timed.BUCKETS


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_keys_of_one_bucket_are_apart(spark, played, monkeypatch, kind):
    monkeypatch.setattr(timed, "BUCKETS", 1)
    rng, t, rows = random.Random(5), 0.0, []
    keys = {"long": [BIG, BIG + 1, None, 3], "string": ["a", "", None, "é"], "binary": [b"\xff", b"\xfe", None, b""]}[kind]
    for _ in range(240):
        t += rng.choice((0.1, 0.4, 1.5, 4))
        rows.append((rng.choice(keys), at(t), rng.random() < 0.1))
    schema = f"who {kind}, ts timestamp, now boolean"
    got, _ = played([rows[:80], rows[80:160], rows[160:], [(keys[0], at(t + 1000), False)]], schema, lambda s: streams.debounced(s, "who", immediate="now"))
    plain = spark.createDataFrame(rows, schema).withColumn("who", F.hex("who") if kind == "binary" else F.col("who").cast("string"))
    want = temporal.debounced(plain, "who", immediate="now").select(F.unhex("who") if kind == "binary" else F.col("who").cast(kind), "first", "last", "due")
    assert got == sorted(map(tuple, want.collect()), key=repr)


def test_what_is_due_at_the_watermark_comes_out(played):
    """The watermark ends ten seconds behind the last row, just where the first key's write is due."""
    rows, _ = played([[(1, at(0)), (2, at(12)), (3, at(12.001))]], "who long, ts timestamp", lambda s: streams.debounced(s.where("who < 3"), "who"), "d")
    assert rows == [(1, at(0), at(0), at(2))]


def test_another_time_zone_gives_the_same_instants(spark, played):
    zone = spark.conf.get("spark.sql.session.timeZone")
    marks = [(1, "2026-01-01T00:00:00Z"), (1, "2026-01-01T00:00:01Z"), (1, "2026-01-01T01:00:00Z")]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows, _ = played([[m] for m in marks], "who long, t string", lambda s: streams.debounced(s.select("who", F.col("t").cast("timestamp").alias("ts")), "who").select(*(F.unix_seconds(c).alias(c) for c in ("first", "last", "due"))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    begin = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    assert rows == [(begin, begin + 1, begin + 3)]


def test_focus_state_has_no_row_for_each_key(played):
    rows, held = played([[(k, at(k % 7), [k], "look") for k in range(3000)], [(-1, at(500), None, None)]], FOCUS, lambda s: streams.focus_episodes(s, "who", "ts", "items", "source"))
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert rows == sorted([(k, k, "look", start + k % 7 * 1000, 30_000) for k in range(3000)], key=repr)
    assert 0 < max(held) <= timed.BUCKETS and held[-1] == 0


def test_machines_of_one_bucket_are_apart(spark, played, monkeypatch):
    rng, batches = random.Random(8), []
    for b in range(4):
        batches.append([(rng.choice([BIG, BIG + 1, None]), at(b * 60 + i), rng.choice([[1], [2, 1], None]), rng.choice(["look", "grid"])) for i in range(50)])
    batches.append([(7, at(5000), None, None)])
    run = lambda s: streams.focus_episodes(s, "who", "ts", "items", "source")
    each = []
    for i, k in enumerate([BIG, BIG + 1, None]):
        rows, _ = played([[r for r in b if r[0] in (k, 7)] or [(7, at(0), None, None)] for b in batches], FOCUS, run, f"own{i}")
        each += rows
    monkeypatch.setattr(timed, "BUCKETS", 1)
    rows, held = played(batches, FOCUS, run)
    assert rows == sorted(each, key=repr) and len(rows) > 100 and held[-1] == 0


def test_an_episode_that_ends_at_the_watermark_comes_out(played):
    rows, _ = played([[(1, at(0), [1], "look"), (2, at(0.001), [1], "look"), (3, at(40), None, None)]], FOCUS, lambda s: streams.focus_episodes(s, "who", "ts", "items", "source"), "f")
    assert [r[0] for r in rows] == [1]
