"""Timers end what nobody ends, and take the state of silent keys with them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from silvergrain.streaming import streams, timed

T0 = dt.datetime(2026, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def played(spark, tmp_path):
    """Batches of rows, one file each, through an operator; (rows out, state rows after each batch)."""

    def play(batches, schema, operator):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        with timed.timers(spark):
            q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
            q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())), held

    return play


def test_open_segments_come_out_when_silent(played):
    schema = "who string, i long, p double, ts timestamp"
    rows, held = played([[("a", 1, 0.9, at(1)), ("a", 2, 0.6, at(2)), ("b", 1, 0.1, at(1))], [("c", 1, 0.1, at(100))], [("c", 2, 0.1, at(200))]], schema, lambda s: streams.segments(s, "who", "i", "p", "ts"))
    assert rows == [("a", 1, 2)] and held[-1] == 0


def test_rings_of_silent_keys_go(played):
    second = 1_000_000
    rows, held = played(
        [[(1, 10 * second, "s", True), (1, 20 * second, "x", False)], [(2, 500 * second, "t", True)], [(2, 9000 * second, "y", False)]], "who long, at long, value string, is_state boolean",
        lambda s: streams.scope_lookup(s, "who", "at", "value", "is_state", idle_ms=60_000),
    )
    assert rows == [(1, 20 * second, "s", False)] and held[-1] == 0


def test_files_that_are_no_longer_listed_are_forgotten(played):
    schema = "path string, size long, mtime long, ts timestamp"
    rows, held = played([[("a", 1, 1, at(0)), ("a", 1, 1, at(3)), ("b", 1, 1, at(3))], [("b", 2, 1, at(4)), ("b", 2, 1, at(5))], [("c", 1, 1, at(900))], [("c", 2, 1, at(2000))]], schema, lambda s: streams.stable_files(s, "path"))
    assert rows == [("a", 1, 1)] and held[-1] <= 1


def test_episodes(played):
    schema = "who long, ts timestamp, items array<long>, source string"
    batches = [
        [(1, at(0), [7], "look"), (1, at(5), [7], "look"), (2, at(0), [1, 2], "grid"), (2, at(1), [2, 1], "grid")],
        [(1, at(6), None, None), (2, at(2.1), [3], "grid"), (2, at(2.2), [3], "look")],
        [(3, at(10), [9], "look"), (3, at(11), [], "look"), (1, at(9), [8], "look")],
        [(4, at(500), None, None)],
        [(4, at(900), [None], "look")],
    ]
    rows, held = played(batches, schema, lambda s: streams.focus_episodes(s, "who", "ts", "items", "source"))
    ms = lambda s: int(dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000 + s * 1000)
    assert rows == sorted([(1, 7, "look", ms(0), 6000), (2, 1, "grid", ms(0), 2100), (2, 2, "grid", ms(0), 2100), (2, 3, "look", ms(2.2), 30_000), (3, 9, "look", ms(10), 1000), (1, 8, "look", ms(9), 30_000)])
    assert held[-1] == 0


def test_an_idle_row_starts_a_new_episode():
    m = timed.Focus(30_000, 250)
    out, state, deadline = m.told(None, [([5], "look", 0), ([5], "look", 40_000), ([5], "look", 41_000)])
    assert out == [(5, "look", 0, 30_000)] and state == ([5], "look", 40_000, 41_000) and deadline == 71_000


def test_the_setting_comes_back(spark):
    before = spark.conf.get(timed._SETTING)
    with timed.timers(spark):
        assert spark.conf.get(timed._SETTING) == timed.STORE
    assert spark.conf.get(timed._SETTING) == before
