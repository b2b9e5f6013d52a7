"""Pairs near in time by blocks: whole results, and nothing as large as the pairs before they are used."""

import datetime as dt
import random

from pyspark.sql import functions as F

from silvergrain.operators import near
from silvergrain.plans import stream_plans
from silvergrain.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_the_stream_writes_blocks_not_moves(spark, tmp_path):
    rows = [(i, at(i * 3), ("error", "view")[i // 4 % 2]) for i in range(1200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = stream_plans.stream_moves(spark, str(tmp_path))
    want = [(i % 4, f"f{i}", f"f{j}") for i, _, a in rows for j, _, b in rows if (a, b) == ("error", "view") and i % 4 == j % 4]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 90_000
    assert spark.read.parquet(*found.inputFiles()).count() < 100


def test_blocks_pair_as_rows_do(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 5)
    monkeypatch.setattr(near, "HELD", 40)
    monkeypatch.setattr(near, "SLICE", 3)
    rng = random.Random(4)
    side = lambda name, n: [(rng.choice(("k", "l", None)), rng.choice((None, f"{name}{i}")), rng.choice((None, at(rng.randrange(-40, 40)), at(5), at(-10)))) for i in range(n)]
    gone, came = side("a", 150), side("b", 130)
    blocks = lambda rows, name: near.blocks(spark.createDataFrame(rows, "k string, path string, ts timestamp"), "k", F.col("path"), F.unix_micros("ts"), 10).withColumnRenamed("rows", name)
    g, c = blocks(gone, "gone"), blocks(came, "came")
    sizes = [len(r.gone) for r in g.collect()]
    assert max(sizes) <= 5 and sum(sizes) == sum(k is not None and t is not None for k, _, t in gone)
    found = near.pairs(near.reaching(g).join(c, ["k", "__b"]), "k", 10)
    want = [(k, p, q) for k, p, t in gone for m, q, u in came if k and k == m and t and u and abs((t - u).total_seconds()) <= 10]
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, found.collect())) == order(want) and len(want) > 500


def test_streamed_blocks_of_several_batches_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(i % 2, ("gone", "came")[i % 3 == 0], f"p{i}", at(i + rng.randrange(20))) for i in range(240)]
    schema = "image long, kind string, path string, ts timestamp"
    for i in range(4):  # each file behind the one before, and within lateness of it
        spark.createDataFrame(rows[60 * i : 60 * i + 60], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    stream = lambda kind: streams.table_stream(spark, str(tmp_path), "t").where(F.col("kind") == kind)
    met = streams.run_available(streams.move_blocks(stream("gone"), stream("came"), "image", within=10, late="5 minutes"), "blocks")
    want = sorted((k, p, q) for k, a, p, t in rows for m, b, q, u in rows if (a, b) == ("gone", "came") and k == m and abs((t - u).total_seconds()) <= 10)
    assert sorted(map(tuple, near.pairs(met, "image", 10).collect())) == want and len(want) > 200
