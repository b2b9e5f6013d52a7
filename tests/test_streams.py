"""Streaming forms against their batch forms, and documents by round trip."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import select, temporal
from silvergrain.plans import stream_plans
from silvergrain.sources import sidecars, vectorfile
from silvergrain.streaming import streams

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """Rows written as several files, which arrive one a batch."""

    def write(rows, schema, parts=3):
        df = spark.createDataFrame(rows, schema)
        for i in range(parts):
            size = -(-len(rows) // parts)
            part = rows[i * size : (i + 1) * size]
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
        return df, streams.table_stream(spark, str(tmp_path), "t")

    return write


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def moments(n, seed=1, step=900):
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice((1, 60, step, step * 3))
        out.append((i % 3, T0 + dt.timedelta(seconds=t), i))
    return out


def test_sessions(spark, feed):
    batch, stream = feed(moments(120), "who long, ts timestamp, id long")
    got = rows_of(streams.run_available(streams.sessions(stream, "who"), "s"), "who", "start", "end", "n")
    want = rows_of(temporal.sessions(batch, "who"), "who", "start", "end", "n")
    assert set(got) <= set(want)
    newest = max(w[2] for w in want)
    assert all(newest - w[2] <= dt.timedelta(minutes=40) for w in set(want) - set(got))  # gap and lateness: still open


def test_debounce(spark, feed):
    batch, stream = feed(moments(120, step=3), "who long, ts timestamp, id long")
    got = rows_of(streams.run_available(streams.debounced(stream, "who", quiet=2, cap=5), "d"), "who", "first", "last", "due")
    want = rows_of(temporal.debounced(batch, "who"), "who", "first", "last", "due")
    assert set(got) <= set(want)
    newest = max(w[2] for w in want)
    assert all(newest - w[3] <= dt.timedelta(seconds=20) for w in set(want) - set(got))  # quiet time and lateness: not due yet


def test_segments(spark, feed):
    rng = random.Random(3)
    rows = [(i % 2, i, rng.random(), T0 + dt.timedelta(seconds=i)) for i in range(200)]
    batch, stream = feed(rows, "who long, i long, p double, ts timestamp")
    got = rows_of(streams.run_available(streams.segments(stream, "who", "i", "p", "ts", hang=3), "g"), "who", "start", "end")
    want = rows_of(temporal.segments(batch, "who", "i", "p", hang=3), "who", "start", "end")
    assert set(got) <= set(want) and len(want) - len(got) <= 2


def test_moves_and_finals(spark, feed):
    rows = [(1, "old", T0, "removed"), (1, "new", T0 + dt.timedelta(seconds=4), "created"), (2, "a", T0, "removed"), (2, "b", T0 + dt.timedelta(seconds=40), "created")]
    _, stream = feed(rows, "image long, path string, ts timestamp, what string", parts=1)
    got = streams.run_available(streams.moves(stream.where("what = 'removed'"), stream.where("what = 'created'"), "image"), "m")
    assert rows_of(got, "image", "old_path", "new_path") == [(1, "old", "new")]


def test_finals_once(spark, feed):
    rows = [("u1", "partial", T0), ("u1", "final", T0 + dt.timedelta(seconds=1)), ("u1", "final", T0 + dt.timedelta(seconds=2)), ("u2", "final", T0 + dt.timedelta(seconds=3))]
    _, stream = feed(rows, "utterance string, kind string, ts timestamp", parts=1)
    assert rows_of(streams.run_available(streams.finals(stream), "f"), "utterance") == [("u1",), ("u2",)]


def test_files_must_stand_still(spark, feed):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", 1, 1, at(0)), ("a", 2, 2, at(1)), ("b", 5, 5, at(0)), ("a", 2, 2, at(2)), ("b", 5, 5, at(3)), ("a", 2, 2, at(9)), ("b", 5, 5, at(9))]
    _, stream = feed(rows, "path string, size long, mtime long, ts timestamp")
    assert rows_of(streams.run_available(streams.stable_files(stream, "path"), "w"), "path", "size") == [("a", 2), ("b", 5)]


def test_scope_keeps_the_newest_state(spark, feed):
    second = 1_000_000
    rows = [(1, 5 * second, "early", False), (1, 10 * second, "s1", True), (1, 20 * second, "x", False), (1, 900 * second, "y", False), (1, 901 * second, "s2", True), (1, 950 * second, "z", False)]
    _, stream = feed(rows, "who long, at long, value string, is_state boolean")
    got = rows_of(streams.run_available(streams.scope_lookup(stream, "who", "at", "value", "is_state"), "r"), "at", "value", "predated")
    assert got == [(20 * second, "s1", False), (900 * second, "s1", False), (950 * second, "s2", False)]


def test_changes_come_in_numbered_batches(spark, feed, tmp_path):
    _, stream = feed([(i,) for i in range(9)], "id long")
    seen = {}
    streams.apply_changes(stream, lambda df, n: seen.__setitem__(n, df.count()), f"{tmp_path}/log")
    assert sum(seen.values()) == 9 and sorted(seen) == list(range(len(seen)))


def test_documents_keep_what_they_do_not_know(spark, tmp_path):
    folder = tmp_path / "documents" / "shard=0"
    folder.mkdir(parents=True)
    (folder / "x.txt").write_text('{"version": 1, "image": 5, "events": [], "mood": "calm"}\n{"version": 9, "image": 6}\nnot json\n')
    got = sidecars.parse(spark, str(tmp_path)).collect()
    assert sorted((r.image, r.bad) for r in got if r.image) == [(5, False), (6, True)] and sum(r.bad for r in got) == 2
    known = sidecars.parse(spark, str(tmp_path)).where("image = 5").select(sidecars.unknown_members().alias("u")).head()
    assert known.u == {"mood": "calm"}


def test_flat_vectors_and_query_sets(spark, tmp_path):
    import numpy as np

    m = np.random.default_rng(1).standard_normal((30, 6)).astype("float32")
    (tmp_path / "v.bin").write_bytes(vectorfile.encode_file(m))
    got = sorted((r.row, r.embedding) for r in vectorfile.read_vectors(spark, f"{tmp_path}/v.bin").collect())
    assert len(got) == 30 and np.abs(np.array([v for _, v in got]) - m).max() < 0.05
    (tmp_path / "q.json").write_text('{"default_k": 7, "queries": [{"query": "fog", "relevant": ["a", "b"]}, {"query": "none", "relevant": []}]}')
    assert {(r["query"], r.k, r["item"]) for r in vectorfile.query_set(spark, f"{tmp_path}/q.json").collect()} == {("fog", 7, "a"), ("fog", 7, "b"), ("none", 7, None)}


@pytest.mark.parametrize("method", sorted(select.METHODS))
def test_greedy_choices_equal_a_plain_scan(method):
    """Every pick is the best by the method's own rule, recomputed from scratch."""
    rng = random.Random(11)
    for _ in range(30):
        nodes = list(range(14))
        near = {n: {} for n in nodes}
        for _ in range(30):
            a, b = rng.sample(nodes, 2)
            near[a][b] = near[b][a] = rng.choice((0.5, 0.7, 0.8, 0.9))
        quality = {n: float(rng.randrange(3)) for n in nodes}
        limit, weight = 0.75, 0.6
        sim = lambda a, b: 1.0 if a == b else near[a].get(b, 0.0)  # noqa: E731, B023
        chosen = []
        if method != "facility":
            chosen = [min(nodes, key=lambda n: (-quality[n], n))]
        while True:
            best = {n: max([sim(n, c) for c in chosen if method != "facility" or sim(n, c) >= limit] or [0.0]) for n in nodes}
            free = [n for n in nodes if n not in chosen]
            if method == "facility":
                if all(best[n] >= limit for n in nodes):
                    break
                value = lambda c: sum(max(0.0, sim(c, n) - best[n]) for n in nodes if sim(c, n) >= limit and (n != c or best[c] < limit))  # noqa: E731, B023
            else:
                free = [n for n in free if best[n] < limit]
                value = (lambda c: weight * quality[c] - (1 - weight) * best[c]) if method == "mmr" else (lambda c: 1 - best[c])  # noqa: B023
            if not free:
                break
            chosen.append(min(free, key=lambda c: (-round(value(c), 9), -quality[c], c)))
        assert set(select.METHODS[method](nodes, near, quality, limit, weight)) == set(chosen)


@pytest.mark.parametrize("query", ["stream_debounce", "stream_immediate", "stream_focus", "stream_sessions", "stream_scope"])
def test_a_table_in_files_that_overlap_in_time_is_read_whole(spark, data, tmp_path, query):
    spark.read.parquet(f"{data}/events.parquet").repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    one, many = (sorted(map(tuple, getattr(stream_plans, query)(spark, folder).collect()), key=repr) for folder in (data, str(tmp_path)))
    assert one == many and one
