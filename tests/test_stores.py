"""Segments, feeds, vector files as a source, watched folders."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvergrain.commits import CommitConflict
from silvergrain.operators.feed import ChangeFeed
from silvergrain.sources import vectorfile as V
from silvergrain.sources.segments import SegmentStore
from silvergrain.sources.watchfolder import watch_changes

SCHEMA = "vec_id long, embedding array<double>"


def rows_of(df):
    return {r.vec_id: list(r.embedding) for r in df.collect()}


def data_bytes(folder):
    return b"".join(open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names)


def test_segments(spark, tmp_path):
    make = lambda ids, x: spark.createDataFrame([(i, [float(i), x]) for i in ids], SCHEMA)
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "vec_id long")
    s = SegmentStore(spark, f"file://{tmp_path}/s", SCHEMA)
    assert s.read().count() == 0
    s.delete(keys(1))
    s.upsert(make(range(10), 0.5))
    s.upsert(make([3, 4, 12], 1.5).union(spark.createDataFrame([(None, [0.0, 0.0]), (12, [0.0, 9.0])], SCHEMA)))
    assert rows_of(s.read()) == {i: [float(i), 1.5 if i in (3, 4, 12) else 0.5] for i in [*range(10), 12]}
    s.delete(keys(0, 0, 77))
    assert sorted(v["dead"] for v in s.manifest()["segments"].values()) == [0, 3]
    s.compact(share=0.5)
    assert s.manifest()["generation"] == 0
    s.compact()
    assert s.manifest()["generation"] == 1 and all(v["dead"] == 0 for v in s.manifest()["segments"].values())
    assert sorted(rows_of(s.read())) == [*range(1, 10), 12]


def test_a_crash_between_steps_changes_nothing(spark, tmp_path, monkeypatch):
    s = SegmentStore(spark, f"file://{tmp_path}/s", SCHEMA)
    s.upsert(spark.createDataFrame([(1, [1.0]), (2, [2.0])], SCHEMA))
    monkeypatch.setattr(s.log, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    for step in (lambda: s.upsert(spark.createDataFrame([(1, [7.0])], SCHEMA)), lambda: s.delete(spark.createDataFrame([(2,)], "vec_id long")), lambda: s._step(lambda m: s._rewritten(m, list(m["segments"])))):
        with pytest.raises(OSError):
            step()
        assert rows_of(SegmentStore(spark, f"file://{tmp_path}/s", SCHEMA).read()) == {1: [1.0], 2: [2.0]}
    again = SegmentStore(spark, f"file://{tmp_path}/s", SCHEMA)
    left = len(again.log.data_folders())
    again.vacuum()
    assert len(again.log.data_folders()) == 1 < left and rows_of(again.read()) == {1: [1.0], 2: [2.0]}


def test_a_writer_that_was_late_tries_again(spark, tmp_path, monkeypatch):
    a, b = (SegmentStore(spark, f"file://{tmp_path}/s", SCHEMA) for _ in range(2))
    a.upsert(spark.createDataFrame([(1, [1.0])], SCHEMA))
    real, once = a.log.commit, []

    def interrupted(n, doc):
        if not once:
            once.append(1)
            b.upsert(spark.createDataFrame([(2, [2.0])], SCHEMA))
        return real(n, doc)

    monkeypatch.setattr(a.log, "commit", interrupted)
    a.upsert(spark.createDataFrame([(2, [5.0]), (3, [3.0])], SCHEMA))
    assert rows_of(b.read()) == {1: [1.0], 2: [5.0], 3: [3.0]}
    monkeypatch.setattr(a.log, "commit", lambda n, d: (_ for _ in ()).throw(CommitConflict()))
    with pytest.raises(CommitConflict):
        a.delete(spark.createDataFrame([(1,)], "vec_id long"))


def test_scrubbed_bytes_are_gone(spark, tmp_path):
    s = SegmentStore(spark, f"file://{tmp_path}/s", SCHEMA, compression="none")
    secret, older, plain = 1234.5678901234, 77.123456789012, 4.25
    s.upsert(spark.createDataFrame([(1, [older]), (2, [plain])], SCHEMA))
    s.upsert(spark.createDataFrame([(1, [secret])], SCHEMA))
    found = lambda x: struct.pack("<d", x) in data_bytes(tmp_path)
    s.delete(spark.createDataFrame([(1,)], "vec_id long"))
    assert found(secret) and found(older) and found(plain), "a delete alone leaves the bytes"
    assert s.scrub(spark.createDataFrame([(1,)], "vec_id long")) == 2
    assert not found(secret) and not found(older) and found(plain) and rows_of(s.read()) == {2: [plain]}
    assert s.scrub(spark.createDataFrame([(9,)], "vec_id long")) == 0


def test_feed(spark, tmp_path):
    feed = ChangeFeed(spark, f"file://{tmp_path}/f", "image", retention=5)
    rows = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "image long, at long")
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "image long")
    got = lambda c: sorted(map(tuple, c.rows.collect()))
    assert feed.publish(rows(1, 2, 1), "at") == 3
    first = feed.poll("a", table(1, 2))
    assert first.reset and first.head == 3 and got(first) == [(1, "upsert"), (2, "upsert")]
    feed.acknowledge("a", first)
    feed.acknowledge("b", first)
    assert got(feed.poll("a", table(1, 2))) == []
    feed.publish(rows(2, 3), "at")
    second = feed.poll("a", table(1, 3))
    assert not second.reset and got(second) == [(2, "removed"), (3, "upsert")]
    feed.acknowledge("a", second)
    feed.acknowledge("a", first)
    assert feed.cursor("a") == 5
    feed.publish(rows(4, 5, 6, 7), "at")
    assert feed.state()["low"] == 4 and feed.changes().count() == 5
    assert not feed.poll("a", table(4)).reset and feed.poll("b", table(4)).reset
    assert got(feed.poll("a", table(4))) == [(4, "upsert"), (5, "removed"), (6, "removed"), (7, "removed")]
    feed.publish(rows(*range(20)), "at")
    assert len(feed.log.data_folders()) == 1, "layers below the mark are gone"
    assert ChangeFeed(spark, f"file://{tmp_path}/f", "image", retention=5).state()["head"] == 29


def test_vector_files_by_rows(spark, tmp_path):
    m = np.random.default_rng(1).standard_normal((1000, 6)).astype("float32")
    for i in range(2):
        (tmp_path / f"v{i}.bin").write_bytes(V.encode_file(m[i * 500 : i * 500 + 500]))
    every = V.read_vectors(spark, f"{tmp_path}", rows=128)
    assert every.count() == 1000 and every.rdd.getNumPartitions() == 8
    some = {(os.path.basename(r.path), r.row): r.embedding for r in V.read_vectors(spark, f"file://{tmp_path}", first=130, last=131).collect()}
    assert sorted(some) == [("v0.bin", 130), ("v0.bin", 131), ("v1.bin", 130), ("v1.bin", 131)]
    assert np.abs(np.array(some["v1.bin", 131]) - m[631]).max() < 0.05
    assert V.read_vectors(spark, f"{tmp_path}", first=500).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        V.read_vectors(spark, f"{tmp_path}/none").count()


def test_a_file_beyond_two_gb_is_read_in_part(spark, tmp_path):
    dims, rows = 512, 5_000_000
    small = V.encode_file(np.stack([np.full(dims, -127.0), np.full(dims, 127.0)]).astype("float32"))
    with open(tmp_path / "big.bin", "wb") as f:  # sparse: the middle is never written
        f.write(small)
        f.truncate(V.HEADER + 8 * dims + rows * dims)
        f.seek(V.HEADER + 8 * dims + 4_999_990 * dims)
        f.write(bytes([5]) * dims)
    assert os.path.getsize(tmp_path / "big.bin") > 2**31
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = V.read_vectors(spark, f"{tmp_path}/big.bin").where("row >= 4999990 AND row < 4999992 AND path IS NOT NULL")
        assert part.rdd.getNumPartitions() == 1
        got = sorted((r.row, r.embedding[0], len(r.embedding)) for r in part.collect())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert got == [(4_999_990, 5.0, dims), (4_999_991, 0.0, dims)]


def test_vectors_are_written_in_files(spark, tmp_path):
    m = np.random.default_rng(2).standard_normal((90, 4)).astype("float32")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<float>").coalesce(1)
    places = {r.vec_id: (os.path.basename(r.path), r.row) for r in V.write_vectors(df, f"file://{tmp_path}/w", rows=40).collect()}
    back = {(os.path.basename(r.path), r.row): r.embedding for r in V.read_vectors(spark, f"file://{tmp_path}/w").collect()}
    assert len(back) == 90 and len({p for p, _ in places.values()}) == 3
    assert all(np.abs(np.array(back[places[i]]) - m[i]).max() < 0.05 for i in range(90))


def test_watched_folder(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    (root / "a").mkdir(parents=True)

    def turn():
        before = {f for f in os.listdir(out) if f.endswith(".parquet")} if out.exists() else set()
        q = watch_changes(spark, f"file://{root}", f"file://{tmp_path}/state", shards=2).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        new = [f"{out}/{f}" for f in os.listdir(out) if f.endswith(".parquet") and f not in before]
        return sorted((r.path, r.change, r.size) for r in spark.read.parquet(*new).collect()) if new else []

    (root / "a" / "x.jpg").write_text("1")
    (root / "y.jpg").write_text("22")
    assert turn() == [("a/x.jpg", "created", 1), ("y.jpg", "created", 2)]
    assert turn() == [], "starting again repeats nothing"
    (root / "y.jpg").write_text("333")
    (root / "a" / "x.jpg").unlink()
    (root / "z.jpg").write_text("")
    assert turn() == [("a/x.jpg", "removed", 1), ("y.jpg", "changed", 3), ("z.jpg", "created", 0)]
    (root / "a" / "x.jpg").write_text("4444")
    assert turn() == [("a/x.jpg", "created", 4)]
    assert len(list((tmp_path / "state").glob("*.parquet"))) <= 2
