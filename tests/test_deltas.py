"""Signed changes and committed versions."""

import random

import pytest
from pyspark.sql import functions as F

from silvergrain.commits import CommitConflict, CommitLog
from silvergrain.operators import deltas as D


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_commits_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/t")
    assert log.latest() == -1 and log.head() == {}
    log.commit(0, {"a": 1})
    with pytest.raises(CommitConflict):
        CommitLog(spark, f"file://{tmp_path}/t").commit(0, {"a": 2})
    log.commit(1, {"a": "é"})
    assert log.head() == {"a": "é"} and log.numbers() == [0, 1] and log.read(0) == {"a": 1}
    log.forget(1)
    assert log.numbers() == [1]


def test_changes_lead_from_the_old_table_to_the_new(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.randrange(5), rng.choice("ab")) for _ in range(n)]
    old, new = (spark.createDataFrame(rows(n), "k long, s string") for n in (12, 9))
    change = D.replaced(old, new)
    assert change.where("weight = 0").count() == 0
    assert bag(D.applied(old, change)) == bag(new)
    assert D.replaced(old, old).count() == 0


def test_counters(spark, tmp_path):
    t = D.CounterTable(spark, f"file://{tmp_path}/c", ["k"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    assert t.read() is None
    assert t.merge(rows(("a", 2), ("b", 1), ("a", 1)), "one") == 0
    assert t.merge(rows(("b", -1), ("c", 4), (None, 1)), "two") == 1
    want = [("'a'", 3), ("'c'", 4), ("None", 1)]
    assert sorted((repr(r.k), r.n) for r in t.read().collect()) == sorted(want)
    assert t.merge(rows(("b", 50)), "two") == 1, "a batch that comes again changes nothing"
    with pytest.raises(Exception, match="below zero"):
        t.merge(rows(("a", -9)), "three")
    assert t.log.latest() == 1 and bag(t.read(0)) == [("a", 3), ("b", 1)]


def test_a_root_that_goes_takes_its_images(spark):
    paths = spark.createDataFrame([(1, "active", 0), (1, "stale", 1), (2, "active", 1), (3, "active", None), (4, "stale", 0)], "image long, state string, root long")
    roots = lambda second: spark.createDataFrame([(0, "active"), (1, second)], "root long, state string")
    none = paths.limit(0)
    assert bag(D.eligible(paths, roots("active"))) == [(1,), (2,), (3,)] and bag(D.eligible(paths)) == [(1,), (2,), (3,)]
    assert bag(D.eligibility_change(paths, paths, none, roots("active"), roots("retired"))) == [(2, -1)]
    passes = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y")], "image long, state string")
    change = D.replaced(passes.where("image = 3"), spark.createDataFrame([(3, "x")], passes.schema))
    flips = D.eligibility_change(paths, paths, none, roots("active"), roots("retired"))
    out = D.counted(D.eligible_change(passes, change, D.eligible(paths, roots("retired")), flips), ["state"])
    assert bag(out) == [("y", -2)]  # x: one more from image 3, one less from image 2


@pytest.mark.parametrize("seed", range(3))
def test_statistics_by_batches_equal_the_fold(spark, tmp_path, seed):
    from silvergrain.operators import journal as J

    rng = random.Random(seed)
    rows = []
    for i in range(80):
        kind = rng.choice(["remark", "stroke", "rating", "retraction"])
        target = rng.randrange(90) if kind == "retraction" else None
        rows.append((i, None, 1, kind, "typed", target, None if kind == "retraction" else rng.randrange(6), "t", 1, rng.random() < 0.1))
    j = spark.createDataFrame(rows, "id long, ts timestamp, session long, kind string, source string, target_event long, image long, text string, rating int, scrubbed boolean").withColumn("ts", F.timestamp_seconds(F.col("id") * 7 % 31))
    stats = D.CounterTable(spark, f"file://{tmp_path}/s", ["image"], ["events", "remarks", "strokes"], ["last"])
    for b in range(2):
        D.update_image_stats(stats, j.where(F.col("id") % 2 < b), j.where(F.col("id") % 2 == b), str(b))
    got = stats.read().select("image", "events", F.col("remarks") > 0, F.col("strokes") > 0, "strokes", "last.ts")
    assert bag(got) == bag(J.image_stats(j))
