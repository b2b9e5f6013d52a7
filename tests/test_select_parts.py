"""Choices by component equal choices over the whole scope."""

import random

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import select as L


def whole(items, edges, method, tolerance):
    limit, weight = L.cutoff(tolerance), L.trade_off(tolerance)
    out = set()
    for scope in {s for s, _, _ in items}:
        names = sorted(i for s, i, _ in items if s == scope)
        near = {n: {} for n in names}
        for a, b, s in edges:
            if a in near and b in near and a != b:
                near[a][b] = near[b][a] = max(near[a].get(b, 0.0), s)
        quality = {i: q for s, i, q in items if s == scope and q is not None}
        out |= {(scope, i) for i in (names if len(names) <= 1 else L.METHODS[method](names, near, quality, limit, weight))}
    return out


@pytest.mark.parametrize("method", sorted(L.METHODS))
@pytest.mark.parametrize("seed", range(3))
def test_parts_equal_the_whole(spark, method, seed):
    rng = random.Random(seed)
    items = [(s, i, rng.choice([None, 0.0, 1.0, 2.5])) for s in ("x", "y", None) for i in range(40) if rng.random() < 0.8]
    edges = [(a, b, rng.choice([0.3, 0.6, 0.75, 0.8, 0.9, 0.97])) for a, b in (rng.sample(range(40), 2) for _ in range(45))]
    got = L.diversify(spark.createDataFrame(items, "scope string, image long, quality double"), spark.createDataFrame(edges, "a long, b long, sim double"), method, 0.6)
    rows = got.collect()
    assert len(rows) == len(items)
    assert {(r.scope, r.image) for r in rows if r.shown} == whole(items, edges, method, 0.6)


def test_a_covered_part_may_be_picked_from_while_others_are_open(spark):
    """A star's ends gain more from each other than a lone image gains by itself."""
    star = [(0, i, 0.8) for i in range(1, 9)] + [(9, i, 0.99) for i in range(1, 9)]
    items = [("s", i, 0.0) for i in range(10)] + [("s", 50, 0.0)]
    got = {r.image for r in L.diversify(spark.createDataFrame(items, "scope string, image long, quality double"), spark.createDataFrame(star, "a long, b long, sim double"), "facility", 0.6).where("shown").collect()}
    assert got == {i for _, i in whole(items, star, "facility", 0.6)}


def test_edge_cases(spark):
    items = spark.createDataFrame([("s", 1, float("nan")), ("s", 2, None), ("s", 3, 1.0)], "scope string, image long, quality double")
    none = spark.createDataFrame([], "a long, b long, sim double")
    for method in L.METHODS:
        assert L.diversify(items, none, method).where("shown").count() == 3
        assert L.diversify(items.limit(0), none, method).count() == 0
        loops = spark.createDataFrame([(1, 1, 1.0), (1, 9, 1.0), (2, 3, 0.99), (3, 2, 0.7)], none.schema)
        assert L.diversify(items, loops, method, 0).where("shown").count() == 3
        assert {r.image for r in L.diversify(items, loops, method, 0.5).where("shown").collect()} == {1, 3}


@pytest.fixture
def as_dealt(spark):
    """Small partitions are not joined afterwards."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_large_scope_runs_in_many_tasks(spark, as_dealt):
    n = 20_000
    items = spark.range(n).select(F.lit("all").alias("scope"), F.col("id").alias("image"), (F.col("id") % 7).cast("double").alias("quality"))
    edges = spark.range(n).where("id % 10 < 9").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(0.9).alias("sim"))
    shown = L.diversify(items, edges, "facility", 0.6)
    rows = shown.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if("shown").alias("shown")).collect()
    assert sum(r.n for r in rows) == n and len(rows) >= 3 and n / 10 * 3 <= sum(r.shown for r in rows) <= n / 2
