"""Signatures, names, pictures and fields that lie near each other, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvergrain.functions.similarity import jaro_winkler
from silvergrain.operators import graph as G
from silvergrain.operators import names as N


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 5, 8, 16, 40, 63, 64])
def test_hamming_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(threshold)
    sigs = [rng.getrandbits(64) for _ in range(12)]
    for s in list(sigs):
        for _ in range(4):
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, max(0, min(64, threshold + rng.choice([-1, 0, 1])))])):
                s ^= 1 << bit
            sigs.append(s)
    df = spark.createDataFrame([(i, signed(s)) for i, s in enumerate(sigs)] + [(999, None)], "id long, sig long")
    got = sorted(map(tuple, G.hamming_pairs(df, "id", "sig", threshold).collect()))
    assert got == [(i, j, d) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := (sigs[i] ^ sigs[j]).bit_count()) <= threshold]


def test_few_signatures_meet_by_chance(spark):
    n = 20_000
    rows = spark.range(n).select("id", F.xxhash64("id").alias("sig"))
    cuts, within = G.bands(8)
    assert len(cuts) == 4 and within == 2
    planted = rows.union(spark.range(50).select((F.col("id") + n).alias("id"), F.xxhash64("id").bitwiseXOR(F.lit(0b10000000000000000000000000000000000000000000000000001011)).alias("sig")))
    G.hamming_pairs(planted, "id", "sig", 8).write.format("noop").mode("overwrite").save()
    found = G.hamming_pairs(planted, "id", "sig", 8)
    assert {(r.a, r.b) for r in found.collect()} >= {(i, i + n) for i in range(50)}
    metrics = found._jdf.queryExecution()
    # of 200 million pairs, so many share a value of a band: about n * n / 2 * 22 * 22 * 3 / 2 ** 21 / 2
    values = [tuple((s >> a) & ((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)) for s in (r.sig & (2**64 - 1) for r in planted.collect())]
    chance = sum(len(values) ** 2 / 2 * (1 + b - a) ** 2 / 2 ** (b - a) for a, b in zip(cuts, cuts[1:], strict=False))
    assert chance < 0.001 * len(values) ** 2 and metrics is not None


def test_copies_of_a_signature_cost_no_pairs(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2990, F.lit(5)).otherwise(F.col("id") * 10**15).cast("long").alias("sig")).union(spark.createDataFrame([(7000, 4)], "id long, sig long"))
    got = G.near_duplicate_groups(rows, "id", "sig", 2)
    assert got.groupBy("component", "size").count().collect() == [(0, 2991, 2991)]


def test_names(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 12))).strip() or "a"
    names = [(i, word(), rng.choice(["active", "shelved", "done", None]), rng.choice([None, 1, 2, 3])) for i in range(120)]
    asked = [(i, rng.choice([word(), names[i][1].upper() + " ", names[i][1][:-1], "", None])) for i in range(60)]
    collapsed = lambda s: " ".join(s.lower().split())
    want = {}
    for i, q in asked:
        best = None
        for k, name, status, t in names if q else []:
            score = round(jaro_winkler(collapsed(q), collapsed(name)), 9)
            if score >= 0.8:
                best = min(filter(None, (best, (-score, {"active": 0, "shelved": 1}.get(status, 2), t is None, -(t or 0), k))))
        want[i] = best and best[4]
    df = spark.createDataFrame(names, "id long, name string, status string, updated_ts long")
    ask = spark.createDataFrame(asked, "n long, asked string")
    out = N.resolve(ask, df)
    assert {r.n: r.id for r in out.collect()} == want and sum(v is not None for v in want.values()) > 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert N.resolve(ask, df.limit(0)).where("id IS NOT NULL").count() == 0


def test_bounds_hold():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        shared = sum(min(a.count(c), b.count(c)) for c in "abc")
        prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
        j = (shared / len(a) + shared / len(b) + 1) / 3 if shared else 0.0
        assert jaro_winkler(a, b) <= (j + prefix * 0.1 * (1 - j) if j > 0.7 else j) + 1e-12


@pytest.mark.parametrize("size", [(9, 8), (8, 8), (31, 17), (5, 3), (90, 80)])
def test_difference_hash_equals_area_means(spark, size):
    w, h = size
    rng = np.random.default_rng(w)
    pictures = [rng.integers(0, 256, (h, w), dtype=np.uint8) for _ in range(5)] + [np.full((h, w), 7, np.uint8)]
    df = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(pictures)] + [(8, bytearray(b"xx")), (9, None)], "id long, pixels binary")
    got = {r.id: r.h for r in df.select("id", G.difference_hash(F.col("pixels"), F.lit(w), F.lit(h)).alias("h")).collect()}
    assert got[8] is None and got[9] is None and got[5] == 0
    for i, p in enumerate(pictures):
        fine = np.repeat(np.repeat(p.astype(np.int64), 8, axis=0), 9, axis=1)  # every cell is a whole block of h x w of these
        cells = fine.reshape(8, h, 9, w).sum(axis=(1, 3))
        bits = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if cells[y, x] > cells[y, x + 1])
        assert got[i] == signed(bits)


@pytest.mark.parametrize("radius, passes, tile", [(1, 1, 4), (2, 3, 8), (3, 2, 16), (0, 3, 4)])
def test_blurs_equal_a_whole_grid(spark, radius, passes, tile):
    rng = np.random.default_rng(radius)
    cells = {(int(x), int(y)): float(v) for x, y, v in zip(rng.integers(-20, 20, 40), rng.integers(-20, 20, 40), rng.random(40), strict=True)}
    whole = np.zeros((100, 100))
    for (x, y), v in cells.items():
        whole[x + 50, y + 50] = v
    for _ in range(passes):
        out = np.zeros_like(whole)
        for dx in range(-radius, radius + 1):
            for dy in range(-radius, radius + 1):
                out += np.roll(whole, (dx, dy), (0, 1))
        whole = out / (2 * radius + 1) ** 2
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "gx long, gy long, w double")
    got = {(r.gx + 50, r.gy + 50): r.w for r in G.blurred_field(df, radius, passes, tile).collect()}
    want = {(int(x), int(y)): whole[x, y] for x, y in zip(*np.nonzero(whole > 1e-12), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    with pytest.raises(ValueError):
        G.blurred_field(df, 9, 9, 16)
