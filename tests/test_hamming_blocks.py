"""Signatures compared by blocks, where bands would bring too many pairs together by chance."""

import numpy as np
import pytest

from silvergrain.operators import graph as G


@pytest.mark.parametrize("threshold", [9, 16, 17, 30])
def test_blocks_equal_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(G, "BLOCK", 40)
    rng = np.random.default_rng(threshold)
    sigs = rng.integers(-(1 << 63), 1 << 63, 120, dtype=np.int64)
    for i in range(0, 120, 3):  # near ones, and copies
        sigs[i] = sigs[i + 1] ^ int(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, threshold + 2), replace=False)))
    df = spark.createDataFrame([(i * 7 % 120, int(s)) for i, s in enumerate(sigs)] + [(500, None), (501, int(sigs[5])), (502, int(sigs[5]))], "id long, sig long")
    of = {r.id: r.sig & (2**64 - 1) for r in df.collect() if r.sig is not None}
    found = G.hamming_pairs(df, "id", "sig", threshold)
    want = [(a, b, d) for a in sorted(of) for b in sorted(of) if a < b and (d := (of[a] ^ of[b]).bit_count()) <= threshold]
    assert sorted(map(tuple, found.collect())) == want and len(want) > 30
    assert G.chance(threshold) > G.MOST_CHANCE and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_wide_bands_stay():
    assert max(G.chance(t) for t in range(9)) <= G.MOST_CHANCE
