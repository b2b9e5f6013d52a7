"""Neighbour graphs by packed blocks against plain products: ties, copies, zeros, opposite vectors."""

import numpy as np
import pytest

from silvergrain.operators import graph as G
from silvergrain.operators import vectors as V


@pytest.mark.parametrize("kind, entry", [("random", "float"), ("copies", "float"), ("small", "double"), ("zeros", "float"), ("nan", "double")])
def test_blocks_equal_whole_products(spark, monkeypatch, kind, entry):
    monkeypatch.setattr(V, "BLOCK", 150 * 8)
    monkeypatch.setattr(V, "FIRST", 16)
    monkeypatch.setattr(V, "COLUMNS", 64)
    monkeypatch.setattr(V, "ROWS", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    if kind == "copies":
        x[100:300] = x[7]
    if kind == "small":
        x = np.round(x)
    if kind == "zeros":
        x[::3] = 0
        x[1] = -x[2]
    if kind == "nan":
        x[9, 3] = np.nan
    ids = rng.permutation(1000)[:500]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(5000, None)], f"vec_id long, embedding array<{entry}>")
    u = x.astype(np.float64)
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    u = np.divide(u, norm, out=np.zeros_like(u), where=norm > 0)
    sim = np.round(np.maximum(u @ u.T, 0), 6)
    want = {}
    for p, i in enumerate(ids):
        best = sorted((-sim[p, q], int(j)) for q, j in enumerate(ids) if j != i and sim[p, q] == sim[p, q])[:12]
        want[int(i)] = [(j, -s) for s, j in best]
    found = V.knn_graph(df)
    got: dict = {int(i): [] for i in ids}
    for r in found.collect():
        got[r.src].append((r.dst, r.sim))
    for i in want:
        assert [(j, round(s, 6)) for j, s in sorted(got[i], key=lambda c: (-c[1], c[0]))] == [(j, round(s + 0.0, 6)) for j, s in want[i]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan  # blocks travel as one row each


def test_lengths_must_be_equal(spark):
    with pytest.raises(ValueError):
        V.knn_graph(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>"))


def test_edges_of_clusters_are_worked_out_once(spark, monkeypatch):
    names = []
    real = G.written
    monkeypatch.setattr(G, "written", lambda df, name: names.append(name) or real(df, name))
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "a long, b long, sim double")
    nodes = spark.createDataFrame([(i, [0.0]) for i in range(1, 4)], "node long, affinities array<double>")
    assert [tuple(r)[:2] for r in G.unnamed_clusters(edges, nodes).collect()] == [(1, 3)]
    assert names[0] == "unclaimed-edges"
