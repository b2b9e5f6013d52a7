"""Whitening against a dense eigendecomposition of the exact covariance."""

from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from silvergrain.llm import registry, whiten

SCHEMA = "vec_id long, embedding array<double>"


def dense(vectors, most=32):
    """n, deviations, components and eigenvalues from whole numbers, one by one."""
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    centred = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s, strict=True)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, vecs[:, ::-1][:, :most], values[::-1][:most], values.sum()


def compared(rows, vectors, ids, most=32):
    n, deviation, centred, vecs, values, trace = dense(vectors, most)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * len(values)
    w = np.array([[got[i, c + 1].whitened for c in range(len(values))] for i in ids])
    want = centred @ vecs / np.sqrt(values)
    want *= np.sign((w * want).sum(0))
    assert np.abs(w - want).max() < 1e-8
    for i, d in zip(ids, deviation, strict=True):
        for c in range(len(values)):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(values[c] / trace, rel=1e-9)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and max(errors) < 1e-9
    assert max(errors) == pytest.approx(np.abs(w.T @ w / n - np.eye(len(values))).max(), abs=1e-10)


def test_op12(spark, data):
    t = pq.read_table(f"{data}/embeddings.parquet").to_pydict()
    compared(registry.op12_embedding_whitening(spark, data).collect(), t["embedding"], t["vec_id"])


def test_many_dimensions_take_rounds(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 200)) @ np.diag(1.1 ** -np.arange(200.0)) @ np.linalg.qr(rng.standard_normal((200, 200)))[0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], SCHEMA)
    cells = whiten.read_cells(df).repartition(5)
    fitted = whiten.fit(cells)
    assert 3 < fitted.rounds < 60 and fitted.residual <= whiten.CERTIFIED
    _, _, _, vecs, values, trace = dense(v)
    assert np.allclose(fitted.eigenvalues, values, rtol=1e-11) and fitted.trace == pytest.approx(trace, rel=1e-12)
    assert np.abs(np.abs((fitted.components * vecs).sum(0)) - 1).max() < 1e-12
    assert (fitted.components[np.abs(fitted.components).argmax(0), range(32)] > 0).all()
    assert whiten.identity_error(cells, fitted) < 1e-10
    with pytest.raises(RuntimeError):
        whiten.fit(cells, most_rounds=2)


def test_far_from_zero_and_large(spark):
    rng = np.random.default_rng(6)
    v = np.hstack([rng.standard_normal((300, 3)) + 1e7, rng.standard_normal((300, 2)) * 1e9])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], SCHEMA)
    n, deviation, centred, vecs, values, _ = dense(v)
    rows = whiten.whiten(df).collect()
    first = {r.vec_id: r.whitened for r in rows if r.component == 1}
    want = centred @ vecs[:, 0] / np.sqrt(values[0])
    got = np.array([first[i] for i in range(300)])
    assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 2**63 else None) for r in rows) and any(r.deviation is None for r in rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (None, [0.5, 1.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, [-0.01, 3.0, 0.25])]
    bad = [(2, None), (3, []), (4, [nan, 1.0, 1.0]), (7, [1.0, None, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0]), (10, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(good + bad, SCHEMA).withColumn("n", F.lit("clash")).withColumn("component", F.lit("clash"))
    rows = whiten.whiten(df).collect()
    n, deviation, _, _, values, _ = dense([v for _, v in good])
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation) for r in rows) == sorted((str(i), c + 1, 5, d) for (i, _), d in zip(good, deviation, strict=True) for c in range(3))
    assert whiten.whiten(df.limit(0)).count() == 0
    assert whiten.whiten(df.where("vec_id = 1")).count() == 0  # no variance
    assert whiten.whiten(df.where("vec_id IN (2, 3, 4)")).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], SCHEMA)
    assert {r.component for r in whiten.whiten(flat).collect()} == {1}  # one direction only
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.5]), (4, [9.0])], SCHEMA)).select("vec_id").distinct().count() == 2
