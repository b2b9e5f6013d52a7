"""Whitening of vectors on the leading eigenvectors of their covariance, by LOBPCG.

Vectors are read once into rows of whole numbers (cells), which are exact and short; sums of
them are exact too. The covariance V is never formed: a round multiplies it with a block of
orthonormal columns, each task with its own centred rows, and the products of all tasks are
added up by dimension. The block holds the iterate, its residuals and the previous direction;
Rayleigh-Ritz on it gives the next iterate, whose residuals follow from the same product, so a
round reads the rows once. The iterate carries ``GUARD`` columns more than are asked for.

It ends when every residual is so small that rounding is all that is left, and raises if it can't
get there: a residual r bounds the error of an eigenvalue by r, and that of its eigenvector by
r over the distance to the next eigenvalue. Whitened rows come after that, and their covariance is
measured against the identity in a pass of its own.

Edge cases: vectors that are null, empty, or hold null or non-finite entries, or entries of
2**46 or more, are left out, of the fit and of the result; if vectors differ in length, those of
the most frequent length count (of equally frequent lengths the greater) and others are left out;
zero vectors and repeated rows count as rows; a null id stays null; directions without variance
are no components, so equal rows, or one row, give no components and no rows of the long form;
a deviation beyond 64 bits is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import rechunk, written

#: Cells of a unit, and what is added to them.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS, GUARD = 32, 8
#: Cells this large are left out: they and their differences are whole numbers in doubles.
MOST_CELL = 2.0**52
#: Residuals over the greatest eigenvalue: at the first the iteration ends, up to the second it may end where it gets no better.
DONE, CERTIFIED = 1e-14, 1e-11
MOST_ROUNDS = 400
#: Components whose eigenvalue is no more than this share of the greatest have no variance.
NO_VARIANCE = 1e-12
SEED = 11
ROWS = 2048


@dataclass(frozen=True)
class Fit:
    """Exact sums of the cells (without OFFSET), and the components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    residual: float  # the greatest of a component, over the greatest eigenvalue
    rounds: int
    centre_sums: np.ndarray  # of the centred rows: what rounding leaves

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def read_cells(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, dim, cells) of the vectors that count; cells in as few bytes as they need. A written table."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rechunk(batches, ROWS):
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * flat)
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = sizes > 0
            good[row[~(np.abs(x) < MOST_CELL)]] = False
            ends = np.cumsum(sizes)
            out = []
            for i in np.flatnonzero(good):
                own = x[ends[i] - sizes[i] : ends[i]]
                most = np.abs(own).max()
                out.append(own.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(sizes[good], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "cells"])

    found = written(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>" if vectors.schema[vec].dataType.simpleString() == "array<double>" else "array<float>").alias("v")).mapInArrow(cells, "vec_id long, dim int, cells binary"), "cells")
    most = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).head()
    return found.where(F.col("dim") == (most["dim"] if most else 0))


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of cells as whole numbers."""
    raw = column.to_pylist()
    width = np.array([len(x) // dim for x in raw])
    out = np.zeros((len(raw), dim), np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join([raw[i] for i in at]), f"<i{w}").reshape(-1, dim)
    return out


def sum_cells(cells: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of each dimension."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in rechunk(batches, ROWS):
            if batch.num_rows:
                n += batch.num_rows
                total = [a + b for a, b in zip(total, unpacked(batch.column(0), dim).sum(0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([*map(Decimal, total), Decimal(n)], pa.decimal128(38, 0))], names=["pos", "total"])

    rows = cells.select("cells").mapInArrow(added, "pos int, total decimal(38,0)").groupBy("pos").agg(F.sum("total").alias("total")).collect()
    by = {r["pos"]: int(r["total"]) for r in rows}
    return by.get(dim, 0), tuple(by.get(i, 0) for i in range(dim))


def centring(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of each dimension as a whole number and what is left of it."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * q) / n for s, q in zip(sums, whole, strict=True)])


def add_up(cells: DataFrame, dim: int, centre: tuple[np.ndarray, np.ndarray], block: np.ndarray, inner: bool) -> np.ndarray:
    """Sums over all rows, centred before multiplying, for columns of ``block``.

    Of the rows x P of the projections: with ``inner`` the products P'P, else X'P, and in both
    cases the sums of the rows and of their squares as two more columns. Each task sends one
    matrix, a row per dimension; these are added by dimension.
    """
    k = block.shape[1]
    size = k if inner else dim
    shared = cells.sparkSession.sparkContext.broadcast((centre, block))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (whole, rest), z = shared.value
        total, some = np.zeros((size, k + 2)), False
        for batch in rechunk(batches, ROWS):
            if batch.num_rows:
                some = True
                x = (unpacked(batch.column(0), dim) - whole) - rest
                p = x @ z
                left = p if inner else x
                total[:, :k] += left.T @ p
                total[:, k] += left.sum(0)
                total[:, k + 1] += (left * left).sum(0)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), *map(pa.array, np.ascontiguousarray(total.T))], names=["pos", *names])

    names = [f"v{i}" for i in range(k + 2)]
    rows = cells.select("cells").mapInArrow(products, "pos int, " + ", ".join(f"{c} double" for c in names)).groupBy("pos").agg(*[F.sum(c).alias(c) for c in names]).collect()
    shared.unpersist()
    out = np.zeros((size, k + 2))
    for r in rows:
        out[r[0]] = r[1:]
    return out


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, the first block's first; what depends on others is left out."""
    basis = np.linalg.qr(blocks[0])[0]
    for b in blocks[1:]:
        norms = np.linalg.norm(b, axis=0)
        b = b[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            b = b - basis @ (basis.T @ b)
        if not b.size or basis.shape[1] >= len(basis):
            continue
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        u = u[:, s > 1e-7][:, : len(basis) - basis.shape[1]]
        for _ in range(2):
            u = u - basis @ (basis.T @ u)
            u = np.linalg.qr(u)[0]
        basis = np.hstack([basis, u])
    return basis


def fit(cells: DataFrame, components: int = COMPONENTS, guard: int = GUARD, most_rounds: int = MOST_ROUNDS) -> Fit:
    """The leading components of the rows of cells, certified by their residuals."""
    some = cells.select("dim").head()
    dim = some["dim"] if some else 0
    n, sums = sum_cells(cells, dim) if dim else (0, ())
    nothing = Fit(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0, np.zeros(dim))
    if not n:
        return nothing
    centre = centring(n, sums)
    m = min(dim, components + guard)
    x = np.random.default_rng([SEED, dim]).standard_normal((dim, m))
    blocks, best, worse = [x], None, 0
    for rounds in range(1, most_rounds + 1):
        z = orthonormal(blocks)
        found = add_up(cells, dim, centre, z, inner=False)
        vz, centre_sums, trace = found[:, :-2] / n, found[:, -2], float(found[:, -1].sum() / n)
        if not trace > 0:
            return nothing
        inner = z.T @ vz
        values, y = np.linalg.eigh((inner + inner.T) / 2)
        values, y = values[::-1][:m], y[:, ::-1][:, :m]
        before, x = x, z @ y
        residuals = vz @ y - x * values
        asked = values[:components] > NO_VARIANCE * values[0]
        residual = float(np.linalg.norm(residuals[:, : int(asked.sum())], axis=0).max() / values[0])
        if rounds > 1 and (best is None or residual < best.residual):
            worse = 0 if best is None or residual < best.residual / 2 else worse + 1
            k = int(asked.sum())
            best = Fit(n, sums, x[:, :k], values[:k], trace, residual, rounds, centre_sums)
        elif rounds > 1:
            worse += 1
        if best is not None and (best.residual <= DONE or best.residual <= CERTIFIED and worse >= 2):
            sign = np.sign(best.components[np.abs(best.components).argmax(0), np.arange(best.components.shape[1])])
            return Fit(best.n, best.sums, best.components * sign, best.eigenvalues, best.trace, best.residual, best.rounds, best.centre_sums)
        direction = x - before @ (before.T @ x) if rounds > 1 else np.zeros((dim, 0))
        blocks = [x, residuals, direction]
    raise RuntimeError(f"the greatest residual is {best.residual if best else 1:.3g} of the greatest eigenvalue after {most_rounds} rounds")


def identity_error(cells: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    dim, k = fitted.components.shape
    if not k:
        return 0.0
    scaled = fitted.components / np.sqrt(fitted.eigenvalues)
    whole, rest = centring(fitted.n, fitted.sums)
    # what rounding leaves of the rows' mean is taken from them too, so that whitened rows are centred before they are multiplied
    found = add_up(cells, dim, (whole, rest + fitted.centre_sums / fitted.n), scaled, inner=True)
    return float(np.abs(found[:, :k] / fitted.n - np.eye(k)).max())


def exact_deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Of each row the sum over dimensions of (n * x - sum) ** 2, null beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def transform(cells: DataFrame, fitted: Fit) -> DataFrame:
    """(vec_id, deviation, whitened): a row per vector, its whitened coordinates in an array."""
    k = fitted.components.shape[1]
    shared = cells.sparkSession.sparkContext.broadcast((fitted, fitted.components / np.sqrt(fitted.eigenvalues)))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, scaled = shared.value
        whole, rest = centring(f.n, f.sums)
        for batch in rechunk(batches, ROWS):
            if batch.num_rows:
                x = unpacked(batch.column(1), len(f.sums))
                w = ((x - whole) - rest) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32) if k else np.zeros(len(x) + 1, np.int32)), pa.array(w.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact_deviation(x, f.n, f.sums), pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return cells.select("vec_id", "cells").mapInArrow(projected, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    cells = read_cells(vectors, key, vec)
    fitted = fit(cells, components)
    error = identity_error(cells, fitted)
    shares = F.array(*[F.lit(float(e)) for e in fitted.explained]) if len(fitted.eigenvalues) else F.array().cast("array<double>")
    rows = transform(cells, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))
