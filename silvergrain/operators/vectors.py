"""Dense vectors: normalising, quantising, scoring, neighbours.

Dot products of whole tables against few queries stay in the JVM; neighbour graphs multiply
blocks of vectors as matrices in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TUNING
from .search import top_per_group

DIGITS = 6
#: Entries of one block at most, 8 MB of floats, and vectors of one that need not be cut for more tasks.
BLOCK, LEAST_BLOCK = 1 << 21, 2048
#: Rows and columns that are multiplied at once, columns of the first piece, and how many columns a row may leave to be worked out again.
ROWS, COLUMNS, FIRST, MOST_TIES = 1024, 8192, 256, 64


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def truncated(vector: Column, dims: int) -> Column:
    """The first ``dims`` components, of unit length; a zero vector stays zero."""
    cut = F.slice(as_doubles(vector), 1, dims)
    n = norm(cut)
    return F.when(n > 0, F.transform(cut, lambda x: x / n)).otherwise(cut)


def cosine(a: Column, b: Column) -> Column:
    """Zero where either has no direction."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def quantized(vector: Column, scale: Column, offset: Column) -> Column:
    """Signed bytes of ``(x - offset) / scale``, rounded half away from zero and clamped."""
    pairs = F.arrays_zip(as_doubles(vector).alias("x"), scale.alias("s"), offset.alias("o"))
    byte = lambda p: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.when(p["s"] == 0, 0.0).otherwise(F.signum((p["x"] - p["o"]) / p["s"]) * F.floor(F.abs((p["x"] - p["o"]) / p["s"]) + 0.5)))).cast("tinyint")
    return F.transform(pairs, byte)


def dequantized(codes: Column, scale: Column, offset: Column) -> Column:
    return F.transform(F.arrays_zip(codes.alias("c"), scale.alias("s"), offset.alias("o")), lambda p: p["c"] * p["s"] + p["o"])


def quantization(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: the per-dimension scale and offset that map the table's range to signed bytes."""
    per = vectors.select(F.posexplode(as_doubles(F.col(vec))).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cells = per.select("i", ((F.col("hi") - F.col("lo")) / 254).alias("s"), ((F.col("hi") + F.col("lo")) / 2).alias("o"))
    row = cells.agg(F.array_sort(F.collect_list(F.struct("i", "s", "o"))).alias("c"))  # as many as dimensions
    return row.select(F.transform("c", lambda c: c["s"]).alias("scale"), F.transform("c", lambda c: c["o"]).alias("offset"))


def top_k(vectors: DataFrame, query: list[float], k: int = TUNING.vector_limit, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, score): the nearest by cosine, exact; ties by key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(cosine(as_doubles(F.col(vec)), q), DIGITS).alias("score")).orderBy(F.desc("score"), key).limit(k)


def scores_in_scope(vectors: DataFrame, scope: DataFrame, query: list[float], key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, score) of the scope's vectors; keys without a vector are absent."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.join(scope.select(key).distinct(), key, "left_semi").select(key, F.round(cosine(as_doubles(F.col(vec)), q), DIGITS).alias("score"))


def vector_of(vectors: DataFrame, item: int, key: str = "vec_id", vec: str = "embedding") -> list[float] | None:
    row = vectors.where(F.col(key) == item).select(vec).head()
    return None if row is None or row[0] is None else [float(x) for x in row[0]]


def similar_to(vectors: DataFrame, item: int, k: int = 60, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest of an item, without itself; nothing if it has no vector."""
    q = vector_of(vectors, item, key, vec)
    if q is None or k <= 0:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    return top_k(vectors, q, k + 1, key, vec).where(F.col(key) != item).orderBy(F.desc("score"), key).limit(k)


def _units(x: np.ndarray) -> np.ndarray:
    return np.divide(x, (s := np.linalg.norm(x, axis=1, keepdims=True)), out=np.zeros_like(x), where=s > 0)


def _best(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the ``k`` greatest ``sim`` of each ``src``, ties to the least ``dst``; sorted by ``src``, then rank."""
    order = np.lexsort((dst, -sim, src))
    src, dst, sim = src[order], dst[order], sim[order]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, np.int64)
    kept = np.arange(len(src)) - np.repeat(first, np.diff(np.r_[first, len(src)])) < k
    return src[kept], dst[kept], sim[kept]


def _nearest(a: np.ndarray, b: np.ndarray, own: np.ndarray, other: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``a``, place in ``b``, sim) of the ``k`` nearest units in ``b`` of each unit in ``a``; ``b`` in the order of its keys ``other``.

    Products in single precision leave out what is below a row's ``k``-th best so far by more than their error;
    what is left is worked out in doubles. Where that is much (ties of copies or zeros) the whole piece is.
    """
    small_a, small_b = a.astype(np.float32), b.astype(np.float32)
    slack = 10.0**-digits + 2e-7 * (a.shape[1] + 2)  # rounding, and the error of a sum of so many products of parts of units
    out: list = []
    for top in range(0, len(a), ROWS):
        rows = np.arange(top, min(top + ROWS, len(a)))
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least = np.full(len(rows), -np.inf)
        left = 0
        while left < len(b):  # each piece about as wide as those before it, so it has few that are better
            columns = np.arange(left, min(left + min(max(left, FIRST), COLUMNS), len(b)))
            left += len(columns)
            x = y = None
            if np.isfinite(least).all() and (least > 0).all():
                at = np.flatnonzero(small_a[rows] @ small_b[columns].T >= (least - slack).astype(np.float32)[:, None])
                if len(at) <= MOST_TIES * len(rows):
                    x, y = np.divmod(at, len(columns))
                    sim = np.round(np.maximum(np.einsum("ij,ij->i", a[rows[x]], b[columns[y]]), 0), digits)
            if x is None:
                every = np.round(np.maximum(a[rows] @ b[columns].T, 0), digits)
                every[(own[rows][:, None] == other[columns][None, :]) | np.isnan(every)] = -1
                if every.shape[1] > k:  # what is above the k-th best, and of what equals it the first
                    bound = -np.partition(-every, k - 1, axis=1)[:, k - 1 : k]
                    equal = every == bound
                    room = k - (every > bound).sum(1, keepdims=True)
                    x, y = np.nonzero((every > bound) | (equal & (np.cumsum(equal, axis=1) <= room)))
                else:
                    x, y = np.nonzero(np.ones_like(every, bool))
                sim = every[x, y]
            kept = (sim >= 0) & (own[rows[x]] != other[columns[y]])
            held = _best(*(np.concatenate(p) for p in zip(held, (x[kept], columns[y[kept]], sim[kept]), strict=True)), k)
            count = np.bincount(held[0], minlength=len(rows))
            full = count == k
            least[full] = held[2][np.cumsum(count)[full] - 1]
        out.append((rows[held[0]], held[1], held[2]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def knn_graph(vectors: DataFrame, k: int = TUNING.neighbours, key: str = "vec_id", vec: str = "embedding", digits: int = DIGITS) -> DataFrame:
    """(src, dst, sim): the ``k`` nearest of every vector in the scope; negative similarities count as 0, ties by key.

    Vectors are packed into blocks; a task multiplies one pair of blocks both ways and keeps ``k`` of each
    row, so a pair of blocks sends no more than ``k`` rows a vector on. Work is quadratic in the
    scope by definition; memory is two blocks a task, and a block travels once a pair of blocks.
    """
    n, dims, least = vectors.agg(F.count(F.lit(1)), F.max(F.size(vec)), F.min(F.when(F.col(vec).isNotNull(), F.size(vec)))).head()
    if n < 2 or k <= 0 or not dims or dims < 0:
        return vectors.select(F.col(key).alias("src"), F.col(key).alias("dst"), F.lit(0.0).alias("sim")).limit(0)
    if dims != least:
        raise ValueError(f"vectors of {least} to {dims} entries")
    # few blocks, as what travels grows with them, but enough pairs of them for all tasks
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n * dims // BLOCK), min(-(-n // LEAST_BLOCK), int(np.sqrt(2 * tasks))))
    entry = vectors.schema[vec].dataType.elementType.simpleString()
    held = np.float32 if entry == "float" else np.float64
    rows = vectors.select(F.col(key).cast("long").alias("id"), (F.col(vec) if entry == "float" else as_doubles(F.col(vec))).alias("v")).where(F.col("v").isNotNull())
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("p")).select("own", F.col("p.id").alias("ids"), F.flatten("p.v").alias("v"))
    both = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ids", "v")
    kind = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float64())])

    def near(ids: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        p, q, sim = _nearest(x, y, ids, other, k, digits)
        return pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(other[q]), pa.array(sim)], schema=kind)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, None
        for batch in batches:
            for place, (i, j) in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)):
                ids = batch.column("ids")[place].values.to_numpy(zero_copy_only=False)
                x = _units(batch.column("v")[place].values.to_numpy(zero_copy_only=False).astype(held, copy=False).astype(np.float64).reshape(len(ids), -1))
                if i == j:
                    yield near(ids, x, ids, x)
                elif at == (i, j):
                    yield near(*first, ids, x)
                    yield near(ids, x, *first)
                    first = None
                else:
                    at, first = (i, j), (ids, x)

    found = both.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j").mapInArrow(multiply, "src long, dst long, sim double")
    return top_per_group(found, ["src"], [F.desc("sim"), F.col("dst")], k).drop("rank")


def best_chunks(hits: DataFrame, targets: DataFrame, admitted: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(image, key, score): chunk hits (key, score) fanned out to images, the best chunk of each."""
    joined = hits.join(targets.select(key, "image").where(F.col("image").isNotNull()), key)
    if admitted is not None:
        joined = joined.join(admitted.select("image").distinct(), "image", "left_semi")
    return joined.groupBy("image").agg(F.min(F.struct((-F.col("score")).alias("s"), key)).alias("b")).select("image", f"b.{key}", (-F.col("b.s")).alias("score"))


def upsert(current: DataFrame, changes: DataFrame, key: str = "vec_id") -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with their keys."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes.dropDuplicates([key]))


def delete(current: DataFrame, keys: DataFrame, key: str = "vec_id") -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")


def reconcile_space(vectors: DataFrame, items: DataFrame, model: str, key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(vectors of the active model, items that miss one)."""
    kept = vectors.where(F.col("model") == model)
    return kept, items.join(kept.select(key), key, "left_anti")
