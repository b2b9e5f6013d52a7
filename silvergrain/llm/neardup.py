"""Near-duplicate vectors by counting collisions in sorted one-dimensional projections.

Every vector is projected on ``COUNTED`` random directions. Two vectors collide in a projection
if one lies in the window of half-width ``COUNT_SIGMAS`` standard deviations (of a pair at the
threshold) centred at the other. The collisions of a pair are counted, and a pair with at
least the calibrated count is verified: the greatest count that a pair exactly at the threshold
reaches with probability ``COUNT_RECALL``. Places are kept as single bytes, so a vector of any
length has a code of ``COUNTED`` bytes.

One projection's window holds a fixed share of all vectors, so pairs are not counted everywhere:
in each of ``tables`` tables the signs of a few more directions deal the vectors into buckets,
one direction sorts a bucket, and a pair is counted where it lies in one bucket and inside the
window around each other there. The number of tables is calibrated too: a pair exactly at the
threshold meets in one at least with probability ``RECALL``, closer pairs more often. The number
of signs grows with the logarithm of the number of vectors, so buckets stay of one size; tables
grow about as the fourth root of it.

Only codes are dealt to the buckets. Vectors follow to the buckets where they have a partner of
enough collisions, are verified there by their cosine in double precision, and linked in the
first table in which the pair meets; so a pair is never shuffled. What leaves a task is the
number of links of each vector and a forest of its links. Large buckets (many near copies) are
cut into blocks and each pair of blocks is a task of its own: a crowd in which all are linked
costs its pairs, spread over tasks, since every vector's links are counted. Equal vectors are
collapsed before and counted by their number.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and stay; vectors of different length never link; a cosine that equals the
threshold in double precision links; repeated rows are links of each other; a null id has a
null component; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import rechunk, written

COSINE = 0.9
RECALL = 0.985
#: A pair must meet in so many tables.
LEAST_COUNT = 1
#: Projections in which collisions are counted, the half-width of their windows, and the share of pairs at the threshold that the count may not lose.
COUNTED, COUNT_SIGMAS, COUNT_RECALL = 48, 1.5, 0.99999
#: Places are kept in steps of 1/STEPS as bytes from 0 to 2 * MIDDLE.
STEPS, MIDDLE = 22, 110
#: Half-width of a window, for projections of unit vectors: 2.5 standard deviations of a pair at the threshold.
WINDOW_SIGMAS = 2.5
BUCKET = 64
MOST_SIGNS, MOST_TABLES = 24, 512
#: Buckets of more vectors are cut into blocks of half as many.
LARGE_BUCKET = 4096
BROADCAST_BUCKETS = 200_000
SEED = 7


def collision_probability(cosine: float, signs: int) -> float:
    """Of a pair of unit vectors in one table."""
    return (1 - math.acos(cosine) / math.pi) ** signs * math.erf(WINDOW_SIGMAS / math.sqrt(2))


def tail(n: int, p: float, least: int) -> float:
    return 1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))


def calibrate(n: int, cosine: float = COSINE, recall: float = RECALL, least: int = LEAST_COUNT) -> tuple[int, int]:
    """(signs, tables) for ``n`` vectors: the fewest tables that give the recall."""
    signs = min(MOST_SIGNS, max(2, round(math.log2(max(4, n / BUCKET)))))
    while True:
        p = collision_probability(cosine, signs)
        for tables in range(least, MOST_TABLES + 1):
            if tail(tables, p, least) >= recall:
                return signs, tables
        signs -= 1


def count_window(cosine: float = COSINE) -> int:
    """Half-width of the counting windows in steps."""
    return round(COUNT_SIGMAS * math.sqrt(2 - 2 * cosine) * STEPS)


def calibrate_count(cosine: float = COSINE, recall: float = COUNT_RECALL) -> int:
    """The greatest count that a pair at the threshold reaches with the given probability."""
    p = math.erf(count_window(cosine) / STEPS / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    return max(least for least in range(COUNTED + 1) if tail(COUNTED, p, least) >= recall)


@cache
def directions(dim: int, signs: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * signs)), rng.standard_normal((dim, tables)), rng.standard_normal((dim, COUNTED))


class Signatures:
    """Buckets and places of a block of vectors in all tables, and their codes for counting."""

    def __init__(self, raw: np.ndarray, signs: int, tables: int):
        self.unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        for_signs, for_sort, for_count = directions(raw.shape[1], signs, tables)
        bits = (self.unit @ for_signs > 0).reshape(len(raw), tables, signs)
        self.bucket = bits.astype(np.int64) @ (1 << np.arange(signs, dtype=np.int64))
        self.place = self.unit @ for_sort
        self.code = np.clip(np.rint(self.unit @ for_count * STEPS) + MIDDLE, 0, 2 * MIDDLE).astype(np.uint8)


def collisions(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """How many projections the codes ``a`` and ``b`` collide in, all with all."""
    apart = a[:, None, :] + np.uint8(window) - b[None, :, :]  # bytes wrap: no two places are so far apart that it matters
    return np.add.reduce(apart <= 2 * window, axis=2, dtype=np.uint8)


def packed_kind(vectors: DataFrame, vec: str) -> str:
    """How components travel: as they are, single or double; all arithmetic is in doubles."""
    return "<f4" if vectors.schema[vec].dataType.simpleString() == "array<float>" else "<f8"


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """``vectors`` with ``__vec``: the components in binary, null where the vector can't link."""
    kind = packed_kind(vectors, vec)
    arrow_vec = "__vec"

    @F.arrow_udf("binary")
    def packed(lists: pa.Array) -> pa.Array:
        out = []
        for x in lists.to_pylist():
            a = None if not x or any(v is None for v in x) else np.array(x, np.float64)
            out.append(a.astype(kind).tobytes() if a is not None and np.isfinite(a).all() and a.any() else None)
        return pa.array(out, pa.binary())

    return vectors.withColumn(arrow_vec, packed(F.col(vec)))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTED)


def whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables that end where a group ends; the rows come sorted by their first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, row: [batch.column(i)[row].as_py() for i in range(n_keys)]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        last = groups_of([batch.column(i).to_numpy() for i in range(n_keys)])[-1][0]
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def groups_of(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys[0])], strict=True))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", cosine: float = COSINE, recall: float = RECALL, large: int = LARGE_BUCKET) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    told = written(usable(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).alias("v")), "v").select("vec_id", F.col("__vec").alias("vec")), "vectors")
    classes = written(told.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    # rows that share an id but not a vector are told apart by a number of their own
    classes = written(classes.withColumn("node", F.xxhash64("vec", "rep")), "vector-nodes")
    kind = packed_kind(vectors, vec)
    item = np.dtype(kind).itemsize
    signs, tables = calibrate(classes.count(), cosine, recall)
    width, window, least = WINDOW_SIGMAS * math.sqrt(2 - 2 * cosine), count_window(cosine), calibrate_count(cosine)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rechunk(batches, 1024):
            node, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths = np.array([len(x) for x in raw])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                s = Signatures(np.frombuffer(b"".join(raw[i] for i in at), kind).astype(np.float64).reshape(len(at), -1), signs, tables)
                rows = len(at) * tables
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(node[at], tables)), pa.array(np.full(rows, n // item, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(s.bucket.reshape(-1)), pa.array(s.place.reshape(-1)),
                    pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, COUNTED * (rows + 1), COUNTED, dtype=np.int32)), pa.py_buffer(np.repeat(s.code, tables, axis=0).tobytes())]),
                ], names=["node", "dim", "tab", "bucket", "place", "code"])

    dealt = classes.select("node", "vec").mapInArrow(deal, "node long, dim int, tab int, bucket long, place double, code binary")
    big = written(dealt.groupBy("dim", "tab", "bucket").count().where(F.col("count") > large).select("dim", "tab", "bucket", F.ceil(F.col("count") * 2 / F.lit(large)).cast("int").alias("blocks")), "large-buckets")
    n_big = big.count()
    if n_big:
        dealt = dealt.join(F.broadcast(big) if n_big <= BROADCAST_BUCKETS else big, ["dim", "tab", "bucket"], "left")
    else:
        dealt = dealt.withColumn("blocks", F.lit(None).cast("int"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    keys = ["dim", "tab", "bucket", "lo", "hi"]
    dealt = dealt.select(*keys[:3], F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "place", "code")

    def partners(n: int, place: np.ndarray, code: np.ndarray, own: np.ndarray, split: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of a group in order of place that lie in each other's window and have enough collisions."""
        ends = np.searchsorted(place, place + width, side="right")
        for a in range(0, n, 64):
            b = min(a + 64, n)
            i, j = np.nonzero(collisions(code[a:b], code[a : int(ends[b - 1])], window) >= least)
            i, j = i + a, j + a
            ok = (j > i) & (j < ends[i])
            if split:
                ok &= own[i] != own[j]
            if ok.any():
                yield i[ok], j[ok]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, len(keys)):
            columns = [whole.column(i).to_numpy() for i in range(8)]
            lo, hi, own, place = columns[3], columns[4], columns[5], columns[7]
            code, hit = _codes(whole.column(8)), np.zeros(len(own), bool)
            for a, b in groups_of(columns[:5]):
                if b - a > 1:
                    for i, j in partners(b - a, place[a:b], code[a:b], own[a:b], lo[a] != hi[a]):
                        hit[a + i] = hit[a + j] = True
            if hit.any():
                yield from whole.filter(pa.array(hit)).to_batches()

    told_apart = ", ".join(f"{k} {'long' if k == 'bucket' else 'int'}" for k in [*keys, "own"])
    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys, "place")
    members = sorted_.mapInArrow(count, f"{told_apart}, node long, place double, code binary")
    rows = written(members, "bucket-members").join(classes.select("node", "rep", "vec", "copies"), "node").select(*keys, "own", "node", "place", "code", "vec", "copies", "rep")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "place")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, len(keys)):
            columns = [whole.column(i).to_numpy() for i in range(8)]
            for a, b in groups_of(columns[:5]):
                if b - a > 1:
                    yield from linked(columns[1][a], columns[3][a] != columns[4][a], columns[5][a:b], columns[6][a:b], columns[7][a:b], whole.slice(a, b - a))

    def linked(tab: int, split: bool, own: np.ndarray, node: np.ndarray, place: np.ndarray, group: pa.Table) -> Iterator[pa.RecordBatch]:
        n, copies, rep = len(node), group.column(10).to_numpy(), group.column(11).to_numpy()
        s = Signatures(np.frombuffer(b"".join(group.column(9).to_pylist()), kind).astype(np.float64).reshape(n, -1), signs, tables)
        n_links, root = np.zeros(n, np.int64), np.arange(n)
        for i, j in partners(n, place, _codes(group.column(8)), own, split):
            ok = np.einsum("ij,ij->i", s.unit[i], s.unit[j]) >= cosine
            i, j = i[ok], j[ok]
            before = (s.bucket[i, :tab] == s.bucket[j, :tab]) & (np.abs(s.place[i, :tab] - s.place[j, :tab]) <= width)
            ok = ~before.any(axis=1)  # the pair meets here first
            i, j = i[ok], j[ok]
            np.add.at(n_links, i, copies[j])
            np.add.at(n_links, j, copies[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                while root[y] != y:
                    root[y] = y = root[root[y]]
                if x != y:
                    root[max(x, y)] = min(x, y)
        some = np.flatnonzero(n_links)
        if len(some):
            up = root[some]
            while (root[up] != up).any():
                up = root[up]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[some], rep[some], n_links[some], node[up], rep[up])], names=["node", "rep", "n_links", "up", "up_rep"])

    found = written(rows.mapInArrow(verify, "node long, rep long, n_links long, up long, up_rep long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    # nodes are ordered by their ids, so a component's least node tells its least id
    label = components(found.select(F.struct("rep", "node").alias("a"), F.struct(F.col("up_rep").alias("rep"), F.col("up").alias("node")).alias("b")))
    label = label.select("node.node", F.col("component.rep").alias("least"))
    placed = classes.join(counts, "node", "left").join(label, "node", "left")
    placed = placed.select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("least", "rep").alias("least"))
    every = told.join(placed, "vec", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return every.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
