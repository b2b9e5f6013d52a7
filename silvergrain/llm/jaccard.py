"""N-gram Jaccard join by grouped prefixes.

Two documents link when their sets of shingles overlap by at least ``THRESHOLD`` per cent of
the union. The join is exact (on 64-bit hashes of shingles):

1. Every shingle of the corpus is counted. Those in ``HOT`` documents or more are hot; each
   set is ordered with its hot shingles last, else by hash. Sets that overlap enough share a
   shingle in their prefixes, a fifth of the set.
2. Documents with equal sets are one class. Classes of equal size and prefix are one group.
3. Cold shingles (in few documents) are dealt by hash range; each range finds group pairs that
   share one at places that leave enough behind (size and positional filters), and the numbers
   of shared prefix shingles over all ranges filter the pairs once more.
   Hot shingles in prefixes may stand in very many groups: there each group is paired with one
   pivot only, the group in which the shingle stands foremost.
4. Pairs expand to classes, least member first, are verified on whole sets, and links join
   into components. What a component already holds needs no further pair; members outside
   their pivot's component are then paired with the rest of the bucket under the same filters,
   and verified too. So no link between different components is lost, and a group of many near
   copies costs in proportion to its size plus its outsiders.

Sets are never collected: they travel to the partner of each verified pair, the smaller of
the two to the larger. The list of hot shingles is bounded by ``MOST_HOT``; were it longer,
the count from which a shingle is hot rises, which changes the work and not the result.

Edge cases: null and empty texts have no shingles and link with nothing; fewer words than a
shingle are one shingle; a null id links with nothing and has a null component; rows with
the same id and different texts are told apart by their sets; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import rechunk, written
from .shingles import WIDTH, by_range, digest, pack, range_cuts, shingle_set, steps, unpack

THRESHOLD = 80
HOT = 50
MOST_HOT = 4_000_000
#: Bits of a hash in the count; more cells than a corpus of 100 TB has shingles.
COUNT_BITS = 44
#: Texts' bytes for each range of hashes when shingles are counted, and when groups meet: there a pair
#: comes out once a range, so fewer ranges are better. With more than ``FEW_RANGES`` a range has ``MOST_RANGE_BYTES`` at most.
COUNT_RANGE_BYTES, MEET_RANGE_BYTES, FEW_RANGES, MOST_RANGE_BYTES = 8 << 20, 64 << 20, 8192, 128 << 20
#: A task hands over what it has gathered when it holds so many shingles, or more of them if there are many ranges.
FLUSH, MOST_FLUSH = 2_000_000, 16_000_000
#: Parts into which the rows of a hot shingle are dealt.
SALTS = 16
#: So many ids at most are broadcast when texts are read again; more are joined.
BROADCAST_IDS = 1_000_000


def _ranges(spark: SparkSession, size: int, each: int) -> int:
    """In how many ranges hashes are dealt out for ``size`` bytes of text; a range's share stays bounded as texts grow."""
    few = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // each)
    return few if few <= FEW_RANGES else max(FEW_RANGES, size // MOST_RANGE_BYTES)


def _flush(ranges: int) -> int:
    return min(MOST_FLUSH, max(FLUSH, 256 * ranges))


def prefix_length(n: int, percent: int = THRESHOLD) -> int:
    return n - -(-percent * n // 100) + 1


def required(a: Column, b: Column, percent: int = THRESHOLD) -> Column:
    """The least overlap of linked sets of sizes a and b."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent)).cast("long")


def _required(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (a + b) // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in rechunk(batches, 256):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield i, shingle_set(t, width)


# ---------------------------------------------------------------- 1: counts


def hot_cells(docs: DataFrame, ranges: int, width: int, hot: int, most: int = MOST_HOT) -> np.ndarray:
    """The cells (upper bits of hashes) of hot shingles, sorted; ``docs`` has doc_id and text.

    Copies of a set count once in each task. Only the list itself, at most ``most`` long,
    comes to the driver.
    """
    drop, flush = np.uint64(64 - COUNT_BITS), _flush(ranges)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def hand_over() -> pa.RecordBatch:
            every = np.concatenate(held)
            every.sort()
            cuts = range_cuts(every, ranges)
            cells = every >> drop
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = [pack(steps(cells[cuts[i] : cuts[i + 1]])) for i in some.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["range", "cells"])

        for _, s in _sets(batches, width):
            key = hash(s.tobytes())
            if key in seen:
                continue
            seen.add(key)
            held.append(s)
            size += len(s)
            if size >= flush:
                yield hand_over()
                held, size = [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        if size:
            yield hand_over()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_range(batches):
            cells = np.concatenate([np.cumsum(unpack(r["cells"]), dtype=np.uint64) for r in rows])
            cells.sort()
            first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            n = np.diff(np.r_[first, len(cells)])
            keep = n >= hot
            yield pa.RecordBatch.from_arrays([pa.array(cells[first[keep]].astype(np.int64)), pa.array(n[keep])], names=["cell", "n"])

    dealt = docs.mapInArrow(gather, "range int, cells binary")
    counted = written(dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(count, "cell long, n long"), "hot-shingles")
    if counted.count() > most:
        steps_ = counted.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("s")).count().orderBy(F.desc("s")).collect()  # some hundred rows
        total, least = 0, None
        for r in steps_:
            total += r["count"]
            if total > most:
                break
            least = r["s"]
        counted = counted.where(F.floor(F.log2("n") * 8) >= (least if least is not None else 1 << 30))
    return np.sort(np.array(counted.select("cell").toArrow().column(0).to_numpy(), np.uint64))


class Order:
    """Prefixes under the order: cold shingles by hash, then hot ones by hash."""

    def __init__(self, cells: np.ndarray, percent: int):
        self.cells, self.percent, self.drop = cells, percent, np.uint64(64 - COUNT_BITS)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cold and the hot shingles of the prefix."""
        n = prefix_length(len(s), self.percent)
        if not len(self.cells):
            return s[:n], s[:0]
        cell = s >> self.drop
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        is_hot = self.cells[at] == cell
        cold = s[~is_hot][:n]
        return cold, s[is_hot][: n - len(cold)]

    def group(self, s: np.ndarray, cold: np.ndarray, hot: np.ndarray) -> bytes:
        """16 bytes that stand for size and prefix."""
        return digest(np.concatenate([cold, hot, np.array([len(s)], np.uint64)]))


# ---------------------------------------------------------------- 2: classes

CLASSES = "doc_id long, n long, digest binary, gid binary, n_cold long, hot array<long>, cold binary"


def describe(docs: DataFrame, cells, percent: int, width: int) -> DataFrame:
    """A row per document: size, digest and group of its set, and the hot and the cold part of its prefix."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("gid", pa.binary()), ("n_cold", pa.int64()), ("hot", pa.list_(pa.int64())), ("cold", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, rows = Order(cells.value, percent), []
        for i, s in _sets(batches, width):
            if len(s):
                cold, hot = order.prefix(s)
                rows.append((i, len(s), digest(s), order.group(s, cold, hot), len(cold), hot.astype(np.int64), cold.tobytes()))
            else:
                rows.append((i, 0, None, None, 0, None, None))
            if len(rows) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, CLASSES)


# ---------------------------------------------------------------- 3: pairs of groups


def _pairs_of(gid: bytes | list[bytes]) -> np.ndarray:
    """Group numbers as rows of two 64-bit numbers."""
    return np.frombuffer(gid if isinstance(gid, bytes) else b"".join(gid), np.uint64).reshape(-1, 2)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binary of 16 bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def cold_pairs(told: DataFrame, ranges: int, percent: int) -> DataFrame:
    """Pairs (a, b) of groups that share enough cold shingles of their prefixes; ``told`` is described."""
    flush = _flush(ranges)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, bytes, int, int]] = []
        size, seen = 0, set()

        def hand_over() -> pa.RecordBatch:
            lengths = [len(h[0]) for h in held]
            token = np.concatenate([h[0] for h in held])
            owner = np.repeat(np.arange(len(held)), lengths)
            place = np.concatenate([np.arange(k) for k in lengths])
            by = np.argsort(token, kind="stable")
            token, owner, place = token[by], owner[by], place[by]
            gid, n, n_hot = _pairs_of([h[1] for h in held]), *(np.array([h[k] for h in held], np.int64) for k in (2, 3))
            cuts, out = range_cuts(token, ranges), []
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    own, local = np.unique(owner[a:b], return_inverse=True)
                    out.append((r, pack(steps(token[a:b])), pack(local), pack(place[a:b]), gid[own].tobytes(), pack(n[own]), pack(n_hot[own])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)], names=["range", "token", "local", "place", "gid", "n", "n_hot"])

        for batch in batches:
            for g, n, n_hot, cold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g in seen:  # the group is collapsed here, and the rest where ranges meet
                    continue
                seen.add(g)
                held.append((np.frombuffer(cold, np.uint64), g, n, n_hot))
                size += len(held[-1][0])
                if size >= flush:
                    yield hand_over()
                    held, size = [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if held:
            yield hand_over()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_range(batches):
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for r in rows:
                local, gid = unpack(r["local"]).astype(np.int64), _pairs_of(r["gid"])
                columns = np.cumsum(unpack(r["token"]), dtype=np.uint64), gid[local, 0], gid[local, 1], unpack(r["place"]).astype(np.int64), unpack(r["n"]).astype(np.int64)[local], unpack(r["n_hot"]).astype(np.int64)[local]
                for k, x in enumerate(columns):
                    parts[k].append(x)
            token, g0, g1, place, n, n_hot = map(np.concatenate, parts)
            by = np.lexsort((g1, g0, token))
            token, g0, g1, place, n, n_hot = (x[by] for x in (token, g0, g1, place, n, n_hot))
            once = np.r_[True, (token[1:] != token[:-1]) | (g0[1:] != g0[:-1]) | (g1[1:] != g1[:-1])]
            token, g0, g1, place, n, n_hot = (x[once] for x in (token, g0, g1, place, n, n_hot))
            twice = np.r_[False, token[1:] == token[:-1]] | np.r_[token[1:] == token[:-1], False]
            token, g0, g1, place, n, n_hot = (x[twice] for x in (token, g0, g1, place, n, n_hot))
            found, step = [], 1
            while step < len(token):  # a cold run is shorter than HOT
                i = np.flatnonzero(token[step:] == token[:-step])
                if not len(i):
                    break
                j = i + step
                need = _required(n[i], n[j], percent)
                foremost = (n[i] - place[i] >= need) & (n[j] - place[j] >= need)
                ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                if len(i):
                    found.append(np.stack([x.astype(np.int64) for x in (g0[i].view(np.int64), g1[i].view(np.int64), g0[j].view(np.int64), g1[j].view(np.int64), n[i], n[j], np.minimum(n_hot[i], n_hot[j]), foremost[ok])]))
                step += 1
            if found:
                every = np.concatenate(found, axis=1)
                every = every[:, np.lexsort(every[3::-1])]
                first = np.flatnonzero(np.r_[True, (every[:4, 1:] != every[:4, :-1]).any(axis=0)])
                c = np.diff(np.r_[first, every.shape[1]])
                every[7, first] = np.maximum.reduceat(every[7], first)
                every = every[:, first]
                yield pa.RecordBatch.from_arrays([_binary(every[:2].T), _binary(every[2:4].T), *(pa.array(x) for x in every[4:]), pa.array(c)], names=["a", "b", "na", "nb", "n_hot", "foremost", "c"])

    rows = told.where("n_cold > 0").select("gid", "n", F.size("hot").alias("n_hot"), "cold")
    dealt = rows.mapInArrow(gather, "range int, token binary, local binary, place binary, gid binary, n binary, n_hot binary")
    met = dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(meet, "a binary, b binary, na long, nb long, n_hot long, foremost long, c long")
    pairs = met.groupBy("a", "b").agg(F.sum("c").alias("c"), *(F.max(x).alias(x) for x in ("na", "nb", "n_hot", "foremost")))
    behind = lambda n: F.ceil(n * F.lit(percent) / F.lit(100)) - 1  # noqa: E731  n less its prefix
    most = F.col("c") + F.col("n_hot") + F.greatest(behind(F.col("na")), behind(F.col("nb")))
    return pairs.where((F.col("foremost") == 1) & (most >= required(F.col("na"), F.col("nb"), percent))).select("a", "b")


def _fits(a: str, b: str, percent: int) -> Column:
    """Size and positional filters on the columns ``na``/``nb`` and ``pa``/``pb`` of a hot bucket."""
    na, nb, pa_, pb = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"p{a}"), F.col(f"p{b}")
    need = required(na, nb, percent)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (na - pa_ >= need) & (nb - pb >= need)


# ---------------------------------------------------------------- 4: verification


def class_number() -> Column:
    """What tells a class from others: its set, as a doc_id may stand for several sets."""
    return F.col("digest")


def set_digest(text: Column, width: int = WIDTH) -> Column:
    """The digest of a text's set, null without shingles."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([digest(s) if len(s) else None for s in (shingle_set(t, width) for t in texts.to_pylist())], pa.binary())

    return run(text)


def set_rows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, digest, set) of the classes ``wanted`` (rep, digest, least); reads the texts again, only theirs are shingled."""
    ids = wanted.select(F.col("least").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rechunk(batches, 64):
            found = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["digest", "set"])

    return chosen.mapInArrow(run, "digest binary, set binary").withColumn("rep", class_number()).join(wanted.select("rep", "digest").distinct(), ["rep", "digest"], "left_semi").dropDuplicates(["rep"])


def _overlap_udf():
    @F.arrow_udf("long")
    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort()
            out.append(int((both[1:] == both[:-1]).sum()))
        return pa.array(out, pa.int64())

    return overlap


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b) of classes, as (least id, class); runs jobs."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct().join(classes.select("rep", "digest", "n", "least"), "rep")
    sizes = written(wanted, "wanted")
    sets = written(set_rows(docs, sizes, width), "sets")
    with_n = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    swap = F.col("na") > F.col("nb")
    sent = with_n.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), (F.col("na") + F.col("nb")).alias("both"))
    joined = sent.join(sets.select(F.col("rep").alias("x"), F.col("set").alias("sx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("set").alias("sy")), "y")
    counted = joined.select("x", "y", "both", _overlap_udf()(F.col("sx"), F.col("sy")).alias("o"))
    good = counted.where(F.col("o") * 100 >= (F.col("both") - F.col("o")) * percent)
    node = lambda x: sizes.select(F.col("rep").alias(x), F.struct("least", "rep").alias(f"node_{x}"))
    return written(good.join(node("x"), "x").join(node("y"), "y").select(F.col("node_x").alias("a"), F.col("node_y").alias("b")), "links")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = THRESHOLD, width: int = WIDTH, hot: int = HOT, most_hot: int = MOST_HOT, set_name: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, and the digest of its set if ``set_name`` is given."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    size = named.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    cells = spark.sparkContext.broadcast(hot_cells(named, _ranges(spark, size, COUNT_RANGE_BYTES), width, hot, most_hot))
    told = written(describe(docs, cells, percent, width), "described")
    some = told.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(some.groupBy("digest", "n", "gid").agg(F.min("doc_id").alias("least")).withColumn("rep", class_number()), "classes")
    heads = classes.groupBy("gid").agg(F.min("rep").alias("head"))

    # first: the least member of each group with the group's others, and with its partners
    cold = written(cold_pairs(some, _ranges(spark, size, MEET_RANGE_BYTES), percent), "cold-pairs")
    hot_rows = some.where(F.size("hot") > 0).groupBy("gid").agg(F.first("n").alias("n"), F.first("n_cold").alias("n_cold"), F.first("hot").alias("hot")).join(heads, "gid")
    bucket = hot_rows.select("gid", "n", "n_cold", "head", F.posexplode("hot").alias("i", "token")).select("token", F.col("gid").alias("b"), F.col("n").alias("nb"), (F.col("n_cold") + F.col("i")).alias("pb"), F.col("head").alias("rb"))
    # one shingle may stand in very many groups: its rows are dealt by a salt
    bucket = written(bucket.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))), "hot-buckets")
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    pivots = bucket.groupBy("token").agg(F.min(F.struct("pb", "b", "nb", "rb")).alias("o"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pivots = written(pivots.select("token", F.col("o.b").alias("a"), F.col("o.nb").alias("na"), F.col("o.pb").alias("pa"), F.col("o.rb").alias("ra")), "pivots")
    star = bucket.join(pivots.select("*", every_salt), ["token", "salt"]).where((F.col("a") != F.col("b")) & _fits("a", "b", percent)).select("a", "b", "ra", "rb")
    cold_heads = cold.join(heads.select(F.col("gid").alias("a"), F.col("head").alias("ra")), "a").join(heads.select(F.col("gid").alias("b"), F.col("head").alias("rb")), "b").select("a", "b", "ra", "rb")
    group_pairs = written(cold_heads.union(star).distinct(), "group-pairs")
    across = group_pairs.select("ra", "rb")
    inside = classes.join(heads, "gid").where("rep <> head").select(F.col("head").alias("ra"), F.col("rep").alias("rb"))
    first = written(across.union(inside).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "first-pairs")
    links = verified(docs, first, classes, percent, width)
    stars = components(links)
    label = stars.select("node.rep", F.col("component.rep").alias("label"))

    # then: what lies in different components so far
    member = written(classes.join(label, "rep", "left").select("gid", "rep", "n", F.coalesce("label", "rep").alias("label")), "members")
    side = lambda x: member.select(F.col("gid").alias(x), F.col("rep").alias(f"r{x}"), F.col("label").alias(f"l{x}"))
    crowded = member.groupBy("gid").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gid")
    own = crowded.select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    both = group_pairs.select("a", "b")
    wide = both.join(crowded, F.col("a") == F.col("gid"), "left_semi").union(both.join(crowded, F.col("b") == F.col("gid"), "left_semi")).distinct().union(own)
    expanded = wide.join(side("a"), "a").join(side("b"), "b").where("la <> lb").select("ra", "rb")
    places = bucket.drop("rb").join(side("b"), "b")
    pivot_label = pivots.join(member.select(F.col("rep").alias("ra"), F.col("label").alias("lp")), "ra").select("token", "lp", every_salt)
    outside = places.join(pivot_label, ["token", "salt"]).where("lb <> lp").select("token", F.col("rb").alias("ra"), F.col("lb").alias("la"), F.col("nb").alias("na"), F.col("pb").alias("pa"), every_salt)
    rest = outside.join(places, ["token", "salt"]).where((F.col("la") != F.col("lb")) & _fits("a", "b", percent)).select("ra", "rb")
    more = expanded.union(rest).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = written(more, "more-pairs")
    if more.limit(1).count():
        stars = components(links.union(verified(docs, more, classes, percent, width)))

    # classes are ordered by their least ids, so a component's least class tells its least id
    lowest = stars.select("node.rep", F.col("component.least").alias("lowest"))
    placed = classes.join(lowest, "rep", "left").select("digest", "n", F.coalesce("lowest", "least").alias("component"))
    every = told.select("doc_id", "n", "digest").join(placed, ["digest", "n"], "left")
    named_set = [F.col("digest").alias(set_name)] if set_name else []
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), *named_set)
