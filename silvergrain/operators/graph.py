"""Graphs: components, near-duplicate groups, symmetric neighbours, clusters without a name, strokes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import TUNING
from ..storage import written

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of nodes with a link (a, b); a component is its least node.

    Rounds of large stars (a node's greater neighbours point at its least) and small stars
    (its lesser ones do) shrink any graph to stars in few rounds. Each round is written, so
    lineage stays short; counts and a sum of hashes tell when nothing changes.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if large:
            least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
            return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()

    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        now = written(star(star(now, True), False), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(threshold: int) -> tuple[list[int], int]:
    """(cuts of 64 bits into bands, the distance within which two such signatures lie in one band at least).

    As few bands as leave a distance of two bits: the wider a band, the fewer meet in it by chance.
    """
    n = threshold // 3 + 1
    return [64 * i // n for i in range(n + 1)], threshold // n


#: Signatures of one block, those of it that are compared with another block at once, and the share of all pairs up to which bands may bring pairs together by chance.
BLOCK, AT_ONCE = 16_384, 16
MOST_CHANCE = 0.01


def chance(threshold: int) -> float:
    """The share of all pairs of random signatures that meet in the ``bands``."""
    cuts, _ = bands(threshold)
    return sum((1 + b - a) ** 2 / 2 ** (b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _compared(signatures: DataFrame, threshold: int) -> DataFrame:
    """(s, t, distance) of different signatures at most ``threshold`` bits apart, each pair once.

    Distinct signatures are packed into blocks; a task compares a pair of blocks word by word. Work is
    quadratic with a machine instruction or two a pair; memory is two blocks, and a block travels once a pair of blocks.
    """
    one = written(signatures.select("s").distinct(), "distinct-signatures")
    blocks = max(1, -(-one.count() // BLOCK))
    packed = one.groupBy(F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("own")).agg(F.collect_list("s").alias("v"))
    both = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v")
    kind = pa.schema([("s", pa.int64()), ("t", pa.int64()), ("distance", pa.int32())])

    def near(a: np.ndarray, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(a), AT_ONCE):
            other = a[lo:] if b is None else b
            apart = np.bitwise_count(a[lo : lo + AT_ONCE, None] ^ other[None, :])
            at = np.flatnonzero(apart <= threshold)
            x, y = np.divmod(at, len(other))
            if b is None:  # inside a block each pair once
                x, y, at = x[y > x], y[y > x], at[y > x]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(a[lo + x].view(np.int64)), pa.array(other[y].view(np.int64)), pa.array(apart.ravel()[at].astype(np.int32))], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            for place, (i, j) in enumerate(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)):
                values = batch.column("v")[place].values.to_numpy().view(np.uint64)
                if i == j:
                    yield from near(values, None)
                elif held == (i, j):
                    yield from near(first, values)
                else:
                    held, first = (i, j), values

    tasks = min(blocks * (blocks + 1) // 2, 8 * one.sparkSession.sparkContext.defaultParallelism)
    return both.repartition(tasks, "i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "s long, t long, distance int")


def hamming_pairs(signatures: DataFrame, key: str, sig: str, threshold: int = TUNING.hamming) -> DataFrame:
    """(a, b, distance) with a < b of 64-bit signatures at most ``threshold`` bits apart; exact.

    Two such signatures lie within two bits of each other in one of the ``bands``. There the lesser
    is put at every value within one bit of its own, and the greater too, so they meet by equal
    values; a pair is kept in the first such band, at the least of the values where it meets
    there. A band has about 3 * 64 / ``threshold`` bits, so chance meetings of n signatures stay a
    small multiple of n while n is below two to that power. Where bands get so narrow that more than
    ``MOST_CHANCE`` of all pairs would meet, blocks of distinct signatures are compared instead. A threshold of 64 pairs all.
    """
    rows = signatures.where(F.col(sig).isNotNull()).select(F.col(key).alias("k"), F.col(sig).cast("long").alias("s"))
    if threshold < 64 and chance(threshold) > MOST_CHANCE:
        twin = rows.select(F.col("k").alias("l"), F.col("s").alias("t"))
        apart = _compared(rows, threshold).join(rows, "s").join(twin, "t").where("k <> l")
        equal = rows.join(twin, F.col("s") == F.col("t")).where("k < l")
        return apart.select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), "distance").union(equal.select("k", "l", F.lit(0)))
    if threshold >= 64:
        met, first = rows.withColumn("m", F.lit(0).cast("long")).withColumn("band", F.lit(0)), F.lit(True)
        other = met.select(F.col("k").alias("l"), F.col("s").alias("t"), "band", "m")
    else:
        cuts, within = bands(threshold)
        widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        value = lambda s, i: F.shiftrightunsigned(s, cuts[i]).bitwiseAND(F.lit((1 << widths[i]) - 1 if widths[i] < 63 else -1))
        near = lambda v, i: F.concat(F.array(v), F.array(*(v.bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long")) for k in range(widths[i]))))
        dealt = lambda wide: rows.select("k", "s", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), (near(value(F.col("s"), i), i) if wide else F.array(value(F.col("s"), i))).alias("at")) for i in range(len(widths))))).alias("p")).select("k", "s", "p.band", F.explode("p.at").alias("m"))
        met = dealt(within > 0)
        other = dealt(within > 1).select(F.col("k").alias("l"), F.col("s").alias("t"), "band", "m")
        meets = F.lit(False)
        for i in reversed(range(len(widths))):
            v, w = value(F.col("s"), i), value(F.col("t"), i)
            apart = v.bitwiseXOR(w)
            low = apart.bitwiseAND(-apart)
            at = F.when(apart == 0, v).when(F.bit_count(apart) == 1, F.least(v, w)).otherwise(F.least(v.bitwiseXOR(low), w.bitwiseXOR(low))) if within > 1 else w
            meets = F.when(F.bit_count(apart) <= within, (F.col("band") == i) & (F.col("m") == at)).otherwise(meets)
        first = meets
    pairs = met.join(other, ["band", "m"]).where((F.col("k") < F.col("l")) & (hamming(F.col("s"), F.col("t")) <= threshold) & first)
    return pairs.select(F.col("k").alias("a"), F.col("l").alias("b"), hamming(F.col("s"), F.col("t")).alias("distance"))


def near_duplicate_groups(signatures: DataFrame, key: str, sig: str, threshold: int = TUNING.hamming) -> DataFrame:
    """(node, component, size): transitive groups of two and more.

    Equal signatures are one before pairs are sought, so many copies cost no pairs.
    """
    rows = signatures.where(F.col(sig).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("node"), F.col(sig).cast("long").alias("sig"))
    heads = written(rows.groupBy("sig").agg(F.min("node").alias("head")), "signatures")
    copies = rows.join(heads, "sig").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = components(hamming_pairs(heads, "head", "sig", threshold).select("a", "b").union(copies))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "component").select("node", "component", "size")


#: Cells of the hashed grid: one column more than bits in a row.
HASH_WIDTH, HASH_HEIGHT = 8, 8


def _shares(size: int, cells: int) -> np.ndarray:
    """How much of each pixel each cell covers along a side, in whole numbers."""
    cell, pixel = np.arange(cells)[:, None] * size, np.arange(size)[None, :] * cells
    return np.maximum(0, np.minimum(cell + size, pixel + cells) - np.maximum(cell, pixel))


def difference_hash(pixels: Column, width: Column, height: Column) -> Column:
    """64 bits of a grey picture (bytes by row): whether a cell of a 9 x 8 grid is brighter than the one to its right.

    A cell is the mean of the pixels it covers, in whole numbers. Null where the bytes are no such picture.
    """
    @F.arrow_udf("long")
    def run(data: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        raw, sizes = data.to_pylist(), list(zip(w.to_pylist(), h.to_pylist(), strict=True))
        out: list[int | None] = [None] * len(raw)
        for x, y in {s for s in sizes if s[0] and s[1]}:
            own = [i for i, s in enumerate(sizes) if s == (x, y) and raw[i] is not None and len(raw[i]) == x * y]
            if own:
                grey = np.frombuffer(b"".join(raw[i] for i in own), np.uint8).reshape(len(own), y, x).astype(np.int64)
                cells = _shares(y, HASH_HEIGHT) @ grey @ _shares(x, HASH_WIDTH + 1).T
                bits = (cells[:, :, :-1] > cells[:, :, 1:]).reshape(len(own), -1)
                for i, v in zip(own, np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1).tolist(), strict=True):
                    out[i] = v
        return pa.array(out, pa.int64())

    return run(pixels, width, height)


def representatives(groups: DataFrame, ratings: DataFrame) -> DataFrame:
    """(component, representative, size): the highest rated member, the least of equals; unrated ones come last."""
    rated = groups.join(ratings.select(F.col("image").alias("node"), "rating"), "node", "left")
    best = rated.groupBy("component").agg(F.min(F.struct((-F.coalesce("rating", F.lit(-1))).alias("r"), "node")).alias("b"), F.first("size").alias("size"))
    return best.select("component", F.col("b.node").alias("representative"), "size").orderBy(F.desc("size"), "representative")


def redundant(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node): members that are not their group's representative."""
    return groups.join(chosen, F.col("node") == F.col("representative"), "left_anti").select("node").distinct()


def symmetric(knn: DataFrame) -> DataFrame:
    """(a, b, sim) with a < b of a directed graph (src, dst, sim); the greater of both directions counts."""
    return knn.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("sim").alias("sim"))


def unnamed_clusters(edges: DataFrame, affinity: DataFrame, floor: float = 1e-4, least_weight: float = 0.5, least_size: int = 3) -> DataFrame:
    """(component, size, coherence, members): groups among nodes that no topic claims.

    ``edges``: (a, b, sim). ``affinity``: (node, affinities), all nodes. An edge counts if both ends
    are unclaimed and it weighs enough; coherence is the mean weight.
    """
    unclaimed = affinity.where(F.coalesce(F.array_max("affinities"), F.lit(0.0)) <= floor).select("node")
    used = written(edges.where(F.col("sim") >= least_weight).join(unclaimed.select(F.col("node").alias("a")), "a", "left_semi").join(unclaimed.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "sim"), "unclaimed-edges")
    label = components(used)
    sized = label.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("node")).alias("members")).where(F.col("size") >= least_size)
    weight = used.join(label, F.col("a") == F.col("node")).groupBy("component").agg(F.avg("sim").alias("coherence"))
    return sized.join(weight, "component").select("component", "size", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "coherence")).alias("coherence"), "members")


#: Labels that clusters are compared with at most; their list is broadcast.
MOST_LABELS = 1000


def match_labels(clusters: DataFrame, labels: DataFrame, tolerance: float = 0.25, separation: float = 0.1) -> DataFrame:
    """(component, label): the label (label, size; a short list) nearest in relative size, null if it is far or another is as near.

    More than ``MOST_LABELS`` labels raise: each component is compared with all of them.
    """
    if labels.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    usable = labels.where(F.trim("label") != "").select(F.trim("label").alias("label"), F.col("size").alias("label_size"))
    distance = F.when((F.col("label_size") <= 0) | (F.col("size") <= 0), 1.0).otherwise(F.abs(F.col("label_size") - F.col("size")) / F.greatest("label_size", "size"))
    tried = clusters.select("component", "size").join(F.broadcast(usable), F.lit(True)).withColumn("d", distance)
    near = tried.groupBy("component").agg(F.min(F.struct("d", "label")).alias("best"), F.array_sort(F.collect_list("d")).alias("all"))
    clear = F.when(F.size("all") < 2, F.lit(True)).otherwise(F.element_at("all", 2) - F.element_at("all", 1) >= separation)
    named = near.select("component", F.when((F.col("best.d") <= tolerance) & clear, F.col("best.label")).alias("label"))
    return clusters.select("component").join(named, "component", "left")


def density_grid(points: DataFrame, cell: float, weight: str = "w") -> DataFrame:
    """(gx, gy, w): weights of points (x, y) summed by grid cell."""
    return points.groupBy(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")).agg(F.sum(weight).alias("w"))


#: Cells along a side of a tile that is blurred by one task.
TILE = 128


def blurred_field(grid: DataFrame, radius: int, passes: int = 3, tile: int = TILE) -> DataFrame:
    """(gx, gy, w) of a grid of cells after box blurs of (2 * radius + 1)^2 cells, as many as ``passes``; cells that are zero stay out.

    Cells are dealt by tiles, and those near a tile's edge to its neighbours too, as far as all
    blurs together reach; so a tile is blurred by itself. A box is a difference of running sums.
    """
    reach = radius * passes
    if reach > tile:
        raise ValueError("the blurs reach over a whole tile")
    near = lambda c: F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + d) / F.lit(tile)) for d in (-reach, 0, reach)))))
    dealt = grid.where("gx IS NOT NULL AND gy IS NOT NULL").withColumn("tx", near("gx")).withColumn("ty", near("gy")).select("tx", "ty", "gx", "gy", F.col("w").cast("double").alias("w"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = (int(k) * tile - reach for k in key)
        field = np.zeros((tile + 2 * reach, tile + 2 * reach))
        np.add.at(field, (pdf.gx.to_numpy() - x0, pdf.gy.to_numpy() - y0), pdf.w.to_numpy())
        for _ in range(passes):
            for axis in (0, 1):
                field = np.moveaxis(field, axis, 0)
                sums = np.concatenate([np.zeros((radius + 1, field.shape[1])), np.cumsum(field, axis=0)])
                sums = np.concatenate([sums, np.repeat(sums[-1:], radius, axis=0)])
                field = np.moveaxis((sums[2 * radius + 1 :] - sums[: -2 * radius - 1]) / (2 * radius + 1), 0, axis)
        inner = field[reach : reach + tile, reach : reach + tile]
        x, y = np.nonzero(np.abs(inner) > 1e-12)
        return pd.DataFrame({"gx": x + x0 + reach, "gy": y + y0 + reach, "w": inner[x, y]})

    return dealt.groupBy("tx", "ty").applyInPandas(run, "gx long, gy long, w double")


# ---------------------------------------------------------------- strokes: arrays of (x, y), fractions of width and height

# Steps of a coordinate, how far it may overshoot, what is too small and brief to keep.
GRID, OVERSHOOT = 10_000, 2_500
LEAST_LENGTH, LEAST_MS = 0.003, 100


def _steps(points: Column) -> tuple[Column, Column]:
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.slice(points, 1, n), F.slice(points, 2, n)


def stroke_length(points: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Column:
    """Path length in units of the image's long edge."""
    w, h = (x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    edge = F.greatest(w, h)
    pieces = F.zip_with(*_steps(points), lambda p, q: F.hypot((q["x"] - p["x"]) * (w / edge), (q["y"] - p["y"]) * (h / edge)))
    return F.aggregate(pieces, F.lit(0.0), lambda s, d: s + d)


def worth_keeping(length: Column, duration_ms: Column) -> Column:
    """A stroke goes only if it is both tiny and brief."""
    return ~((length < LEAST_LENGTH) & (duration_ms < LEAST_MS))


def quantized_points(points: Column) -> Column:
    """Fractions as whole steps, clamped where they overshoot the image too far."""
    q = lambda v: F.least(F.lit(GRID + OVERSHOOT), F.greatest(F.lit(-OVERSHOOT), F.floor(v * GRID + 0.5))).cast("int")
    return F.transform(points, lambda p: F.struct(q(p["x"]).alias("x"), q(p["y"]).alias("y")))


def _turned(p: Column, orientation: Column, back: bool) -> Column:
    """A point of the stored image as displayed under an EXIF orientation, or ``back``."""
    x, y = p["x"], p["y"]
    at = {1: (x, y), 2: (1 - x, y), 3: (1 - x, 1 - y), 4: (x, 1 - y), 5: (y, x), 6: (1 - y, x), 7: (1 - y, 1 - x), 8: (y, 1 - x)}
    if back:  # a quarter turn one way is undone by the other; the rest undo themselves
        at[6], at[8] = at[8], at[6]
    pick = lambda i: F.coalesce(*(F.when(orientation == k, v[i]) for k, v in at.items()), at[1][i])
    return F.struct(pick(0).alias("x"), pick(1).alias("y"))


def remapped(points: Column, drawn: Column, shown: Column) -> Column:
    """Points drawn under one EXIF orientation, as they lie under another."""
    return F.transform(F.transform(points, lambda p: _turned(p, drawn, True)), lambda p: _turned(p, shown, False))


def distance_to_stroke(points: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the polyline; to its only point where it has one."""
    def piece(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / long))).otherwise(F.lit(0.0))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    alone = F.transform(points, lambda p: F.hypot(x - p["x"], y - p["y"]))
    return F.when(F.size(points) > 1, F.array_min(F.zip_with(*_steps(points), piece))).otherwise(F.array_min(alone))


def eraser_pick(strokes: DataFrame, radius: float) -> DataFrame:
    """(mark, stroke): of strokes within ``radius`` of each mark (mark, x, y, id, points) the newest."""
    near = strokes.where(distance_to_stroke(F.col("points"), F.col("x"), F.col("y")) <= radius)
    return near.groupBy("mark").agg(F.max("id").alias("stroke"))
