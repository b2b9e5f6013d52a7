"""Greedy selection and k-means.

A greedy choice depends on those before it, but only as far as likeness reaches: so a scope is cut
into the connected components of the edges that count, and components run in parallel. Images
without such an edge are always shown and need no choice. A task's memory is the neighbour lists of
a component. k-means is sequential only in its rounds: rows stay distributed and
the centroids, a few vectors, go round by the driver.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TUNING
from ..storage import written
from .graph import components


def cutoff(tolerance: float, high: float = TUNING.cutoff_high, low: float = TUNING.cutoff_low) -> float:
    """From ``high`` at tolerance 0 down to ``low`` at 1."""
    t, a, b = (min(1.0, max(0.0, x)) for x in (tolerance, high, low))
    return max(a, b) - t * abs(a - b)


def trade_off(tolerance: float, floor: float = TUNING.lambda_floor) -> float:
    """The weight of quality: 1 at tolerance 0 down to ``floor`` at 1."""
    t, f = (min(1.0, max(0.0, x)) for x in (tolerance, floor))
    return 1 - t * (1 - f)


def _next(heap: list, key: Callable) -> object | None:
    """The node of the least key. Keys only grow, so a stale one goes back in with its present value."""
    while heap:
        old, node = heapq.heappop(heap)
        now = key(node)
        if now is None:
            continue
        if now == old:
            return node
        heapq.heappush(heap, (now, node))
    return None


def _heap(nodes: list, key: Callable) -> list:
    out = [(k, n) for n in nodes if (k := key(n)) is not None]
    heapq.heapify(out)
    return out


def _facility(nodes: list, near: dict, quality: dict, limit: float, _: float, until: tuple | None = None, told: list | None = None) -> list:
    """Take what covers most of what is not covered yet, until everything is.

    Picks come by rising keys. In a larger scope others may still be uncovered: with ``until``, picks up
    to that key are taken too. ``told`` gets the key of the pick that covers the last node.
    """
    cover, chosen, open_ = dict.fromkeys(nodes, 0.0), set(), set(nodes)

    def key(c: object) -> tuple | None:
        if c in chosen:
            return None
        own = 1.0 - cover[c] if cover[c] < limit else 0.0
        return -(own + sum(s - cover[n] for n, s in near[c].items() if s >= limit and s > cover[n])), -quality.get(c, 0.0), c

    heap = _heap(nodes, key)
    while (open_ or until) and (pick := _next(heap, key)) is not None:
        own = key(pick)
        if not open_ and own > until:
            break
        chosen.add(pick)
        cover[pick] = 1.0
        covered = bool(open_)
        open_.discard(pick)
        for n, s in near[pick].items():
            if s >= limit:
                cover[n] = max(cover[n], s)
                open_.discard(n)
        if covered and not open_ and told is not None:
            told.append(own)
    return list(chosen)


def _marginal(nodes: list, near: dict, quality: dict, limit: float, weight: float) -> list:
    """Take the best trade of quality against likeness to what is shown; what is too like goes."""
    closest, shown = dict.fromkeys(nodes, 0.0), set()

    def key(n: object) -> tuple | None:
        if n in shown or closest[n] >= limit:
            return None
        q = quality.get(n, 0.0)
        return -(weight * q - (1 - weight) * closest[n]), -q, n

    pick, heap = min(nodes, key=lambda n: (-quality.get(n, 0.0), n)), _heap(nodes, key)
    while pick is not None:
        shown.add(pick)
        for n, s in near[pick].items():
            closest[n] = max(closest[n], s)
        pick = _next(heap, key)
    return list(shown)


def _centers(nodes: list, near: dict, quality: dict, limit: float, _: float) -> list:
    """Take the farthest from all chosen ones, until none is far."""
    closest, chosen = dict.fromkeys(nodes, 0.0), set()

    def key(n: object) -> tuple | None:
        return None if n in chosen or closest[n] >= limit else (-(1 - closest[n]), -quality.get(n, 0.0), n)

    pick, heap = min(nodes, key=lambda n: (-quality.get(n, 0.0), n)), _heap(nodes, key)
    while pick is not None:
        chosen.add(pick)
        closest[pick] = 1.0
        for n, s in near[pick].items():
            closest[n] = max(closest[n], s)
        pick = _next(heap, key)
    return list(chosen)


METHODS = {"facility": _facility, "mmr": _marginal, "k_center": _centers}


def diversify(items: DataFrame, edges: DataFrame, method: str = "facility", tolerance: float = 0.5, scope: str = "scope") -> DataFrame:
    """(scope, image, shown): ``items`` (scope, image, quality) thinned by likeness ``edges`` (a, b, sim).

    Tolerance 0 shows everything; an image without neighbours is always shown. Facility gains flow
    along edges of at least the cutoff only, so components of those are chosen apart; as it goes on
    until the whole scope is covered, a first pass finds the last pick that covers anything, and each
    component then takes its picks up to that one. The other methods look at every edge.
    """
    limit, weight = cutoff(tolerance), trade_off(tolerance)
    rows = items.select(F.col(scope).alias("scope"), F.col("image").cast("long").alias("image"), F.col("quality").cast("double").alias("quality"))
    if tolerance <= 0:
        return rows.select(F.col("scope").alias(scope), "image", F.lit(True).alias("shown"))
    homes = rows.select("scope", "image").distinct()
    one_way = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))
    inside = one_way.where(F.col("sim") >= limit if method == "facility" else F.col("sim") > 0).join(homes.withColumnRenamed("image", "a"), "a").join(homes.select(F.col("scope").alias("sb"), F.col("image").alias("b")), "b").where("scope <=> sb").drop("sb")
    links = written(inside.select("scope", "a", "b", "sim"), "likeness")
    label = components(links.select(F.struct("scope", F.col("a").alias("image")).alias("a"), F.struct("scope", F.col("b").alias("image")).alias("b")))
    label = written(label.select("node.scope", "node.image", F.col("component.image").alias("part")), "likeness-parts")
    ends = lambda: label.select(F.col("scope").alias("ls"), F.col("image").alias("li"), F.col("part").alias("lp"))
    placed = rows.join(ends(), F.col("scope").eqNullSafe(F.col("ls")) & (F.col("image") == F.col("li")), "left").select("scope", "image", "quality", F.col("lp").alias("part"))
    alone = placed.where("part IS NULL")
    crowd = placed.where("part IS NOT NULL")
    of_part = links.join(ends(), F.col("scope").eqNullSafe(F.col("ls")) & (F.col("a") == F.col("li"))).select(F.col("scope").alias("scope"), F.col("lp").alias("part"), "a", "b", "sim")
    kind = rows.schema["scope"].dataType.simpleString()
    until = None
    if method == "facility":
        until = F.struct(F.lit(-1.0).alias("g"), (-F.coalesce(F.when(~F.isnan("quality"), F.col("quality")), F.lit(0.0))).alias("q"), F.col("image").alias("id"))
        last = crowd.groupBy("scope", "part").cogroup(of_part.groupBy("scope", "part")).applyInPandas(_picks(method, limit, weight, True), f"scope {kind}, g double, q double, id long")
        ends_at = last.select("scope", F.struct("g", "q", "id").alias("k")).union(alone.select("scope", until.alias("k"))).groupBy("scope").agg(F.max("k").alias("until"))
        crowd = crowd.join(written(ends_at, "likeness-ends").withColumnRenamed("scope", "us"), F.col("scope").eqNullSafe(F.col("us"))).drop("us").select("scope", "image", "quality", "part", F.col("until.g").alias("g"), F.col("until.q").alias("q"), F.col("until.id").alias("id"))
    chosen = crowd.groupBy("scope", "part").cogroup(of_part.groupBy("scope", "part")).applyInPandas(_picks(method, limit, weight, False), f"scope {kind}, image long, shown boolean")
    return alone.select("scope", "image", F.lit(True).alias("shown")).union(chosen).select(F.col("scope").alias(scope), "image", "shown")


def _picks(method: str, limit: float, weight: float, ends: bool) -> Callable:
    """Of one component its images with whether they are shown, or with ``ends`` the key of the pick that covers its last image."""

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(nodes.image.tolist()))
        near: dict = defaultdict(dict)
        for a, b, s in zip(links.a.tolist(), links.b.tolist(), links.sim.tolist(), strict=True):
            near[a][b] = near[b][a] = max(near[a].get(b, 0.0), s)
        quality = {n: q for n, q in zip(nodes.image.tolist(), nodes.quality.tolist(), strict=True) if q is not None and q == q}
        if ends:
            told: list = []
            _facility(names, near, quality, limit, weight, None, told)
            return pd.DataFrame([(key[0], *told[0])], columns=["scope", "g", "q", "id"])
        more = (tuple(nodes[["g", "q", "id"]].iloc[0]),) if "g" in nodes.columns else ()
        chosen = set(METHODS[method](names, near, quality, limit, weight, *more))
        return pd.DataFrame({"scope": [key[0]] * len(nodes), "image": nodes.image, "shown": [n in chosen for n in nodes.image]})

    return run


def cluster_count(n: int, low: int = TUNING.kmeans_low, high: int = TUNING.kmeans_high) -> int:
    return min(max(math.floor(math.sqrt(n / 2) + 0.5), max(low, 1)), max(high, low, 1))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, by one product."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0)


def kmeans(vectors: DataFrame, k: int | None = None, key: str = "vec_id", vec: str = "embedding", rounds: int = TUNING.kmeans_rounds) -> DataFrame:
    """(key, cluster, cosine): deterministic k-means from the least key on, farthest points as seeds.

    A seed round and a Lloyd round are one pass over the rows each; only sums and counts of
    each cluster, and the farthest point, come to the driver. Ties go to the least cluster or key.
    """
    rows = written(vectors.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("v")), "kmeans")
    n = rows.count()
    if not n:
        return rows.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0.0).alias("cosine"))
    k = min(k or cluster_count(n), n)
    first = rows.orderBy("key").limit(1).head()
    centroids = [np.array(first["v"])]

    def farthest(c: np.ndarray):
        def run(batches):
            for pdf in batches:
                x = np.stack(pdf.v.to_numpy())
                d = np.round(_squares(x, c).min(1), 9)
                i = np.lexsort((pdf.key.to_numpy(), -d))[0]
                yield pd.DataFrame({"d": [d[i]], "key": [pdf.key.iloc[i]], "v": [x[i]]})

        return run

    while len(centroids) < k:
        far = rows.mapInPandas(farthest(np.stack(centroids)), "d double, key long, v array<double>").orderBy(F.desc("d"), "key").limit(1).head()
        centroids.append(np.array(far["v"]))

    def sums(c: np.ndarray):
        def run(batches):
            for pdf in batches:
                x = np.stack(pdf.v.to_numpy())
                at = np.round(_squares(x, c), 9).argmin(1)
                for j in np.unique(at):
                    yield pd.DataFrame({"cluster": [int(j)], "n": [int((at == j).sum())], "s": [x[at == j].sum(0)], "keys": [int(pdf.key.to_numpy()[at == j].sum())]})

        return run

    seen = None
    for _ in range(max(1, rounds)):
        found = rows.mapInPandas(sums(np.stack(centroids)), "cluster int, n long, s array<double>, keys long").select("cluster", "n", "keys", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("keys").alias("keys")).collect()  # clusters times dimensions
        state = sorted({(r["cluster"], r["n"], r["keys"]) for r in found})
        total: dict = defaultdict(lambda: np.zeros(len(centroids[0])))
        for r in found:
            total[r["cluster"]][r["i"]] = r["x"] / r["n"]
        if state == seen:
            break
        seen = state
        centroids = [total[j] if j in total else c for j, c in enumerate(centroids)]
    final = np.stack(centroids)

    def assign(batches):
        for pdf in batches:
            x = np.stack(pdf.v.to_numpy())
            at = np.round(_squares(x, final), 9).argmin(1)
            scale = np.linalg.norm(x, axis=1) * np.linalg.norm(final[at], axis=1)
            cos = np.divide((x * final[at]).sum(1), scale, out=np.zeros(len(x)), where=scale > 0)
            yield pd.DataFrame({key: pdf.key, "cluster": at.astype("int32"), "cosine": cos})

    return rows.mapInPandas(assign, T.StructType([T.StructField(key, T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
