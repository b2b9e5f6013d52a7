"""Rank fusion and the hybrid search pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import TUNING

DIGITS = 9


@dataclass(frozen=True)
class Ranked:
    """One signal: rows (image, score); ``dense`` scores are cosines, best first, others BM25, least first."""

    name: str
    rows: DataFrame
    weight: float = 1.0
    dense: bool = False


def similarity_tilt(cos: Column, beta: float) -> Column:
    """``1 + beta * c`` with the cosine mapped to [0, 1], clamped and centred again."""
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos + 1) / 2))
    return 1 + F.lit(float(beta)) * (2 * unit - 1)


def contributions(signal: Ranked, k: float = TUNING.rrf_k, beta: float = TUNING.beta) -> DataFrame:
    """(image, signal, rank, score, part): rank is 1-based, ties by image."""
    order = F.col("score").desc() if signal.dense else F.col("score").asc()
    ranked = signal.rows.select("image", F.col("score").cast("double").alias("score")).withColumn("rank", F.row_number().over(W.orderBy(order, "image")))
    part = F.lit(float(signal.weight)) / (F.lit(float(k)) + F.col("rank"))
    if signal.dense:
        part = part * similarity_tilt(F.col("score"), beta)
    return ranked.select("image", F.lit(signal.name).alias("signal"), "rank", "score", part.alias("part"))


def fuse(signals: Sequence[Ranked], recency: DataFrame | None = None, k: float = TUNING.rrf_k, beta: float = TUNING.beta, limit: int = TUNING.result_limit) -> DataFrame:
    """(image, fused, n_signals), best first; ties by last annotation (latest first, missing last), then image.

    Each signal is a list that its own limit has cut to a few hundred rows, so ranking one in
    a single task is bounded.
    """
    parts = reduce(DataFrame.unionByName, (contributions(s, k, beta) for s in signals))
    total = parts.groupBy("image").agg(F.round(F.sum("part"), DIGITS).alias("fused"), F.count(F.lit(1)).alias("n_signals"))
    if recency is None:
        return total.orderBy(F.desc("fused"), "image").limit(limit)
    return total.join(recency.select("image", "last_ts"), "image", "left").orderBy(F.desc("fused"), F.col("last_ts").desc_nulls_last(), "image").limit(limit)


def explained(fused: DataFrame, chains: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Adds ``because`` from the first provenance (image, because) that has the image; results without one go.

    Runs after the limit, so dropped results are not replaced.
    """
    out = fused
    for i, (_, rows) in enumerate(chains):
        out = out.join(rows.groupBy("image").agg(F.min("because").alias(f"__b{i}")), "image", "left")
    names = F.coalesce(*(F.when(F.col(f"__b{i}").isNotNull(), F.concat(F.lit(f"{name}: "), F.col(f"__b{i}"))) for i, (name, _) in enumerate(chains)))
    return out.withColumn("because", names).drop(*(f"__b{i}" for i in range(len(chains)))).where(F.col("because").isNotNull())


def hybrid(text_hits: DataFrame, vector_signals: Sequence[Ranked], recency: DataFrame | None = None, k: float = TUNING.rrf_k, beta: float = TUNING.beta, weight: float = 1.0, limit: int = TUNING.result_limit) -> DataFrame:
    """Text hits fused with vector signals; without any of these, exactly the text result in its order."""
    if not vector_signals:
        return text_hits.select("image", "score").orderBy("score", "image").limit(limit)
    return fuse([Ranked("text", text_hits, weight), *vector_signals], recency, k, beta, limit)
