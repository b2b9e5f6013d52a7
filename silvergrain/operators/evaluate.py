"""Retrieval quality: metrics of ranked lists against relevant sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def query_metrics(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 10, by: str = "query") -> DataFrame:
    """(by, precision, recall, mrr, ndcg) of each of ``queries``; MRR looks at the whole list.

    ``ranked``: (by, item, rank from 1); an item's first place counts. ``relevant``: (by, item).
    """
    first = ranked.groupBy(by, "item").agg(F.min("rank").alias("rank"))
    wanted = relevant.select(by, "item").distinct()
    total = wanted.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    hits = first.join(wanted, [by, "item"])
    inside = F.col("rank") <= k
    found = hits.groupBy(by).agg(F.count_if(inside).alias("hits"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.min("rank").alias("first"))
    rows = queries.select(by).distinct().join(total, by, "left").join(found, by, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), DIGITS)
    return rows.select(
        by, zero(F.col("hits") / k if k else F.lit(0.0)).alias("precision"), zero(F.when(F.col("total") > 0, F.col("hits") / F.col("total"))).alias("recall"),
        zero(1 / F.col("first")).alias("mrr"), zero(F.when((F.col("total") > 0) & F.lit(k > 0), F.col("dcg") / ideal)).alias("ndcg"),
    )


def mean_metrics(scored: DataFrame) -> DataFrame:
    """One row of means over queries; zeros without queries."""
    return scored.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS).alias(c) for c in ("precision", "recall", "mrr", "ndcg")))


def sweep(configs: list[tuple[str, DataFrame]], queries: DataFrame, relevant: DataFrame, k: int = 10, by: str = "query") -> DataFrame:
    """(config, queries, precision, ...): the mean metrics of each configuration's ranked lists."""
    out = None
    for name, ranked in configs:
        one = mean_metrics(query_metrics(queries, ranked, relevant, k, by)).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def rank_configs(results: DataFrame, metric: str, cost: str | None = None, budget: float | None = None) -> DataFrame:
    """Configurations by metric, then cost, then name; those over budget go."""
    if cost and budget is not None:
        results = results.where(F.col(cost) <= budget)
    return results.orderBy(F.desc(metric), *([F.col(cost)] if cost else []), "config")


def regressions(measured: DataFrame, baseline: DataFrame, absolute: float = 0.01, relative: float = 0.05) -> DataFrame:
    """(metric, measured, baseline, ok): a metric fails when it is below its baseline by more than both tolerances allow."""
    both = baseline.select("metric", F.col("value").alias("baseline")).join(measured.select("metric", F.col("value").alias("measured")), "metric", "left")
    allowed = F.greatest(F.lit(absolute), F.col("baseline") * relative)
    return both.select("metric", "measured", "baseline", F.coalesce(F.col("measured") >= F.col("baseline") - allowed, F.lit(False)).alias("ok"))
