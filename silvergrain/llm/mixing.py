"""Mixing sources to target weights by Poisson replication.

A source that should make up the share ``w`` of the mix gets the rate ``w * total / own``,
the mean number of times each of its documents appears. A document's own count comes from
its hash: the hash gives a number in [0, 1), which the inverse of the Poisson distribution
with that mean turns into a count. The document is exploded into so many copies, and the
copies are ordered by a hash of document and copy number, a global shuffle. The same seed
gives the same mix on every run and on every partitioning.

A mean over ``PART`` is split into equal parts with a hash each, whose counts add up to the
same distribution; one over ``LARGE`` is inverted by an expansion of the distribution instead.
A document with more than ``DEALT`` copies is first dealt out as ranges of copies, so no task
writes more than that of one document at once; rates have no upper limit.

Edge cases: rows without a source form a source of their own; a source missing in ``weights``
gets the weight 0 and goes, unless no weights are given, which means equal weights; a source
whose sizes sum to 0 (empty or null texts) is sized by its rows; rows with equal ids and
sources get equal counts; an empty table stays empty; other columns
pass through, and those that bear an output's name give way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import written

PART = 16.0
LARGE = 1024.0
#: Copies of one document that one row becomes in one step.
DEALT = 4096
#: So many sources at most are broadcast (each some 100 bytes to 1 kB); more are joined with salt.
BROADCAST_SOURCES = 20_000
SALTS = 64
DIGITS = 13  # hexadecimal: 52 bits, exact in a double


def hash_bits(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, DIGITS), 16, 10).cast("bigint")


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in any SQL engine."""
    return hash_bits(*parts).cast("double") / F.lit(float(16**DIGITS))


def _polynomial(x: Column, *c: float) -> Column:
    """c[0] x^n + c[1] x^(n-1) + ... by Horner's rule."""
    return reduce(lambda acc, k: acc * x + k, c[1:], F.lit(c[0]))


def normal_quantile(u: Column) -> Column:
    """The inverse of the normal distribution by Acklam's rational approximation, 1e-9 of its value off at most."""
    # The published coefficients.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    low = F.lit(0.02425)
    q, edge = u - 0.5, F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    middle = _polynomial(q * q, *a) * q / _polynomial(q * q, *b)
    tail = _polynomial(edge, *c) / _polynomial(edge, *d)
    return F.when(u < low, tail).when(u > 1 - low, -tail).otherwise(middle)


def large_poisson(mean: Column, u: Column) -> Column:
    """The inverse of the Poisson distribution for a mean over ``LARGE`` by the Cornish-Fisher expansion, one count off at most."""
    z = normal_quantile(F.greatest(u, F.lit(0.5 / 16**DIGITS)))
    return F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * F.sqrt(mean)) + 0.5)).cast("bigint")


def poisson_cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as a double can tell it from 1."""
    steps = F.sequence(F.lit(1), F.ceil(mean * 2 + 40).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    return F.aggregate(
        steps,
        start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", size: str = "n_chars") -> tuple[DataFrame, int, float]:
    """Per source its size, its rows, and ``rate``, the mean number of copies of its documents; how many sources there are; the greatest rate."""
    per = docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(F.coalesce(F.col(size), F.lit(0))), F.lit(0)).cast("double").alias("size"), F.count(F.lit(1)).cast("double").alias("rows"))
    per = written(per.withColumn("size", F.when(F.col("size") > 0, F.col("size")).otherwise(F.col("rows"))), "sources")
    if weights is None:
        per = per.withColumn("weight", F.lit(1.0))
    else:
        table = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w))))) if weights else F.create_map().cast("map<string,double>")
        per = per.withColumn("weight", F.coalesce(F.element_at(table, F.col("source")), F.lit(0.0)))
    all_weight, all_size, n_sources, steepest = per.agg(F.sum("weight"), F.sum("size"), F.count(F.lit(1)), F.max(F.col("weight") / F.col("size"))).head()
    share = F.col("weight") / F.lit(all_weight or 1.0)
    rate = F.when(F.col("weight") > 0, share * F.lit(all_size or 0.0) / F.col("size")).otherwise(F.lit(0.0))
    return per.select("source", "size", "rows", "weight", rate.alias("rate")), n_sources, (steepest or 0.0) * (all_size or 0.0) / (all_weight or 1.0)


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, key: str = "doc_id", source: str = "source", size: str = "n_chars", copy_name: str = "copy", order_name: str = "mix_order") -> DataFrame:
    """``docs`` exploded by their counts, with the copy number (from 1; a long if it may pass an int) and the shuffle key."""
    plan, n_sources, most = rates(docs, weights, source, size)
    plan = plan.where(F.col("rate") > 0).select(F.col("source").alias("__sg_source"), F.col("rate").alias("__sg_rate"))
    parts = F.when(F.col("__sg_rate") > LARGE, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("__sg_rate") / PART))).cast("int")
    plan = plan.withColumn("__sg_parts", parts).withColumn("__sg_cdf", F.when(F.col("__sg_parts") > 0, poisson_cdf(F.col("__sg_rate") / F.greatest(F.col("__sg_parts"), F.lit(1)))))
    same = F.col(source).eqNullSafe(F.col("__sg_source"))
    if n_sources <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(plan), same)
    else:  # a hot source's rows go to as many tasks as there are salts
        salted = plan.withColumn("__sg_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__sg_row_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__sg_row_salt") == F.col("__sg_salt"))).drop("__sg_row_salt", "__sg_salt")
    unit = lambda part: hash_unit(F.lit(seed), F.col(key), part)
    drawn = F.aggregate(F.sequence(F.lit(1), F.greatest("__sg_parts", F.lit(1))), F.lit(0).cast("bigint"), lambda n, part: n + F.size(F.filter("__sg_cdf", lambda c: unit(part) >= c)))
    one = F.size(F.filter("__sg_cdf", lambda c: F.col("__sg_unit") >= c)).cast("bigint")
    n = one  # only the ways that some rate calls for: a smaller expression compiles better
    if most > PART:
        n = F.when(F.col("__sg_parts") == 1, one).otherwise(drawn)
    if most > LARGE:
        n = F.when(F.col("__sg_parts") > 0, n).otherwise(large_poisson(F.col("__sg_rate"), F.col("__sg_unit")))
    counted = joined.withColumn("__sg_unit", unit(F.lit(1))).withColumn("__sg_n", n).drop("__sg_source", "__sg_parts", "__sg_cdf", "__sg_unit", "__sg_rate")
    bound = most + 12 * math.sqrt(most) + 60
    copies = _exploded(counted.drop(copy_name).where(F.col("__sg_n") > 0), bound)
    copies = copies.withColumn(copy_name, F.col("__sg_number").cast("int" if bound < 2**31 else "bigint")).drop("__sg_number")
    ordered = copies.withColumn(order_name, hash_unit(F.lit(seed), F.col(key), F.col(copy_name), F.lit("order")))
    # rows that share key and copy, and so their order, are dealt to several tasks
    return ordered.withColumn("__sg_deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition(F.col(order_name), F.col("__sg_deal")).drop("__sg_deal").sortWithinPartitions(order_name)


def _exploded(counted: DataFrame, most: float) -> DataFrame:
    """A row per copy, numbered from 1 as ``__sg_number``, of rows with ``__sg_n`` copies; ``most`` bounds that number.

    While ranges of copies are longer than ``DEALT``, they are cut and dealt out over tasks.
    """
    rows, length = counted.withColumn("__sg_first", F.lit(1).cast("bigint")), DEALT
    while length * DEALT < most:
        length *= DEALT
    while length >= DEALT and most > DEALT:
        last = F.col("__sg_first") + F.col("__sg_n") - 1
        rows = rows.withColumn("__sg_at", F.explode(F.sequence(F.col("__sg_first"), last, F.lit(length).cast("bigint"))))
        rows = rows.withColumn("__sg_n", F.least(F.lit(length).cast("bigint"), last - F.col("__sg_at") + 1)).drop("__sg_first").withColumnRenamed("__sg_at", "__sg_first")
        rows = rows.repartition(F.xxhash64("__sg_first", F.monotonically_increasing_id()))
        length //= DEALT
    return rows.withColumn("__sg_number", F.explode(F.sequence(F.col("__sg_first"), F.col("__sg_first") + F.col("__sg_n") - 1))).drop("__sg_first", "__sg_n")
