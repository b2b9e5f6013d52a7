"""Connected components of links by alternating large and small stars.

Each round points every node's greater neighbours, then its smaller ones, at the least node
near it; links shrink to stars in few rounds whatever the shape of the graph. A node with
very many links is one row a task after partial aggregation, and its join can be split.
Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

#: Rounds grow with the logarithm of the graph; this is far beyond any.
MOST_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b), a < b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
    smaller = both.where("v < u")
    least = smaller.groupBy("u").agg(F.min("v").alias("m"))
    return smaller.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its least node.

    ``links`` has the columns a and b, numbers or structs of them; null ends, loops and repeated
    links are no links.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("k"))
    now = written(pairs.where("k").drop("k").where("a <> b").distinct(), "links")
    said = None
    for _ in range(MOST_ROUNDS):
        now = written(_star(_star(now, True), False), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(state) == said:
            break
        said = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component")))
