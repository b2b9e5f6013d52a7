"""Which name of a list somebody meant: the nearest by Jaro-Winkler similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..model import TUNING

#: The order of a collection's states when names are equally near.
STATUS_ORDER = {"active": 0, "shelved": 1}
DIGITS = 9
PREFIX = 4


def greatest_similarity(shared: Column, a: Column, b: Column, prefix: Column) -> Column:
    """An upper bound of Jaro-Winkler from the letters two names of lengths a and b share and their common prefix."""
    jaro = F.when(shared > 0, (shared / a + shared / b + 1) / 3).otherwise(0.0)
    return F.when(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro)).otherwise(jaro)


def near_names(asked: DataFrame, names: DataFrame, threshold: float = TUNING.name_threshold) -> DataFrame:
    """(asked, name, score) of distinct names at least that similar.

    Names meet by the letters they hold (the second of a letter is another than the first), which
    counts what they share; only pairs that may reach the threshold by that and their lengths and prefixes
    are scored.
    """
    def letters(rows: DataFrame, c: str) -> DataFrame:
        each = rows.select(c, F.explode(F.split(c, "")).alias("letter")).where("letter <> ''")
        return each.groupBy(c, "letter").agg(F.count(F.lit(1)).alias("n")).select(c, "letter", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))

    a, n = asked.select("asked").where("asked <> ''").distinct(), names.select("name").where("name <> ''").distinct()
    shared = letters(a, "asked").join(letters(n, "name"), ["letter", "nth"]).groupBy("asked", "name").agg(F.count(F.lit(1)).alias("shared"))
    prefix = F.lit(0)
    for k in range(PREFIX, 0, -1):
        prefix = F.when((F.substring("asked", 1, k) == F.substring("name", 1, k)) & (F.length("asked") >= k) & (F.length("name") >= k), F.greatest(prefix, F.lit(k))).otherwise(prefix)
    bound = greatest_similarity(F.col("shared"), F.length("asked"), F.length("name"), prefix)
    some = shared.where(bound >= threshold - 1e-9)
    return some.select("asked", "name", F.round(similarity.jaro_winkler_column(F.col("asked"), F.col("name")), DIGITS).alias("score")).where(F.col("score") >= threshold)


def resolve(asked: DataFrame, names: DataFrame, ask: str = "asked", threshold: float = TUNING.name_threshold) -> DataFrame:
    """``asked`` with (id, name, score) of the name meant, null where none is near enough.

    ``names``: (id, name, status, updated_ts). White space and case don't count. Ties go to active, then
    shelved, then other names, then to the last updated, then to the least id.
    """
    wanted = asked.withColumn("__a", text.collapsed(F.col(ask)))
    known = names.select("id", text.collapsed(F.col("name")).alias("name"), F.coalesce(*(F.when(F.col("status") == s, r) for s, r in STATUS_ORDER.items()), F.lit(2)).alias("rank"), "updated_ts")
    # of equal names one can win only
    of_name = W.partitionBy("name").orderBy("rank", F.col("updated_ts").desc_nulls_last(), "id")
    first = known.withColumn("r", F.row_number().over(of_name)).where("r = 1").drop("r")
    near = near_names(wanted.select(F.col("__a").alias("asked")), first, threshold).join(first, "name")
    of_asked = W.partitionBy("asked").orderBy(F.desc("score"), "rank", F.col("updated_ts").desc_nulls_last(), "id")
    best = near.withColumn("r", F.row_number().over(of_asked)).where("r = 1").select(F.col("asked").alias("__a"), "id", "name", "score")
    return wanted.join(best, "__a", "left").drop("__a")
