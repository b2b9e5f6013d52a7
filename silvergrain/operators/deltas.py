"""Counters kept up by signed changes instead of recomputing them.

A change of a table is a set of rows with a weight: -1 for a row that is no longer there, +1 for
one that is new. Counts and sums of a table change by the weighted counts and sums of its change,
so a batch costs its own size and that of the counters it touches. Whether a row counts at all
(eligibility) is a join, and the change of a join follows from the changes of its sides. A
greatest value can't be taken back: where a removed row held it, the keys concerned are computed
again from the table, and no others.

``CounterTable`` holds the counters in versions. A version is written whole beside the last one and
committed under the next number together with the token of its batch; a batch that comes again
under the same token, as after a restart, changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..commits import CommitLog
from ..model import CONTENT_KINDS

WEIGHT = "weight"


def consolidated(changes: DataFrame) -> DataFrame:
    """``changes`` with equal rows added up and those that cancel out left out."""
    columns = [c for c in changes.columns if c != WEIGHT]
    return changes.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change that takes the rows ``old`` out and puts the rows ``new`` in."""
    return consolidated(old.withColumn(WEIGHT, F.lit(-1).cast("long")).unionByName(new.withColumn(WEIGHT, F.lit(1).cast("long"))))


def applied(table: DataFrame, change: DataFrame) -> DataFrame:
    """``table`` (a row once or several times) after ``change``."""
    left = consolidated(table.withColumn(WEIGHT, F.lit(1).cast("long")).unionByName(change))
    return left.withColumn(WEIGHT, F.explode(F.sequence(F.lit(1), F.greatest(F.col(WEIGHT), F.lit(1)).cast("int")))).drop(WEIGHT)


def latest(old: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table after, change): of ``old`` and ``new`` rows the last by ``order`` of each key stays."""
    won = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    arriving = won(new)
    touched = old.join(arriving.select(*key), list(key), "left_semi")
    after = won(touched.unionByName(arriving.select(old.columns)))
    kept = old.join(arriving.select(*key), list(key), "left_anti")
    return kept.unionByName(after), replaced(touched, after)


def eligible(paths: DataFrame, roots: DataFrame | None = None, key: str = "image") -> DataFrame:
    """(key) that an active path reaches, in an active root if the path has one."""
    active = paths.where("state = 'active'")
    if roots is not None:
        up = roots.where("state = 'active'").select("root")
        active = active.where("root IS NULL").select(key).union(active.join(up, "root", "left_semi").select(key))
    return active.select(key).distinct()


def eligibility_change(before: DataFrame, after: DataFrame, touched: DataFrame, roots_before: DataFrame | None = None, roots_after: DataFrame | None = None, key: str = "image") -> DataFrame:
    """(key, weight) of keys that became eligible or stopped to be; only ``touched`` keys are looked at.

    A root whose state changes touches the keys of all its paths.
    """
    near = touched.select(key).distinct()
    if roots_before is not None and roots_after is not None:
        flipped = replaced(roots_before.select("root", "state"), roots_after.select("root", "state")).select("root").distinct()
        near = near.union(before.unionByName(after).join(flipped, "root", "left_semi").select(key)).distinct()
    was, now = (eligible(p.join(near, key, "left_semi"), r, key) for p, r in ((before, roots_before), (after, roots_after)))
    return replaced(was, now)


def eligible_change(rows_before: DataFrame, row_change: DataFrame, eligible_after: DataFrame, eligibility: DataFrame, key: str = "image") -> DataFrame:
    """The change of the rows that count: changed rows of keys that count now, and all former rows of keys that began or ceased to."""
    own = row_change.join(eligible_after, key, "left_semi")
    fanned = rows_before.join(eligibility, key).select(*rows_before.columns, WEIGHT)
    return consolidated(own.unionByName(fanned))


def counted(change: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """(by, name): how much each counter changes."""
    return change.groupBy(*by).agg(F.sum(WEIGHT).alias(name)).where(F.col(name) != 0)


class CounterTable:
    """Counters by key in a folder, in committed versions."""

    def __init__(self, spark: SparkSession, folder: str, by: Sequence[str], counters: Sequence[str] = ("n",), others: Sequence[str] = ()):
        self.log, self.by, self.counters, self.others = CommitLog(spark, folder), list(by), list(counters), list(others)
        self.spark = spark

    def read(self, number: int | None = None) -> DataFrame | None:
        """The counters of a version, the last by default; None if there is none yet."""
        n = self.log.latest() if number is None else number
        if n < 0:
            return None
        at = self.log.read(n)
        return self.spark.read.schema(StructType.fromJson(at["schema"])).parquet(at["data"])

    def merge(self, change: DataFrame, token: str, recomputed: DataFrame | None = None) -> int:
        """Add ``change`` to the counters as the batch ``token``; the version's number.

        Keys whose counters are all zero leave the table; a counter below zero is an error of the
        caller and raises. ``others`` come from ``recomputed`` (by, others) where it has the key, else
        the greater of the old and the changed value stays.
        """
        n = self.log.latest()
        if n >= 0 and token in self.log.read(n)["tokens"]:
            return n
        columns = [*self.by, *self.counters, *self.others]
        rows = change.select(columns)
        old = self.read(n) if n >= 0 else None
        both = rows if old is None else old.select(columns).unionByName(rows)
        merged = both.groupBy(*self.by).agg(*[F.sum(c).cast("long").alias(c) for c in self.counters], *[F.max(c).alias(c) for c in self.others])
        if recomputed is not None:
            again = recomputed.select(*self.by, *[F.col(c).alias(f"__{c}") for c in self.others], F.lit(True).alias("__again"))
            merged = merged.join(again, self.by, "left").select(*self.by, *self.counters, *[F.when(F.col("__again"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in self.others])
        below = F.lit(False)
        some = F.lit(False)
        for c in self.counters:
            below, some = below | (F.col(c) < 0), some | (F.col(c) != 0)
        checked = merged.where(some).withColumn(self.counters[0], F.when(below, F.raise_error(F.lit("a counter fell below zero")).cast("long")).otherwise(F.col(self.counters[0])))
        data = self.log.new_data("counters")
        checked.write.parquet(data)
        tokens = (self.log.read(n)["tokens"] if n >= 0 else []) + [token]
        self.log.commit(n + 1, {"data": data, "schema": checked.schema.jsonValue(), "tokens": tokens[-100:]})
        return n + 1


def journal_changes(before: DataFrame, batch: DataFrame) -> DataFrame:
    """The change of live content events when ``batch`` is added to the journal ``before``.

    Retractions take out what they name, if it was live; events that came after their retraction
    never come in.
    """
    named = lambda j: j.where("kind = 'retraction' AND target_event IS NOT NULL").select(F.col("target_event").alias("id")).distinct()
    content = lambda j: j.where(F.col("kind").isin(*CONTENT_KINDS) & F.col("image").isNotNull())
    new = content(batch).join(named(batch), "id", "left_anti").join(named(before), "id", "left_anti")
    gone = content(before).join(named(batch), "id", "left_semi").join(named(before), "id", "left_anti")
    return new.withColumn(WEIGHT, F.lit(1).cast("long")).unionByName(gone.withColumn(WEIGHT, F.lit(-1).cast("long")))


def stats_change(change: DataFrame) -> DataFrame:
    """(image, events, remarks, strokes, last): by how much the statistics of images change; ``last`` is the greatest (id, ts) that came in."""
    clean = ~F.col("scrubbed")
    of = lambda kind: F.sum(F.when((F.col("kind") == kind) & clean, F.col(WEIGHT)).otherwise(0))
    return change.groupBy("image").agg(F.sum(WEIGHT).alias("events"), of("remark").alias("remarks"), of("stroke").alias("strokes"), F.max(F.when(F.col(WEIGHT) > 0, F.struct("id", "ts"))).alias("last"))


def update_image_stats(stats: CounterTable, before: DataFrame, batch: DataFrame, token: str) -> int:
    """Bring a table of image statistics from the journal ``before`` to that with ``batch``."""
    change = journal_changes(before, batch)
    delta = stats_change(change)
    old = stats.read()
    again = None
    if old is not None:
        gone = change.where(F.col(WEIGHT) < 0).select("image", F.col("id").alias("gone"))
        lost = gone.join(old.select("image", "last"), "image").where(F.col("gone") == F.col("last.id")).select("image").distinct()
        # what is left of the touched images only; an event leaves it if a retraction of either journal names it
        named = before.unionByName(batch).where("kind = 'retraction' AND target_event IS NOT NULL").select(F.col("target_event").alias("id"))
        left = before.unionByName(batch).where(F.col("kind").isin(*CONTENT_KINDS)).join(lost, "image", "left_semi").join(named, "id", "left_anti")
        again = left.groupBy("image").agg(F.max(F.struct("id", "ts")).alias("last"))
    return stats.merge(delta, token, again)
