"""A feed of changes with retention: consumers ask for what is new since their cursor, or start over.

Changes are numbered in one row of revisions and kept in layers, one a publication. Beyond
``retention`` revisions the oldest layers go, and the low-water mark says up to where. A consumer's
cursor is committed under its name; a cursor below the mark can't be served by changes any more,
so that consumer is told to reset and gets the table as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import CommitLog
from .catalog import delta
from .journal import dense_number

RETENTION = 100_000


@dataclass(frozen=True)
class Changes:
    """What a consumer is given: (key, change) to apply, whether to start over, and the cursor to acknowledge."""

    rows: DataFrame
    reset: bool
    head: int


class ChangeFeed:
    def __init__(self, spark: SparkSession, folder: str, key: str, retention: int = RETENTION):
        self.spark, self.folder, self.key, self.retention = spark, folder.rstrip("/"), key, retention
        self.log = CommitLog(spark, self.folder)

    def state(self) -> dict:
        return self.log.head() or {"head": 0, "low": 0, "layers": []}

    def publish(self, changed: DataFrame, order: str) -> int:
        """Append a revision for every row of ``changed`` (key, order), in the order of ``order``; the new head."""
        n, s = self.log.latest(), self.state()
        data = self.log.new_data("layer")
        numbered = dense_number(changed.select(self.key, order), order, "revision")
        numbered.select((F.col("revision") + s["head"] + 1).alias("revision"), self.key).write.parquet(data)
        head = s["head"] + self.spark.read.parquet(data).count()
        low = max(s["low"], head - self.retention)
        layers = [x for x in [*s["layers"], {"to": head, "data": data}] if x["to"] > low]
        self.log.commit(n + 1, {"head": head, "low": low, "layers": layers, "type": changed.schema[self.key].dataType.simpleString()})
        for x in s["layers"]:
            if x not in layers:
                self.log.remove(x["data"])
        return head

    def changes(self) -> DataFrame:
        """(revision, key) that are kept."""
        s = self.state()
        kind = f"revision long, {self.key} {s.get('type', 'long')}"
        rows = self.spark.read.schema(kind).parquet(*[x["data"] for x in s["layers"]]) if s["layers"] else self.spark.createDataFrame([], kind)
        return rows.where(F.col("revision") > s["low"])

    def _cursors(self, consumer: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/consumers/{consumer}")

    def cursor(self, consumer: str) -> int | None:
        return self._cursors(consumer).head().get("revision")

    def poll(self, consumer: str, table: DataFrame) -> Changes:
        """What ``consumer`` lacks of ``table``: each changed key once, ``upsert`` if the table has it and ``removed`` else."""
        s, at = self.state(), self.cursor(consumer)
        if at is None or at < s["low"] or at > s["head"]:
            return Changes(table.select(self.key, F.lit("upsert").alias("change")), True, s["head"])
        found, _ = delta(self.changes().withColumnRenamed(self.key, "image"), table.select(F.col(self.key).alias("image")), at, s["head"], s["low"])
        return Changes(found.withColumnRenamed("image", self.key), False, s["head"])

    def acknowledge(self, consumer: str, given: Changes) -> None:
        """The consumer has what it was given; what it had acknowledged before and is given again changes nothing."""
        log = self._cursors(consumer)
        before = log.head().get("revision")
        if before is None or given.head > before or before > self.state()["head"]:
            log.commit(log.latest() + 1, {"revision": given.head})
            log.forget(log.latest())
