"""Portable JSON documents: one per image, with its events; collections and topics.

Documents are written as one JSON line each, under a folder per image prefix, by Spark's
commit protocol: a reader never sees half a write. Members that this version doesn't know
are kept as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import JOURNAL
from ..operators.journal import effective_targets

VERSION = 1
EVENT = "struct<" + ", ".join(f"{f.strip().split(' ')[0]}:{f.strip().split(' ')[1]}" for f in JOURNAL.split(",")) + ">"


def documents(journal: DataFrame) -> DataFrame:
    """(image, shard, json): a document per image with its content events and the meta events that reach it, by id.

    A document is as long as its image's journal, which people write by hand.
    """
    content = journal.where(F.col("image").isNotNull())
    through = journal.where(F.col("image").isNull()).join(effective_targets(journal).select("id", F.col("image").alias("owner")), "id")
    rows = content.withColumn("owner", F.col("image")).unionByName(through)
    event = F.struct(*journal.columns)
    docs = rows.groupBy("owner").agg(F.array_sort(F.collect_list(event)).alias("events"))
    return docs.select(F.col("owner").alias("image"), F.pmod("owner", F.lit(256)).cast("int").alias("shard"), F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("owner").alias("image"), "events")).alias("json"))


def export(journal: DataFrame, folder: str) -> DataFrame:
    """Write the documents and a manifest (image, events, digest); returns the manifest."""
    docs = documents(journal)
    docs.select("shard", F.col("json").alias("value")).write.mode("overwrite").partitionBy("shard").text(f"{folder}/documents")
    manifest = docs.select("image", F.size(F.from_json("json", f"events array<{EVENT}>")["events"]).alias("events"), F.sha2("json", 256).alias("digest"))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return journal.sparkSession.read.schema("image long, events int, digest string").json(f"{folder}/manifest")


def parse(spark: SparkSession, folder: str) -> DataFrame:
    """(json, version, image, events, bad): documents of a folder; ``bad`` ones are no JSON or of a newer version, and kept whole."""
    raw = spark.read.text(f"{folder}/documents").select(F.col("value").alias("json"))
    doc = F.from_json("json", f"version int, image long, events array<{EVENT}>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    return raw.withColumn("d", doc).select("json", "d.version", "d.image", "d.events", (F.col("d._corrupt").isNotNull() | F.col("d.version").isNull() | (F.col("d.version") > VERSION)).alias("bad"))


def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The journal of a folder of documents: a set of events by id."""
    found = parse(spark, folder).where("NOT bad").select(F.explode("events").alias("e")).select("e.*")
    return found.dropDuplicates(["id"])


def unknown_members(doc: str = "json", known: tuple[str, ...] = ("version", "image", "events")):
    """The members of a document that this version doesn't know, as a map of JSON texts."""
    return F.map_filter(F.from_json(F.col(doc), "map<string,string>"), lambda k, v: ~k.isin(*known))


def export_rows(rows: DataFrame, folder: str) -> None:
    """Collections, topics or any rows as JSON lines."""
    rows.write.mode("overwrite").json(folder)


def import_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of ``export_rows`` or another writer; lines that don't fit come with their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(folder)
