"""From raw documents to token ids, in stages that each write a table.

Quality rules, near-duplicate removal by n-gram Jaccard, mixing of sources to equal shares,
SentencePiece encoding with a decoding check. Every stage works on all rows that its
predecessor kept.

Edge cases: null and empty texts fail the quality rules and go; rows without an id are linked with
nothing and stay; of rows that repeat an id and a set of shingles one stays, rows that share an id
but not a set are judged apart; rows without a source are a source of their own; texts of any
length stay whole; an empty table gives empty tables; other columns pass through the stages,
whatever their names, but for the last, which returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.llm import jaccard, mixing, pieces, quality
from silvergrain.llm.registry import MIX_SEED, vocabulary
from silvergrain.llm.runtime import written

#: So many ids of removed documents at most are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, and one of rows that repeat it; rows without an id stay."""
    found = jaccard.jaccard_join(docs, set_name="__sg_set")
    removed = written(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "removed")
    again = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        return _without(docs, removed).select(docs.columns)
    # an id of several rows goes or stays by the set of each
    of_set = F.coalesce(F.hex("__sg_set"), F.lit(""))
    stay = found.where(F.col("doc_id") == F.col("component_id")).join(again, "doc_id", "left_semi").select("doc_id", of_set.alias("__sg_set")).distinct()
    rows = docs.join(again, "doc_id", "left_semi").withColumn("__sg_set", jaccard.set_digest(F.col("text"))).withColumn("__sg_set", of_set)
    kept = rows.join(stay, ["doc_id", "__sg_set"], "left_semi").withColumn("__sg_text", F.when(F.col("__sg_set") == "", F.col("text")))
    once = kept.dropDuplicates(["doc_id", "__sg_set", "__sg_text"])
    return _without(docs, removed.union(again).distinct()).select(docs.columns).unionByName(once.select(docs.columns))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that all sources have equal shares of the characters, shuffled."""
    return mixing.replicate(docs, seed=MIX_SEED, copy_name="__sg_copy", order_name="__sg_order").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and whether they decode to the text."""
    coded = pieces.encode_documents(docs, vocabulary("piece_bpe_32k.model"), decoded_name="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express SentencePiece; the tests compare the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
