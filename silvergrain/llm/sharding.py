"""Placement of rows on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. The
shards take turns; in its turn a shard claims the first free slot of its order. The filled
table (a few bytes a slot, whatever the data) is broadcast, and a row's shard is the owner
of the slot its key hashes to: one hash and one lookup. Slots are spread evenly, and adding
or removing a shard moves few slots besides those it gains or loses.

``shard_rows`` places whole rows and sends each to its shard: rows of a shard lie together, a
shard far larger than others (one key on a third of all rows) in several pieces.

Edge cases: a null key hashes like the string of no characters and so has a shard; equal
keys share a shard; an empty table stays empty; other columns pass through; one
that bears an output's name gives way, which ``slot_name`` and ``shard_name`` can avoid.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import hash_bits

#: A prime; a hundred slots and more for each of up to 655 shards keep shares within a few per cent.
TABLE_SIZE = 65537
#: The broadcast table has so many slots at most: 16 MB.
LARGEST_TABLE = 1_000_003


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None) -> list[int]:
    """The index of the owning shard for every slot.

    ``weights`` gives a shard so many turns a round; 1 each by default.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _prime(size) or not len(shards) <= size <= LARGEST_TABLE:
        raise ValueError(f"the table's size must be a prime from the number of shards to {LARGEST_TABLE}")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 0 or not any(turns):
        raise ValueError("weights must not be negative, and one must be positive")
    at, step = [], []
    for s in shards:
        digest = hashlib.sha256(s.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner, free = [-1] * size, size
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                owner[at[i]] = i
                free -= 1
                if not free:
                    return owner


def table_frame(spark: SparkSession, owner: Sequence[int], shards: Sequence[str]) -> DataFrame:
    """The table as rows (slot, shard)."""
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    rows = spark.range(1).select(names.alias("names"), F.posexplode(F.from_json(F.lit(json.dumps(list(owner))), "array<int>")).alias("slot", "i"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at("names", F.col("i") + 1).alias("shard"))


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``rows`` with the slot and the shard of each."""
    table = table_frame(rows.sparkSession, fill_table(shards, size, weights), shards)
    table = table.select(F.col("slot").alias("__sg_slot"), F.col("shard").alias(shard_name))
    slot = F.pmod(hash_bits(F.col(key)), F.lit(size))
    return rows.drop(shard_name).withColumn(slot_name, slot).join(F.broadcast(table), F.col(slot_name) == F.col("__sg_slot"), "left").drop("__sg_slot")


def shard_rows(rows: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Mapping[str, int] | None = None, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``rows`` placed, and moved so that a partition holds rows of one shard or of few; write with ``partitionBy(shard)``."""
    return place(rows, key, shards, size, weights, slot_name, shard_name).hint("rebalance", shard_name)


def shard_totals(placed: DataFrame, size: str, shard_name: str = "shard") -> DataFrame:
    """Rows and summed ``size`` (null: 0) of every shard that has rows; a row a shard."""
    return placed.groupBy(shard_name).agg(F.count(F.lit(1)).alias("shard_rows"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("shard_size"))
