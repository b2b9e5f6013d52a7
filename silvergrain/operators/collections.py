"""Collections: evented membership and last-writer-wins merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_members(members: DataFrame) -> DataFrame:
    """(collection, image) of open intervals."""
    return members.where(F.col("removed_ts").isNull()).select("collection", "image").distinct()


def summaries(collections: DataFrame, members: DataFrame, notes: DataFrame) -> DataFrame:
    """Collections with their numbers of current members and notes."""
    m = current_members(members).groupBy("collection").agg(F.count(F.lit(1)).alias("members"))
    n = notes.groupBy("collection").agg(F.count(F.lit(1)).alias("notes"))
    return collections.join(m, "collection", "left").join(n, "collection", "left").na.fill(0, ["members", "notes"])


def add_members(members: DataFrame, added: DataFrame, now: Column) -> DataFrame:
    """New intervals for (collection, image) without an open one; a re-add starts after the last one began."""
    opened = members.where("removed_ts IS NULL").select("collection", "image")
    last = members.groupBy("collection", "image").agg(F.max("added_ts").alias("last"))
    fresh = added.select("collection", "image").distinct().join(opened, ["collection", "image"], "left_anti").join(last, ["collection", "image"], "left")
    start = F.greatest(now, F.col("last") + F.expr("INTERVAL 0.001 SECOND"))
    return members.unionByName(fresh.select("collection", "image", start.alias("added_ts"), F.lit(None).cast(members.schema["removed_ts"].dataType).alias("removed_ts")))


def remove_members(members: DataFrame, removed: DataFrame, now: Column) -> DataFrame:
    """Open intervals of (collection, image) end now, or when they began if that is later."""
    gone = removed.select("collection", "image").distinct().withColumn("__gone", F.lit(True))
    end = F.when(F.col("removed_ts").isNull() & F.col("__gone"), F.greatest(now, F.col("added_ts"))).otherwise(F.col("removed_ts"))
    return members.join(gone, ["collection", "image"], "left").withColumn("removed_ts", end).drop("__gone").select(members.columns)


def merge_collections(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(collection, name, description, status, created_ts, updated_ts): the latest update wins, of equals the least; the earliest creation."""
    both = ours.unionByName(theirs)
    latest = both.groupBy("collection").agg(F.max("updated_ts").alias("updated_ts"), F.min("created_ts").alias("created_ts"))
    win = both.drop("created_ts").join(latest, ["collection", "updated_ts"]).groupBy("collection", "updated_ts", "created_ts").agg(F.min(F.struct("name", "description", "status")).alias("w"))
    return win.select("collection", "w.name", "w.description", "w.status", "created_ts", "updated_ts")


def merge_notes(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes (collection, note, ts, text), losers): equal ids keep the least (ts, text); others are reported."""
    both = ours.unionByName(theirs).distinct()
    kept = both.groupBy("collection", "note").agg(F.min(F.struct("ts", "text")).alias("k")).select("collection", "note", "k.ts", "k.text")
    return kept, both.join(kept, ["collection", "note", "ts", "text"], "left_anti")


def merge_members(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Intervals by (collection, image, added_ts): any removal beats none, the earlier beats the later."""
    return ours.unionByName(theirs).groupBy("collection", "image", "added_ts").agg(F.min("removed_ts").alias("removed_ts"))


def scope(library: DataFrame, members: DataFrame | None = None, collection: object = None, folder: str | None = None, images: DataFrame | None = None) -> DataFrame:
    """(image): a collection, a folder's subtree, listed images that exist, or the whole library."""
    known = library.select("image").distinct()
    if collection is not None and members is not None:
        return known.join(current_members(members).where(F.col("collection") == collection), "image", "left_semi")
    if folder is not None:
        prefix = folder.strip("/") + "/"
        return library.where(F.col("active") & F.col("rel_path").startswith(prefix)).select("image").distinct()
    if images is not None:
        return known.join(images.select("image"), "image", "left_semi")
    return known
