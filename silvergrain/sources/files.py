"""Archive files: listings, classes, content hashes, foreign edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import excluded, file_class
from ..operators.temporal import micros

#: Bytes of a file that are held at once while it is hashed.
PIECE = 8 << 20


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(rel_path, size, mtime, kind) of a root's files of known types; with ``content`` also their bytes' SHA-256.

    The listing reads no contents: columns that are not asked for are pruned before the files
    are opened. Files without a byte are not listed.
    """
    out = _listed(spark, root)
    return _hashed(out).drop("path") if content else out.drop("path")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, size, mtime, kind), from file states alone."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rows = raw.withColumn("rel_path", F.substring(rel, len(prefix) + 1, 1 << 30))
    out = rows.select("path", "rel_path", F.col("length").alias("size"), micros("modificationTime").alias("mtime"), file_class(F.col("rel_path")).alias("kind"))
    return out.where(F.col("kind").isNotNull() & ~excluded(F.col("rel_path")))


def _hashed(listed: DataFrame) -> DataFrame:
    """Adds ``hash``, the SHA-256 of each file's bytes; reads files of any length in pieces. Files gone since the listing go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes = [], []
            for i, path in enumerate(batch.column("path").to_pylist()):
                scheme, _, rest = path.partition(":")
                fs, at = pafs.FileSystem.from_uri(quote(f"file:///{rest.lstrip('/')}" if scheme == "file" else path, safe=":/@"))
                sha = hashlib.sha256()
                try:
                    with fs.open_input_stream(at, buffer_size=0) as f:
                        while piece := f.read(PIECE):
                            sha.update(piece)
                except FileNotFoundError:
                    continue
                found.append(i)
                hashes.append(sha.hexdigest())
            kept = batch.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hashes, pa.string())], names=[*batch.schema.names, "hash"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema)
    return listed.mapInArrow(run, f"{kinds}, hash string")


def hash_changed(spark: SparkSession, root: str, stored: DataFrame) -> DataFrame:
    """(rel_path, size, mtime, hash) of all listed files; only those whose size or time differ from ``stored`` are read."""
    known = stored.select("rel_path", F.col("size").alias("os"), F.col("mtime").alias("om"), F.col("hash").alias("known"))
    listed = _listed(spark, root).join(known, "rel_path", "left").withColumn("same", F.coalesce(F.expr("size = os AND mtime = om AND known IS NOT NULL"), F.lit(False)))
    same = listed.where("same").select("rel_path", "size", "mtime", F.col("known").alias("hash"))
    fresh = _hashed(listed.where("NOT same").select("path", "rel_path", "size", "mtime")).drop("path")
    return same.unionByName(fresh)


def watch(spark: SparkSession, root: str) -> DataFrame:
    """New files of a root as a stream (path, modificationTime, length)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")


def foreign_edits(xmp: Column) -> Column:
    """What another editor's XMP document says: struct(rating, cropped, label, orientation, crop, unreadable), null where it says nothing.

    Values stand in attributes or elements. A rating of -1 rejects; an orientation is 1 to 8; a crop
    (top, left, bottom, right as fractions, and an angle that may be null) counts if it is switched on and
    all four sides are finite numbers. Edits in an editor's own history can be seen, not read, and its crop with them.
    """
    def read(name: str) -> Column:
        attribute = F.regexp_extract(xmp, rf'(?<=[\w-]):{name}\s*=\s*"([^"]*)"', 1)
        element = F.regexp_extract(xmp, rf"<[\w-]+:{name}\s*>\s*([^<]*?)\s*</", 1)
        return F.when(attribute != "", attribute).when(element != "", element)

    sides_of = {n.lower(): f"Crop{n}" for n in ("Top", "Left", "Bottom", "Right")}
    names = ["Rating", "Orientation", "HasCrop", "Label", *sides_of.values(), "CropAngle"]
    # bound by a lambda, so each value is sought once however often it is used
    said = F.array(F.struct(*(read(n).alias(n) for n in names), F.coalesce(xmp.contains("darktable:operation"), F.lit(False)).alias("unreadable"), xmp.contains("darktable:").alias("foreign")))
    return F.element_at(F.transform(said, lambda v: _edits(v, sides_of)), 1)


def _edits(said: Column, sides_of: dict[str, str]) -> Column:
    """``foreign_edits`` of the values that stand in a document."""
    value = said.getField

    def fraction(name: str) -> Column:
        x = F.trim(value(name)).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    rating, orientation = value("Rating").try_cast("int"), F.trim(value("Orientation")).try_cast("int")
    flag = F.lower(F.trim(value("HasCrop")))
    cropped = flag.isin("true", "1")
    label = F.trim(value("Label"))
    unreadable = value("unreadable")
    sides = {k: fraction(n) for k, n in sides_of.items()}
    whole = cropped & ~value("foreign")
    for side in sides.values():
        whole = whole & side.isNotNull()
    crop = F.when(whole, F.struct(*(v.alias(k) for k, v in sides.items()), fraction("CropAngle").alias("angle")))
    says = rating.isNotNull() | flag.isNotNull() | F.coalesce(label != "", F.lit(False)) | orientation.between(1, 8) | unreadable
    return F.when(says, F.struct(
        F.when(rating.between(-1, 5), rating).alias("rating"), F.coalesce(cropped, F.lit(False)).alias("cropped"), F.when(label != "", label).alias("label"),
        F.when(orientation.between(1, 8), orientation).alias("orientation"), crop.alias("crop"), unreadable.alias("unreadable"),
    ))
