"""Shared plumbing of the operators: shared folders, file access, batches.

Executors of a cluster share no local disk, so everything an operator writes between
jobs goes below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only if none is set and all run on one machine."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = active.get() if active.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="silvergrain-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir if "://" in set_dir or set_dir.startswith("file:") else "file://" + set_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark).rstrip('/')}/silvergrain/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; cuts its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(files: DataFrame, part: str, file: str, value: str, name: str, block: int = 1000) -> DataFrame:
    """``files`` with the sum of ``value`` over all rows before each, by (part, file).

    Blocks of parts are summed first, so no task sorts more than one block or the blocks' sums.
    """
    cut = F.floor(F.col(part) / block).alias("__sg_block")
    sums = files.groupBy(cut).agg(F.sum(value).alias("__sg_sum"))
    before = sums.select("__sg_block", (F.sum("__sg_sum").over(Window.orderBy("__sg_block")) - F.col("__sg_sum")).alias("__sg_before"))
    inside = F.sum(value).over(Window.partitionBy("__sg_block").orderBy(part, file)) - F.col(value)
    return files.withColumn("__sg_block", cut).withColumn(name, inside).join(before, "__sg_block").withColumn(name, F.col(name) + F.col("__sg_before")).drop("__sg_block", "__sg_before")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` for use in a Python worker, and the path inside it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def rechunk(batches: Iterator[pa.RecordBatch], rows: int, column: int | None = None, most: int = 0) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, cut also where ``column`` passes ``most`` bytes."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            if column is None or part.column(column).nbytes <= most:
                yield part
                continue
            sizes = pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(sizes, dtype=np.int64) // most
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield part.slice(a, b - a)
