"""Flat vector files: a fixed header, a scale and an offset a dimension, signed bytes by row."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Rows a task reads, rows it holds at once, and rows of a file that is written.
ROWS, BATCH, FILE_ROWS = 262_144, 4096, 65_536
# Fixed values of the format: magic, the header's length, the code of signed bytes.
MAGIC, HEADER, INT8 = b"PPVEC\x02", 16, 1


def encode_file(vectors: np.ndarray) -> bytes:
    """A file's bytes for a matrix of vectors; each dimension's range is mapped to signed bytes."""
    low, high = vectors.min(0), vectors.max(0)
    scale = np.maximum((high - low) / 254, 1e-12).astype("<f4")
    offset = ((high + low) / 2).astype("<f4")
    q = (vectors - offset) / scale
    codes = np.clip(np.sign(q) * np.floor(np.abs(q) + 0.5), -127, 127).astype(np.int8)
    return MAGIC + struct.pack("<IB5x", vectors.shape[1], INT8) + scale.tobytes() + offset.tobytes() + codes.tobytes()


def header(data: bytes) -> int:
    """The number of dimensions that a file's first bytes tell."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("no vector file")
    dims, kind = struct.unpack_from("<IB", data, len(MAGIC))
    if kind != INT8:
        raise ValueError(f"element type {kind} is not supported")
    return dims


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, offset, codes) of a file's bytes."""
    dims = header(data)
    at = HEADER + 8 * dims
    scale, offset = np.frombuffer(data, "<f4", dims, HEADER), np.frombuffer(data, "<f4", dims, HEADER + 4 * dims)
    rows = (len(data) - at) // dims
    return scale, offset, np.frombuffer(data, np.int8, rows * dims, at).reshape(rows, dims)


@dataclass
class Rows(InputPartition):
    """A range of rows of one file."""

    path: str
    dims: int
    start: int
    stop: int


class RowReader(DataSourceReader):
    """Reads ranges of rows: a task seeks to its first row and reads no other bytes but the header's."""

    def __init__(self, options: dict[str, str]):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of a file, or of a folder's files, as the path was given."""
        fs, at = open_at(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            return [(self.path, info.size)]
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return sorted((f"{self.path.rstrip('/')}/{f.path[len(at.rstrip('/')) + 1:]}", f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))

    def partitions(self) -> list[Rows]:
        out = []
        for path, size in self.files():
            with _opened(path) as f:
                dims = header(f.read(HEADER))
            stop = min((size - HEADER - 8 * dims) // dims, self.last + 1)
            out += [Rows(path, dims, a, min(a + self.rows, stop)) for a in range(max(0, self.first), stop, self.rows)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no row to read
            return
        with _opened(partition.path) as f:
            f.seek(HEADER)
            scale, offset = np.frombuffer(f.read(8 * partition.dims), "<f4").reshape(2, -1)
            f.seek(HEADER + (8 + partition.start) * partition.dims)
            for start in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - start)
                codes = np.frombuffer(f.read(n * partition.dims), np.int8).reshape(n, -1)
                flat = pa.array((codes.astype(np.float32) * scale + offset).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, partition.dims, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(start, start + n)), lists], names=["path", "row", "embedding"])


class PushingRowReader(RowReader):
    """Takes over filters on ``row``; other filters stay with Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("row",) or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.last = min(self.last, value - isinstance(f, LessThan))
            else:
                yield f


class VectorFiles(DataSource):
    """Flat vector files as a source of (path, row, embedding), dequantised."""

    @classmethod
    def name(cls) -> str:
        return "vectorfiles"

    def schema(self) -> str:
        return "path string, row long, embedding array<float>"

    def reader(self, schema: StructType) -> RowReader:
        return (PushingRowReader if self.options.get("push") == "true" else RowReader)(dict(self.options))


def read_vectors(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, rows: int = ROWS) -> DataFrame:
    """(path, row, embedding) of a file or a folder of them; a task reads ``rows`` rows of one file.

    With ``first`` and ``last`` only those rows of each file. Where the session lets Python sources
    take filters over (``spark.sql.python.filterPushdown.enabled``), filters on ``row`` do the same.
    """
    spark.dataSource.register(VectorFiles)
    options = {"path": path, "rows": str(rows), "push": str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()}
    options |= {k: str(v) for k, v in (("first", first), ("last", last)) if v is not None}
    return spark.read.format("vectorfiles").options(**options).load()


def write_vectors(vectors: DataFrame, folder: str, key: str = "vec_id", vec: str = "embedding", rows: int = FILE_ROWS) -> DataFrame:
    """Write flat files of ``rows`` rows at most below ``folder``: (key, path, row), where each vector went.

    A task that runs again writes the same files. Vectors must be of one length, without nulls.
    The result is lazy: the files are there once it has been computed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, made = TaskContext.get().partitionId(), [], 0, 0

        def flushed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            lists = table.column(1).combine_chunks()
            matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), -1)
            path = f"{folder.rstrip('/')}/vectors-{task:06d}-{made:04d}.bin"
            fs, at = open_at(path)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(encode_file(matrix))
            return pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array([path] * len(lists)), pa.array(np.arange(len(lists)))], names=[key, "path", "row"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == rows:
                    yield flushed()
                    held, n, made = [], 0, made + 1
        if n:
            yield flushed()

    return vectors.select(key, vec).mapInArrow(run, f"{key} {vectors.schema[key].dataType.simpleString()}, path string, row long")


def open_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, which may lack a scheme, and the path inside it."""
    return pafs.FileSystem.from_uri(f"file:///{uri.split(':', 1)[-1].lstrip('/')}" if uri.startswith(("file:", "/")) else uri)


@contextmanager
def _opened(path: str) -> Iterator[pa.NativeFile]:
    fs, at = open_at(path)
    with fs.open_input_file(at) as f:
        yield f


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, k, item) of a golden query file: ``{default_k, queries: [{query, relevant, notes}]}``."""
    doc = spark.read.option("multiLine", True).schema("default_k int, queries array<struct<query:string,relevant:array<string>,notes:string>>").json(path)
    return doc.select("default_k", F.explode("queries").alias("q")).select(F.col("q.query").alias("query"), F.col("default_k").alias("k"), F.explode_outer("q.relevant").alias("item"))
