"""A folder's files as a stream of changes: created, changed, removed.

An offset is the number of a snapshot, a listing of the folder that is written to the ``state``
folder when it differs from the one before. A batch is the difference of two snapshots, so a
query that starts again from its checkpoint goes on where it stopped, sees what happened
meanwhile, and repeats nothing; snapshots that no batch needs any more are removed. Tasks share a
batch by a hash of the paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .vectorfile import open_at

SHARDS = 8


@dataclass
class Between(InputPartition):
    """The changes from one snapshot to another, of one shard of the paths."""

    start: int
    end: int
    shard: int


class SnapshotReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.state, self.shards = options["path"].rstrip("/"), options["state"].rstrip("/"), int(options.get("shards", SHARDS))

    def _snapshots(self) -> list[int]:
        fs, at = open_at(self.state)
        found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".parquet"))

    def _load(self, n: int) -> dict[str, tuple[int, int]]:
        if n < 0:
            return {}
        fs, at = open_at(f"{self.state}/{n:012d}.parquet")
        t = pq.read_table(at, filesystem=fs).to_pydict()
        return dict(zip(t["path"], zip(t["size"], t["mtime"], strict=True), strict=True))

    def _listing(self) -> dict[str, tuple[int, int]]:
        fs, at = open_at(self.root)
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        return {f.path[len(at.rstrip("/")) + 1 :]: (f.size, f.mtime_ns // 1000) for f in found if f.type == pafs.FileType.File}

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def latestOffset(self) -> dict:
        last = max(self._snapshots(), default=-1)
        now = self._listing()
        if now == self._load(last):
            return {"snapshot": last}
        fs, at = open_at(self.state)
        fs.create_dir(at, recursive=True)
        paths = sorted(now)
        rows = pa.table({"path": pa.array(paths, pa.string()), "size": pa.array([now[p][0] for p in paths], pa.int64()), "mtime": pa.array([now[p][1] for p in paths], pa.int64())})
        pq.write_table(rows, f"{at}/.{last + 1:012d}", filesystem=fs)
        fs.move(f"{at}/.{last + 1:012d}", f"{at}/{last + 1:012d}.parquet")
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        return [Between(start["snapshot"], end["snapshot"], i) for i in range(self.shards)] if start != end else []

    def read(self, partition: Between) -> Iterator[tuple]:
        own = lambda n: {p: v for p, v in self._load(n).items() if zlib.crc32(p.encode()) % self.shards == partition.shard}
        old, new = own(partition.start), own(partition.end)
        for path in sorted({*old, *new}):
            if path not in new:
                yield path, "removed", *old[path]
            elif path not in old:
                yield path, "created", *new[path]
            elif old[path] != new[path]:
                yield path, "changed", *new[path]

    def commit(self, end: dict) -> None:
        fs, at = open_at(self.state)
        for n in self._snapshots():
            if n < end["snapshot"]:
                fs.delete_file(f"{at}/{n:012d}.parquet")


class FolderChanges(DataSource):
    """(path, change, size, mtime) of the files below a folder; options ``path``, ``state`` and ``shards``."""

    @classmethod
    def name(cls) -> str:
        return "folderchanges"

    def schema(self) -> str:
        return "path string, change string, size long, mtime long"

    def streamReader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(dict(self.options))


def watch_changes(spark: SparkSession, root: str, state: str, shards: int = SHARDS) -> DataFrame:
    """A stream of (path, change, size, mtime): files of ``root`` created, changed or removed; paths are relative, ``mtime`` is in microseconds.

    ``state`` is a folder of the query's own beside its checkpoint, on a shared file system.
    """
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folderchanges").options(path=root, state=state, shards=str(shards)).load()
