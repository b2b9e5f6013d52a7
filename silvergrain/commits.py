"""A log of commits in a folder: the one place where a table's writers agree what its current state is.

Each commit is a small JSON document under its number. A writer puts its data files where nobody
looks, then its document under a name of its own, and renames that to the next number: the rename
fails if the number is taken, so of several writers one wins and the others start again from
what it wrote. What no commit names does not exist for readers, whatever a crash left behind.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

WIDTH = 12


class CommitConflict(RuntimeError):
    """Another writer took the number."""


class CommitLog:
    """Numbered JSON documents below ``folder``, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._dir = self._path(f"{self.folder}/_commits")
        self._fs = self._dir.getFileSystem(self._conf)
        self._fs.mkdirs(self._dir)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._dir)]
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """The last commit's number, -1 if there is none."""
        return max(self.numbers(), default=-1)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/_commits/{number:0{WIDTH}d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def head(self) -> dict:
        """The last commit's document, empty if there is none."""
        n = self.latest()
        return self.read(n) if n >= 0 else {}

    def commit(self, number: int, document: dict) -> None:
        """Put ``document`` under ``number``; raises CommitConflict if that is taken."""
        own = self._path(f"{self.folder}/_commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, True)
        try:
            stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        finally:
            stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._dir.toUri(), self._conf).rename(own, self._path(f"{self.folder}/_commits/{number:0{WIDTH}d}"), never_over)
        except Exception as taken:
            self._fs.delete(own, False)
            if number in self.numbers():
                raise CommitConflict(f"commit {number} of {self.folder} exists") from taken
            raise

    def forget(self, before: int) -> None:
        """Remove the documents of commits before ``before``."""
        for n in self.numbers():
            if n < before:
                self._fs.delete(self._path(f"{self.folder}/_commits/{n:0{WIDTH}d}"), False)

    def new_data(self, name: str) -> str:
        """A new path for data files below the folder."""
        return f"{self.folder}/data/{name}-{uuid.uuid4().hex}"

    def data_folders(self) -> list[str]:
        at = self._path(f"{self.folder}/data")
        return sorted(f"{self.folder}/data/{s.getPath().getName()}" for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def remove(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)
