"""A table of vectors in immutable segments, which takes upserts and deletes and forgets for good.

Rows lie in segments, folders of Parquet that are never written again; a row's place in its segment
is a number. Rows that were replaced or deleted are named by tombstones (segment, place). What
is current is a manifest: the list of segments with their rows and dead rows, and the folders of
tombstones. Each step writes its files first and then commits the next manifest at once, so a
crash leaves the last manifest and some files that nobody reads. Compaction rewrites segments that
hold too many dead rows; ``scrub`` rewrites all that ever held given keys and removes the old
files, so that their bytes are gone. A writer that loses the race for the next manifest tries again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..commits import CommitConflict, CommitLog

#: A segment is rewritten when more than this share or number of its rows is dead.
DEAD_SHARE, DEAD_ROWS = 0.2, 10_000
TRIES = 8
SEGMENT, PLACE = "__segment", "__place"


class SegmentStore:
    """Rows by key in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: str = "vec_id", compression: str = "zstd"):
        self.spark, self.key, self.compression = spark, key, compression
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.log = CommitLog(spark, folder)

    # ------------------------------------------------------------ reading

    def manifest(self) -> dict:
        return self.log.head() or {"segments": {}, "tombs": [], "generation": 0}

    def read(self) -> DataFrame:
        """The current rows."""
        return self._live(self.manifest()).select(self.schema.names)

    def _placed(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema).withColumns({PLACE: F.lit(0).cast("long"), SEGMENT: F.lit("")})
        stored = StructType([*self.schema.fields]).add(PLACE, "long")
        rows = self.spark.read.schema(stored).parquet(*[f"{self.log.folder}/data/{n}" for n in names])
        return rows.select("*", F.regexp_extract("_metadata.file_path", "/data/([^/]+)/", 1).alias(SEGMENT))

    def _tombs(self, m: dict) -> DataFrame:
        if not m["tombs"]:
            return self.spark.createDataFrame([], f"{SEGMENT} string, {PLACE} long")
        return self.spark.read.schema(f"{SEGMENT} string, {PLACE} long").parquet(*[f"{self.log.folder}/data/{t}" for t in m["tombs"]])

    def _live(self, m: dict, names: list[str] | None = None) -> DataFrame:
        rows = self._placed(sorted(m["segments"]) if names is None else names)
        return rows.join(self._tombs(m), [SEGMENT, PLACE], "left_anti") if m["tombs"] else rows

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, kind: str) -> str:
        at = self.log.new_data(kind)
        rows.write.option("compression", self.compression).parquet(at)
        return at.rsplit("/", 1)[-1]

    def _segment(self, rows: DataFrame) -> tuple[str, int]:
        """A new segment of ``rows``: (name, number of rows)."""
        name = self._write(rows.select(self.schema.names).withColumn(PLACE, F.monotonically_increasing_id()), "segment")
        return name, self.spark.read.parquet(f"{self.log.folder}/data/{name}").count()

    def _step(self, change: Callable[[dict], dict | None]) -> None:
        """Commit ``change`` of the manifest; again from the new manifest if another writer was first."""
        for _ in range(TRIES):
            n = self.log.latest()
            after = change(self.manifest())
            if after is None:
                return
            try:
                self.log.commit(n + 1, after)
                return
            except CommitConflict:
                continue
        raise CommitConflict(f"{TRIES} tries lost the race for {self.log.folder}")

    def _killed(self, m: dict, keys: DataFrame) -> dict:
        """The manifest with the live rows of ``keys`` dead."""
        dead = self._live(m).join(keys.select(self.key).distinct(), self.key, "left_semi").select(SEGMENT, PLACE)
        tombs = self._write(dead, "tombs")
        counts = self.spark.read.schema(f"{SEGMENT} string").parquet(f"{self.log.folder}/data/{tombs}").groupBy(SEGMENT).count().collect()  # a row a segment
        if not counts:
            return m
        segments = {k: dict(v) for k, v in m["segments"].items()}
        for r in counts:
            segments[r[SEGMENT]]["dead"] += r["count"]
        return m | {"segments": segments, "tombs": [*m["tombs"], tombs]}

    def upsert(self, rows: DataFrame) -> None:
        """Put ``rows`` in place of those with their keys; of rows that share a key the greatest stays, rows without a key go."""
        given = rows.select(self.schema.names).where(F.col(self.key).isNotNull())
        one = given.groupBy(self.key).agg(F.max(F.struct(*self.schema.names)).alias("r")).select("r.*")
        name, n = self._segment(one)
        fresh = self._placed([name]).select(self.key)

        def change(m: dict) -> dict:
            after = self._killed(m, fresh) if m["segments"] else m
            return after | {"segments": after["segments"] | {name: {"rows": n, "dead": 0}}}

        self._step(change)

    def delete(self, keys: DataFrame) -> None:
        self._step(lambda m: self._killed(m, keys) if m["segments"] else None)

    def _rewritten(self, m: dict, names: list[str]) -> dict:
        """The manifest with the live rows of some segments in one new segment, and no tombstones for the old ones."""
        name, n = self._segment(self._live(m, names))
        tombs = self._write(self._tombs(m).where(~F.col(SEGMENT).isin(names)), "tombs")
        kept = {k: v for k, v in m["segments"].items() if k not in names}
        return {"segments": kept | ({name: {"rows": n, "dead": 0}} if n else {}), "tombs": [tombs] if any(v["dead"] for v in kept.values()) else [], "generation": m["generation"] + 1}

    def compact(self, share: float = DEAD_SHARE, rows: int = DEAD_ROWS) -> None:
        """Rewrite segments with too many dead rows."""

        def change(m: dict) -> dict | None:
            names = [k for k, v in m["segments"].items() if v["dead"] > min(share * v["rows"], rows)]
            return self._rewritten(m, names) if names else None

        self._step(change)

    def scrub(self, keys: DataFrame) -> int:
        """Delete ``keys`` and every byte that was ever stored for them; the number of segments that held some."""
        self.delete(keys)
        held: list[str] = []

        def change(m: dict) -> dict | None:
            held[:] = [r[0] for r in self._placed(sorted(m["segments"])).join(keys.select(self.key).distinct(), self.key, "left_semi").select(SEGMENT).distinct().collect()]  # a row a segment
            return self._rewritten(m, held) if held else None

        self._step(change)
        self.vacuum()
        if self._placed(sorted(self.manifest()["segments"])).join(keys.select(self.key), self.key, "left_semi").limit(1).count():
            raise RuntimeError("scrubbed rows came back")
        return len(held)

    def vacuum(self) -> None:
        """Remove older manifests and every file that the current one doesn't name. Nobody may be writing or reading older versions."""
        n = self.log.latest()
        m = self.manifest()
        self.log.forget(n)
        named = {*m["segments"], *m["tombs"]}
        for folder in self.log.data_folders():
            if folder.rsplit("/", 1)[-1] not in named:
                self.log.remove(folder)
