"""The file catalog: reconciliation, paths, counters, orphans, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .temporal import micros

# File types of an archive, and names that a scan leaves out.
RAW_TYPES = "dng cr2 cr3 crw nef nrw arw raf orf ori rw2 pef srw x3f 3fr fff iiq mos mrw kdc dcr sr2 srf erf".split()
PLAIN_TYPES = "jpg jpeg png tif tiff webp heic heif".split()
EXCLUDED_FOLDERS = ["@eadir", "__macosx", "$recycle.bin", "system volume information", "lost+found", "node_modules", "cache", "proxies", "thumbnails"]
EXCLUDED_FOLDER_ENDINGS = [".lrdata", ".cocatalogdb"]
EXCLUDED_FOLDER_BEGINNINGS = [".", "lightroom catalog"]
EXCLUDED_FILE_ENDINGS = [".sidecar.json", ".tmp.drivedownload", ".tmp.driveupload"]
EXCLUDED_FILE_BEGINNINGS = [".", "~$"]


def file_class(path: Column) -> Column:
    """``raw``, ``image`` or null, by the extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*RAW_TYPES), "raw").when(ext.isin(*PLAIN_TYPES), "image")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def excluded(path: Column) -> Column:
    """Whether the path lies in a folder, or is a file, that a scan leaves out (hidden ones too)."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    left_out = F.exists(folders, lambda p: p.isin(*EXCLUDED_FOLDERS) | _any([p.endswith(e) for e in EXCLUDED_FOLDER_ENDINGS]) | _any([p.startswith(e) for e in EXCLUDED_FOLDER_BEGINNINGS]))
    return left_out | _any([name.endswith(e) for e in EXCLUDED_FILE_ENDINGS]) | _any([name.startswith(e) for e in EXCLUDED_FILE_BEGINNINGS])


def reconcile(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """(rel_path, change, hash, old_hash) of a scan against stored rows.

    ``stored``: rel_path, size, mtime, hash, state. ``walked``: rel_path, size, mtime, hash.
    A file with the stored size and time is unchanged and needs no hash; else it is updated,
    relinked (stale before, same bytes), superseded (other bytes), moved (new here, its bytes
    gone elsewhere), new or stale.
    """
    s = stored.select("rel_path", F.col("size").alias("os"), F.col("mtime").alias("om"), F.col("hash").alias("old_hash"), "state")
    both = s.join(walked.withColumn("here", F.lit(True)), "rel_path", "full_outer")
    gone = both.where(F.col("here").isNull() & (F.col("state") == "active")).select(F.col("old_hash").alias("hash")).distinct().withColumn("gone", F.lit(True))
    out = both.join(gone, "hash", "left")
    same_stat = (F.col("size") == F.col("os")) & (F.col("mtime") == F.col("om"))
    same_bytes = F.col("hash") == F.col("old_hash")
    change = (
        F.when(F.col("here").isNull(), F.when(F.col("state") == "active", "stale").otherwise("absent"))
        .when(F.col("state").isNull(), F.when(F.col("gone"), "moved").otherwise("new"))
        .when((F.col("state") == "active") & same_stat, "unchanged")
        .when(same_bytes, F.when(F.col("state") == "active", "updated").otherwise("relinked"))
        .otherwise("superseded")
    )
    return out.select("rel_path", change.alias("change"), "hash", "old_hash")


def best_paths(paths: DataFrame, volumes: DataFrame, roots: DataFrame) -> DataFrame:
    """The path by which to reach each image: online, in an active root, writable, verified last, then by name."""
    rows = paths.where("active").join(volumes.select("volume", "online", "read_only"), "volume").join(roots.select("root", F.col("active").alias("root_active")), "root", "left")
    rank = F.struct(
        (~F.col("online")).alias("a"), F.when(F.col("root_active"), 0).when(F.col("root_active").isNull(), 2).otherwise(1).alias("b"), F.col("read_only").alias("c"),
        (-micros("verified_at")).alias("d"), "volume", "rel_path", "online",
    )
    return rows.groupBy("image").agg(F.min(rank).alias("r")).select("image", "r.volume", "r.rel_path", "r.online")


def availability(paths: DataFrame, volumes: DataFrame, images: DataFrame) -> DataFrame:
    """(image, availability): available, offline or missing."""
    counted = paths.where("active").join(volumes.select("volume", "online"), "volume").groupBy("image").agg(F.max("online").alias("any_online"))
    return images.select("image").join(counted, "image", "left").select("image", F.when(F.col("any_online"), "available").when(F.col("any_online").isNotNull(), "offline").otherwise("missing").alias("availability"))


def offline_burden(paths: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume, images): images that only volumes now offline hold, by volume."""
    at = paths.where("active").join(volumes.select("volume", "online"), "volume")
    reachable = at.where("online").select("image").distinct()
    return at.where("NOT online").join(reachable, "image", "left_anti").groupBy("volume").agg(F.countDistinct("image").alias("images")).where("images > 0")


def pass_counters(passes: DataFrame, states: list[str], by: str = "pass", state: str = "state") -> DataFrame:
    """A row per pass with a count for each state."""
    return passes.groupBy(by).pivot(state, states).agg(F.count(F.lit(1))).na.fill(0)


def error_category(error: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(e.startswith("io:") | e.startswith("volume-offline"), "io")
    for prefix in ("decode", "embedder", "vector-store"):
        out = out.when(e.startswith(prefix + ":"), prefix)
    for whole, name in (("missing-image-row", "missing-image"), ("no-worker", "no-worker"), ("decode-panic", "decode-panic")):
        out = out.when(e == whole, name)
    return out.when(e.contains("geometry disagreement"), "geometry").otherwise("other")


def metric_token(value: Column) -> Column:
    """A short lower-case token, ``other`` for anything else."""
    t = F.lower(F.trim(value))
    return F.when(value.isNull(), F.lit(None)).when(t.rlike(r"^[a-z0-9._-]{1,32}$"), t).otherwise("other")


def error_taxonomy(passes: DataFrame, images: DataFrame) -> DataFrame:
    """(pass, category, format, raw_subtype, n) of failed passes."""
    failed = passes.where("state = 'error'").join(images.select("image", "format", "raw_subtype"), "image")
    return failed.groupBy(metric_token(F.col("pass")).alias("pass"), error_category(F.col("error")).alias("category"), metric_token(F.col("format")).alias("format"), metric_token(F.col("raw_subtype")).alias("raw_subtype")).agg(F.count(F.lit(1)).alias("n"))


def orphan_cohorts(paths: DataFrame, passes: DataFrame, cutoff: Column) -> DataFrame:
    """(image, cohort) of images whose paths are all stale: unknown (a time is missing), busy, eligible or recent."""
    active = paths.where("state = 'active'").select("image")
    busy = passes.where("state = 'running'").select("image").distinct().withColumn("busy", F.lit(True))
    stale = paths.where("state = 'stale'").join(active, "image", "left_anti").groupBy("image").agg(F.max(F.col("stale_since").isNull()).alias("unknown"), F.max("stale_since").alias("latest"))
    cohort = F.when(F.col("unknown"), "unknown").when(F.col("busy"), "busy").when(F.col("latest") <= cutoff, "eligible").otherwise("recent")
    return stale.join(busy, "image", "left").select("image", cohort.alias("cohort"))


def clock_shift(mismatches: DataFrame, loaded: int, tolerance: int = 2) -> DataFrame:
    """(hours, n): the whole-hour shift that most same-size mismatches (size, old_size, delta_s) share, if over a quarter of ``loaded`` rows do."""
    hours = F.floor((F.col("delta_s") + 1800) / 3600)
    near = mismatches.where(F.col("size") == F.col("old_size")).withColumn("hours", hours).where((F.col("hours") != 0) & (F.abs(F.col("delta_s") - F.col("hours") * 3600) <= tolerance))
    return near.groupBy("hours").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hours").limit(1).where(F.col("n") * 4 > loaded)


def prior_versions(paths: DataFrame) -> DataFrame:
    """(volume, rel_path, image, last_seen): superseded versions at each place, newest first by ``last_seen``."""
    return paths.where("state = 'superseded'").groupBy("volume", "rel_path", "image").agg(F.max("stale_since").alias("last_seen"))


def correlate_moves(deleted: DataFrame, arrived: DataFrame, window: int = 10) -> DataFrame:
    """(image, old_path, new_path): a path that vanished and one with the same bytes that came within ``window`` seconds.

    Both meet in buckets of time as long as the window, so only neighbours in time form pairs. Pairs
    may be many more than the rows they are made of, so rows are dealt to more tasks than their size asks for.
    """
    tasks = 8 * deleted.sparkSession.sparkContext.defaultParallelism
    bucket = lambda c: F.floor(micros(c) / (max(window, 1) * 1_000_000))
    d = deleted.select("image", F.col("rel_path").alias("old_path"), micros("ts").alias("gone_at"), F.explode(F.array(*(bucket("ts") + i for i in (-1, 0, 1)))).alias("__b"))
    a = arrived.select("image", F.col("rel_path").alias("new_path"), micros("ts").alias("came_at"), bucket("ts").alias("__b"))
    close = F.abs(F.col("came_at") - F.col("gone_at")) <= window * 1_000_000
    return d.repartition(tasks, "image", "__b").join(a.repartition(tasks, "image", "__b"), ["image", "__b"]).where(close & (F.col("old_path") != F.col("new_path"))).select("image", "old_path", "new_path")


def claim_order(passes: DataFrame, paths: DataFrame, volumes: DataFrame, roots: DataFrame, allowed: list[str], now: Column, limit: int = 1) -> DataFrame:
    """The next work: pending, due, of an allowed pass, reachable; by priority, then age."""
    online = paths.where("active").join(volumes.where("online").select("volume"), "volume", "left_semi").join(roots.where("active").select("root"), "root", "left_semi")
    ready = passes.where((F.col("state") == "pending") & F.col("pass").isin(*allowed) & (F.col("not_before").isNull() | (F.col("not_before") <= now)))
    return ready.join(online.select("image"), "image", "left_semi").orderBy("priority", "enqueued_at", "image", "pass").limit(limit)


def retry_state(attempts: Column, lifetime: Column) -> Column:
    """What follows a failure: seconds until the next try, or null where the pass ends in error."""
    return F.when((attempts >= 3) | (lifetime >= 10), F.lit(None)).when(attempts <= 1, 60).otherwise(600)


def write_backoff(attempts: Column) -> Column:
    """Seconds to wait after so many failed writes; the last step repeats."""
    return F.when(attempts <= 1, 1).when(attempts == 2, 5).when(attempts == 3, 30).otherwise(300)


def folder_tree(paths: DataFrame) -> DataFrame:
    """(root, folder): every ancestor folder of an active path."""
    parts = F.split(text.parent_folder(F.col("rel_path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where("active").select("root", F.explode(up).alias("folder")).where("folder <> ''").distinct()


def folder_keys(paths: DataFrame) -> DataFrame:
    """(image, folder): the folder of each image's least active path, under its root."""
    least = paths.where("active").groupBy("image").agg(F.min(F.struct("rel_path", "root")).alias("m"))
    return least.select("image", F.concat_ws("/", F.col("m.root").cast("string"), text.parent_folder(F.col("m.rel_path"))).alias("folder"))


def display_paths(paths: DataFrame, volumes: DataFrame) -> DataFrame:
    """(image, rel_path): where a list shows an image: an active path before a stale one, online before offline, then by name."""
    rows = paths.join(volumes.select("volume", "online"), "volume")
    return rows.groupBy("image").agg(F.min(F.struct((~F.col("active")).alias("a"), (~F.col("online")).alias("o"), "rel_path")).alias("m")).select("image", "m.rel_path")


def stage_rollup(stages: DataFrame) -> DataFrame:
    """(stage, done, total, remaining, rate, state, eta): progress of work by stage."""
    s = stages.groupBy("stage").agg(F.sum("done").alias("done"), F.sum("total").alias("total"), F.max("rate").alias("rate"))
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return s.withColumns({"remaining": left, "state": F.when(left <= 0, "done").when(F.col("rate") > 0, "working").otherwise("pending"), "eta": F.when((left > 0) & (F.col("rate") > 0), left / F.col("rate"))})


def latency_histogram(samples: DataFrame, by: str, micros: str) -> DataFrame:
    """(by, count, total_ms, p50, p95, p99, max_ms): percentiles as upper bounds of power-of-two buckets."""
    bucket = F.when(F.col(micros) <= 1, 0).otherwise(F.ceil(F.log2(micros))).cast("int")
    counted = samples.groupBy(by, bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(micros).alias("s"), F.max(micros).alias("m"))
    w = W.partitionBy(by)
    run = counted.withColumns({"up": F.sum("n").over(w.orderBy("b")), "all": F.sum("n").over(w)})  # some dozen buckets a key
    bound = lambda q: F.min(F.when(F.col("up") >= F.ceil(F.col("all") * q / 100), F.pow(F.lit(2.0), F.col("b")) / 1000))
    return run.groupBy(by).agg(F.sum("n").alias("count"), (F.sum("s") / 1000).alias("total_ms"), bound(50).alias("p50_ms"), bound(95).alias("p95_ms"), bound(99).alias("p99_ms"), (F.max("m") / 1000).alias("max_ms"))


def pair_stacks(items: DataFrame, collapsed: bool = True, raw_on_top: bool = False) -> DataFrame:
    """(root, folder, base, primary, alt): RAW and plain files of one shot; the rest stand alone.

    ``items``: image, root, rel_path. The least image of each kind is the pair's; others of the
    same name stand alone too.
    """
    name = F.lower(text.base_name(F.col("rel_path")))
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    rows = items.select("image", "root", text.parent_folder(F.col("rel_path")).alias("folder"), base.alias("base"), file_class(F.col("rel_path")).alias("kind"))
    pairs = rows.where("kind IS NOT NULL").groupBy("root", "folder", "base").agg(F.min(F.when(F.col("kind") == "image", F.col("image"))).alias("plain"), F.min(F.when(F.col("kind") == "raw", F.col("image"))).alias("raw")).where("plain IS NOT NULL AND raw IS NOT NULL")
    if not collapsed:
        return rows.select("root", "folder", "base", F.col("image").alias("primary"), F.lit(None).cast("long").alias("alt"))
    top, under = ("raw", "plain") if raw_on_top else ("plain", "raw")
    stacked = pairs.select("root", "folder", "base", F.col(top).alias("primary"), F.col(under).alias("alt"))
    used = pairs.select(F.col("plain").alias("image")).union(pairs.select("raw"))
    alone = rows.join(used, "image", "left_anti").select("root", "folder", "base", F.col("image").alias("primary"), F.lit(None).cast("long").alias("alt"))
    return stacked.union(alone)


def grid_sorted(items: DataFrame, mode: str) -> DataFrame:
    """Images in the order of a grid: capture_desc, capture_asc (undated last in both), name, added, attention."""
    keys = {
        "capture_desc": [F.col("capture_ts").desc_nulls_last()], "capture_asc": [F.col("capture_ts").asc_nulls_last()], "name": [F.col("name").asc_nulls_last()],
        "added": [F.col("added_ts").desc_nulls_last()], "attention": [F.col("attention").desc_nulls_last()],
    }[mode]
    return items.orderBy(*keys, "image")


def delta(log: DataFrame, listed: DataFrame, since: int, head: int, oldest: int) -> tuple[DataFrame, bool]:
    """((image, change) of keys that changed in (since, head], whether the reader must start anew).

    A reader behind the ``oldest`` kept revision, or ahead of the head, starts anew.
    """
    changed = log.where((F.col("revision") > since) & (F.col("revision") <= head)).select("image").distinct()
    upserts = changed.join(listed, "image", "left_semi").withColumn("change", F.lit("upsert"))
    removed = changed.join(listed, "image", "left_anti").withColumn("change", F.lit("removed"))
    return upserts.unionByName(removed), since < oldest - 1 or since > head


def histogram(pixels: DataFrame, log: bool = False) -> DataFrame:
    """(channel, bin, n, height) of pixels (r, g, b, a); transparent ones don't count; heights are relative to the channel's peak."""
    luma = F.round(F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722).cast("int")
    opaque = pixels.where("a > 0").select(F.explode(F.create_map(F.lit("r"), F.col("r"), F.lit("g"), F.col("g"), F.lit("b"), F.col("b"), F.lit("luma"), luma)).alias("channel", "bin"))
    counted = opaque.groupBy("channel", "bin").agg(F.count(F.lit(1)).alias("n"))
    peak = F.max("n").over(W.partitionBy("channel"))  # 256 bins a channel
    height = F.log1p("n") / F.log1p(peak) if log else F.col("n") / peak
    return counted.withColumn("height", height)
