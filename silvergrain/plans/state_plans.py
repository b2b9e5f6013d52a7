"""Queries over tables that are kept up step by step: counters, vector segments, feeds; each equals its rebuild in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deltas as D
from ..operators.feed import ChangeFeed
from ..sources.segments import SegmentStore
from ..sources.vectorfile import read_vectors, write_vectors
from ..storage import new_folder, written
from .fixtures import journal, table, with_journal


def _third(df, key, i):
    """Rows arrive in three batches, not in the order of their keys."""
    return df.where(F.col(key) % 3 == i)


def counters_incremental(spark, sf_dir):
    """Passes of eligible images by pass and state, after three batches of changed passes and paths; root 2 goes in the third."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 997).alias("image"), (F.col("event_id") % 7).alias("pass"), (F.col("event_id") % 4).alias("path"), "event_type", F.when(F.col("user_id") % 5 < 4, F.col("user_id") % 5).alias("root"))
    as_pass = lambda b: b.select("image", "pass", F.col("event_type").alias("state"), "event_id")
    as_path = lambda b: b.select("image", "path", F.when(F.col("event_type") == "error", "stale").otherwise("active").alias("state"), "root", "event_id")
    roots = lambda i: spark.range(4).select(F.col("id").alias("root"), F.when((F.col("id") == 2) & F.lit(i == 2), "retired").otherwise("active").alias("state"))
    counters = D.CounterTable(spark, new_folder(spark, "pass-counters"), ["pass", "state"])
    passes, paths = as_pass(e).limit(0), as_path(e).limit(0)
    for i in range(3):
        batch = _third(e, "event_id", i)
        new_passes, change = D.latest(passes, as_pass(batch), ["image", "pass"], "event_id")
        new_paths, _ = D.latest(paths, as_path(batch), ["image", "path"], "event_id")
        new_passes, new_paths = written(new_passes, "passes"), written(new_paths, "paths")
        flips = written(D.eligibility_change(paths, new_paths, batch, roots(max(i - 1, 0)), roots(i)), "eligibility")
        rows = D.eligible_change(passes, change, D.eligible(new_paths, roots(i)), flips)
        counters.merge(D.counted(rows, ["pass", "state"]), f"batch-{i}")
        passes, paths = new_passes, new_paths
    return counters.read()


def stats_incremental(spark, sf_dir):
    """Image statistics kept up over three batches of the journal, retractions before and after what they name."""
    j = written(journal(spark, sf_dir), "journal")
    stats = D.CounterTable(spark, new_folder(spark, "image-stats"), ["image"], ["events", "remarks", "strokes"], ["last"])
    for i in range(3):
        D.update_image_stats(stats, j.where(F.col("id") % 3 < i), _third(j, "id", i), f"batch-{i}")
    return stats.read().select("image", F.col("events").alias("event_count"), (F.col("remarks") > 0).alias("has_text"), (F.col("strokes") > 0).alias("has_strokes"), F.col("strokes").alias("stroke_count"), F.col("last.ts").alias("last_ts"))


def vectors_segments(spark, sf_dir):
    """Vectors after upserts, deletes, a compaction, a scrub and an upsert of some of the scrubbed, read from the segments."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    store = SegmentStore(spark, new_folder(spark, "segments"), e.schema)
    store.upsert(e.where("vec_id % 2 = 0"))
    store.upsert(e.where("vec_id % 2 = 1 OR vec_id % 5 = 0").withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))))
    store.delete(e.where("vec_id % 7 = 3").select("vec_id"))
    store.compact()
    store.scrub(e.where("vec_id % 11 = 4").select("vec_id"))
    store.upsert(e.where("vec_id % 11 = 4 AND vec_id % 3 = 0"))
    store.compact(share=0)
    return store.read().select("vec_id", F.round(F.element_at("embedding", 1), 6).alias("first"), F.size("embedding").alias("dims"))


def vectorfile_round_trip(spark, sf_dir):
    """Vectors written to flat files and read back by ranges of rows: within half a step of what they were."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    folder = new_folder(spark, "vector-files")
    places = written(write_vectors(e, folder, rows=200), "places")
    steps = places.join(e, "vec_id").select("path", F.posexplode("embedding").alias("i", "x")).groupBy("path", "i").agg(((F.max("x") - F.min("x")) / 254).alias("step"))
    back = places.join(read_vectors(spark, folder, rows=100), ["path", "row"]).join(e.withColumnRenamed("embedding", "was"), "vec_id")
    near = back.select("vec_id", "path", F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.col("was").alias("b"))).alias("i", "p"))
    return near.join(steps, ["path", "i"]).groupBy("vec_id").agg(F.count(F.lit(1)).alias("dims"), F.min(F.abs(F.col("p.a") - F.col("p.b")) <= F.col("step") * 0.5001 + 1e-6).alias("close"))


def feed_consumers(spark, sf_dir):
    """Two consumers of a feed that keeps half of the changes: the one that polls late is reset, and both end with the table."""
    e = written(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 777).alias("image"), "event_type", "value"), "changes")
    n = e.count()
    feed = ChangeFeed(spark, new_folder(spark, "feed"), "image", retention=max(1, n // 2))
    held = {c: spark.createDataFrame([], "image long, value double") for c in ("late", "prompt")}
    resets = dict.fromkeys(held, 0)
    now = e.limit(0).select("image", "value")
    for i in range(4):
        feed.publish(e.where(F.col("event_id") % 4 == i), "event_id")
        last = e.where(F.col("event_id") % 4 <= i).groupBy("image").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("r"))
        now = written(last.where("r.event_type <> 'error'").select("image", "r.value"), "table")
        for consumer in ("prompt", "late") if i in (0, 3) else ("prompt",):
            given = feed.poll(consumer, now)
            resets[consumer] += given.reset
            rows = written(given.rows, "given")
            kept = held[consumer].limit(0) if given.reset else held[consumer].join(rows, "image", "left_anti")
            held[consumer] = written(kept.unionByName(now.join(rows.where("change = 'upsert'"), "image", "left_semi")), "held")
            feed.acknowledge(consumer, given)
    return held["prompt"].select(F.lit("prompt").alias("consumer"), F.lit(resets["prompt"]).alias("resets"), "image", "value").union(held["late"].select(F.lit("late"), F.lit(resets["late"]), "image", "value"))


QUERIES = [counters_incremental, stats_incremental, vectors_segments, vectorfile_round_trip, feed_consumers]

SQL = {
    "counters_incremental": """WITH e AS (SELECT event_id, event_id % 997 AS image, event_id % 7 AS pass, event_id % 4 AS path, event_type, CASE WHEN user_id % 5 < 4 THEN user_id % 5 ELSE -1 END AS root FROM events),
      passes AS (SELECT image, pass, arg_max(event_type, event_id) AS state FROM e GROUP BY 1, 2),
      paths AS (SELECT image, path, arg_max(event_type, event_id) AS kind, arg_max(root, event_id) AS root FROM e GROUP BY 1, 2)
      SELECT pass, state, count(*) AS n FROM passes WHERE image IN (SELECT image FROM paths WHERE kind <> 'error' AND root <> 2) GROUP BY 1, 2""",
    "vectors_segments": """SELECT vec_id, round((CASE WHEN vec_id % 5 = 0 AND vec_id % 11 <> 4 THEN -1 ELSE 1 END) * embedding[1]::DOUBLE, 6) AS first, len(embedding)::INTEGER AS dims FROM embeddings
      WHERE CASE WHEN vec_id % 11 = 4 THEN vec_id % 3 = 0 ELSE vec_id % 7 <> 3 END""",
    "vectorfile_round_trip": "SELECT vec_id, len(embedding) AS dims, true AS close FROM embeddings",
    # the first poll of a consumer is a reset; the late one is behind the mark at its second
    "feed_consumers": """WITH t AS (SELECT event_id % 777 AS image, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1)
      SELECT c AS consumer, r::INTEGER AS resets, image, value FROM t, (VALUES ('prompt', 1), ('late', 2)) v(c, r) WHERE kind <> 'error'""",
    "stats_incremental": with_journal("SELECT image, event_count, has_text, has_strokes, stroke_count, last_ts FROM stats"),
}
