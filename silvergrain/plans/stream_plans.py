"""Streaming forms over ``events``, and sources and sinks by round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import journal as J
from ..operators import near
from ..sources import files, sidecars
from ..storage import shared_folder, spread
from ..streaming import streams as R
from .fixtures import JOURNAL_SQL, journal, table, with_journal
from .time_plans import _GAPS, SEGMENTS, WRITES
from .time_plans import SQL as TIME_SQL


def _stream(spark, sf_dir):
    """All files in one batch: a table's files are in no order of time, and rows of a second one would be late by the first."""
    return R.table_stream(spark, sf_dir, "events", per_batch=None)


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/silvergrain-tables/{name}-{uuid.uuid4().hex}"


def stream_sessions(spark, sf_dir):
    return R.run_available(R.sessions(_stream(spark, sf_dir), "user_id"), "sessions")


def stream_dwell(spark, sf_dir):
    e = _stream(spark, sf_dir).withColumns({"image": F.col("event_id") % 200, "ms": (F.floor("value") * 1000).cast("long")})
    return R.run_available(R.dwell(e, "image", "ms", cap=6000), "dwell")


def stream_moves(spark, sf_dir):
    """The stream writes blocks that met; their pairs, many times as many as rows, are formed where they are read."""
    rows = lambda kind: _stream(spark, sf_dir).where(F.col("event_type") == kind).select((F.col("event_id") % 4).alias("image"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), "ts")
    return near.pairs(R.run_available(R.move_blocks(rows("error"), rows("view"), "image", within=3600, late="2 hours"), "moves"), "image", 3600)


def stream_debounce(spark, sf_dir):
    return R.run_available(R.debounced(_stream(spark, sf_dir), "user_id", quiet=7200, cap=20000), "debounce")


def stream_segments(spark, sf_dir):
    """Windows lie hours apart here, so no silence closes a segment; what is open at the end stays open."""
    return R.run_available(R.segments(_stream(spark, sf_dir).withColumn("p", F.col("value") / 20), "user_id", "event_id", "p", "ts", hang=3, idle_ms=10**12), "segments")


def stream_stable(spark, sf_dir):
    """Files (users) listed twice with the same size, six hours apart or more."""
    listed = _stream(spark, sf_dir).select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.floor(F.col("value") / 10).alias("size"), F.lit(1).cast("long").alias("mtime"), "ts")
    return R.run_available(R.stable_files(listed, "path", settle=6 * 3_600_000, forget=10**12), "stable")


def stream_focus(spark, sf_dir):
    """Episodes of users over two items, one, or none, idle after two hours."""
    e = _stream(spark, sf_dir).select("user_id", "ts", F.when(F.col("value") < 4, F.array(F.lit(1), F.lit(2))).when(F.col("value") < 9, F.array(F.lit(1))).alias("items"), F.when(F.col("event_type") == "view", "look").otherwise("grid").alias("source"))
    return R.run_available(R.focus_episodes(e, "user_id", "ts", "items", "source", idle_ms=2 * 3_600_000), "focus")


def stream_finals(spark, sf_dir):
    e = _stream(spark, sf_dir).select("ts", F.when(F.col("event_type") == "view", "final").otherwise("partial").alias("kind"), F.col("event_id").alias("utterance"))
    return R.run_available(R.finals(e).select("utterance"), "finals")


def stream_scope(spark, sf_dir):
    e = _stream(spark, sf_dir).where("event_type IN ('view', 'purchase')").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", (F.col("event_type") == "purchase").alias("is_state"))
    return R.run_available(R.scope_lookup(e, "user_id", "at", "value", "is_state"), "scope")


def sidecar_round_trip(spark, sf_dir):
    """The journal exported as documents and read back: events that reach an image."""
    j, folder = journal(spark, sf_dir), _folder(spark, "sidecars")
    sidecars.export(j, folder)
    return sidecars.rebuild(spark, folder).select("id", "kind", "text", "rating", "scrubbed")


def sidecar_manifest(spark, sf_dir):
    return sidecars.export(journal(spark, sf_dir), _folder(spark, "sidecars")).select("image", "events")


def rebuilt_stats(spark, sf_dir):
    """Statistics of the journal that comes back from documents equal those of the journal."""
    j, folder = journal(spark, sf_dir), _folder(spark, "sidecars")
    sidecars.export(j, folder)
    return J.image_stats(sidecars.rebuild(spark, folder)).select("image", "event_count", "has_text", "has_strokes", "stroke_count")


def collections_round_trip(spark, sf_dir):
    rows, folder = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _folder(spark, "collections")
    sidecars.export_rows(rows, folder)
    return sidecars.import_rows(spark, folder, "c_custkey long, c_name string").where("_corrupt_record IS NULL").drop("_corrupt_record")


def exif_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    written = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    return o.select("o_orderkey", dates.capture_time(F.when(F.col("o_orderkey") % 5 == 0, "0000").otherwise(written), F.when(F.col("o_orderkey") % 2 == 0, "+05:30").when(F.col("o_orderkey") % 3 == 0, "-01:00")).alias("captured"))


def foreign_edits(spark, sf_dir):
    k = F.col("p_partkey")
    xmp = F.when(k % 4 == 0, F.concat(F.lit('<x:Description xmp:Rating="'), (k % 8 - 1).cast("string"), F.lit('" crs:HasCrop="True"/>'))).when(k % 4 == 1, F.concat(F.lit("<xmp:Rating> "), (k % 6).cast("string"), F.lit(" </xmp:Rating>"))).otherwise("<x/>")
    return spread(table(spark, sf_dir, "part")).select("p_partkey", files.foreign_edits(xmp).alias("e")).select("p_partkey", "e.rating", "e.cropped")


def foreign_crops(spark, sf_dir):
    """Labels, orientations and crops of parts' foreign documents: whole, switched off, of a side that is no number, and hidden in a history."""
    k, side = F.col("p_partkey"), lambda n: F.format_string(f' crs:Crop{n}="%s"', F.round(F.col("p_size") / F.lit({"Top": 400, "Left": 300, "Bottom": 60, "Right": 55}[n]), 4).cast("string"))
    sides = F.concat(side("Top"), side("Left"), F.when(k % 6 == 4, ' crs:CropBottom="?"').otherwise(side("Bottom")), side("Right"))
    on = F.when(k % 6 == 1, "False").when(k % 6 == 2, "1").otherwise("True")
    xmp = F.concat(F.lit('<x:D tiff:Orientation="'), (k % 10).cast("string"), F.lit('" xmp:Label="'), F.when(k % 3 == 0, "Red").otherwise(""), F.lit('" crs:HasCrop="'), on, F.lit('"'), sides, F.when(k % 4 == 0, ' crs:CropAngle="-2.5"').otherwise(""), F.lit(">"), F.when(k % 6 == 5, '<rdf:li darktable:operation="crop"/>').otherwise(""), F.lit("</x:D>"))
    e = spread(table(spark, sf_dir, "part")).select("p_partkey", files.foreign_edits(xmp).alias("e"))
    return e.select("p_partkey", "e.label", "e.orientation", "e.cropped", "e.unreadable", "e.crop.top", "e.crop.left", "e.crop.bottom", "e.crop.right", "e.crop.angle")


def stream_immediate(spark, sf_dir):
    return R.run_available(R.debounced(_stream(spark, sf_dir).withColumn("now", F.col("event_type") == "error"), "user_id", quiet=7200, cap=20000, immediate="now"), "immediate")


QUERIES = [foreign_crops, stream_immediate, stream_sessions, stream_dwell, stream_moves, stream_debounce, stream_segments, stream_stable, stream_focus, stream_finals, stream_scope, sidecar_round_trip, sidecar_manifest, rebuilt_stats, collections_round_trip, exif_times, foreign_edits]

_REACH = "answered AS (SELECT id, image FROM journal WHERE image IS NOT NULL UNION ALL SELECT r.id, j.image FROM roots r JOIN journal j ON j.id = r.root WHERE j.image IS NOT NULL), reached AS (SELECT * FROM answered UNION ALL SELECT j.id, a.image FROM journal j JOIN answered a ON a.id = j.target_event WHERE j.kind = 'retraction')"
SQL = {
    # what the watermark, ten minutes behind the latest event, has passed
    "stream_sessions": f"SELECT user_id, start, \"end\", n FROM ({_GAPS(1800, '>=')}) WHERE epoch_us(\"end\") + 1800::BIGINT * 1000000 - 1 <= (SELECT max(epoch_ms(ts)) * 1000 - 600::BIGINT * 1000000 FROM events)",
    "stream_dwell": "SELECT event_id % 200 AS image, date_trunc('day', ts)::TIMESTAMP AS day, sum(least(6000, floor(value)::BIGINT * 1000))::BIGINT AS dwell_ms, count(*) AS episodes FROM events WHERE floor(value) * 1000 >= 250 GROUP BY 1, 2 HAVING epoch_us(any_value(date_trunc('day', ts)::TIMESTAMP)) + 86400::BIGINT * 1000000 <= (SELECT max(epoch_ms(ts)) * 1000 - 600::BIGINT * 1000000 FROM events)",
    "stream_debounce": f"SELECT * FROM ({WRITES}) WHERE epoch_us(due) <= (SELECT max(epoch_ms(ts)) * 1000 - 10::BIGINT * 1000000 FROM events)",
    "stream_segments": f'{SEGMENTS} SELECT user_id, oa AS start, ob AS "end" FROM f WHERE oa IS NOT NULL',
    "stream_stable": """WITH l AS (SELECT 'f' || user_id AS path, floor(value / 10)::BIGINT AS size, epoch_us(ts) // 1000 AS t FROM events),
      b AS (SELECT *, CASE WHEN size = lag(size) OVER (PARTITION BY path ORDER BY t) THEN 0 ELSE 1 END AS brk FROM l), r AS (SELECT *, sum(brk) OVER (PARTITION BY path ORDER BY t) AS run FROM b)
      SELECT path, size, 1::BIGINT AS mtime FROM r GROUP BY path, size, run HAVING max(t) - min(t) >= 6 * 3600000""",
    "stream_focus": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, CASE WHEN value < 4 THEN 2 WHEN value < 9 THEN 1 ELSE 0 END AS n, CASE WHEN event_type = 'view' THEN 'look' ELSE 'grid' END AS source FROM events),
      b AS (SELECT *, CASE WHEN n = lag(n) OVER w AND source = lag(source) OVER w AND t - lag(t) OVER w <= 7200000 THEN 0 ELSE 1 END AS brk, lead(t) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
      r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t) AS run FROM b),
      g AS (SELECT user_id, n, source, min(t) AS start, max(t) AS last, arg_max(coalesce(next, 9e15::BIGINT), t) AS next FROM r WHERE n > 0 GROUP BY user_id, n, source, run)
      SELECT user_id, unnest(CASE WHEN n = 2 THEN [1, 2] ELSE [1] END)::BIGINT AS item, source, start, least(next, last + 7200000) - start AS elapsed_ms FROM g
      WHERE least(next, last + 7200000) - start >= 250 AND (next < 9e15 OR last + 7200000 <= (SELECT max(epoch_us(ts) // 1000) - 10000 FROM events))""",
    # a state is forgotten when a user is silent for more than a day
    "stream_scope": """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('view', 'purchase')),
      b AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ts, event_type) > 86400000 THEN 1 ELSE 0 END AS brk FROM e),
      r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS run FROM b)
      SELECT user_id, epoch_us(ts) AS at, state AS value, false AS predated FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM r) WHERE event_type = 'view' AND state IS NOT NULL""",
    "stream_moves": "SELECT a.event_id % 4 AS image, 'f' || a.event_id AS old_path, 'f' || b.event_id AS new_path FROM events a JOIN events b ON a.event_id % 4 = b.event_id % 4 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600::BIGINT * 1000000 WHERE a.event_type = 'error' AND b.event_type = 'view'",
    "stream_finals": "SELECT event_id AS utterance FROM events WHERE event_type = 'view'",
    "sidecar_round_trip": with_journal("SELECT id, kind, text, rating, scrubbed FROM journal WHERE id IN (SELECT id FROM reached)", _REACH),
    "sidecar_manifest": with_journal("SELECT image, count(*)::INTEGER AS events FROM reached GROUP BY image", _REACH),
    "rebuilt_stats": with_journal("SELECT image, event_count, has_text, has_strokes, stroke_count FROM stats"),
    "collections_round_trip": "SELECT c_custkey, c_name FROM customer",
    "exif_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 330 MINUTES WHEN o_orderkey % 3 = 0 THEN INTERVAL (-60) MINUTES ELSE INTERVAL 0 MINUTES END END AS captured FROM orders",
    "foreign_crops": """WITH k AS (SELECT p_partkey, p_partkey % 6 IN (0, 2, 3) AS whole, p_size FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Red' END AS label, CASE WHEN p_partkey % 10 BETWEEN 1 AND 8 THEN (p_partkey % 10)::INTEGER END AS orientation, p_partkey % 6 <> 1 AS cropped, p_partkey % 6 = 5 AS unreadable,
        CASE WHEN whole THEN round(p_size / 400.0::DOUBLE, 4) END AS top, CASE WHEN whole THEN round(p_size / 300.0::DOUBLE, 4) END AS left, CASE WHEN whole THEN round(p_size / 60.0::DOUBLE, 4) END AS bottom, CASE WHEN whole THEN round(p_size / 55.0::DOUBLE, 4) END AS right,
        CASE WHEN whole AND p_partkey % 4 = 0 THEN -2.5::DOUBLE END AS angle FROM k""",
    "stream_immediate": f"SELECT user_id, first, last, due FROM ({TIME_SQL['write_immediate']}) WHERE epoch_us(due) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 10::BIGINT * 1000000 FROM events)",
    "foreign_edits": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 8 <= 6 THEN p_partkey % 8 - 1 END WHEN 1 THEN p_partkey % 6 END::INTEGER AS rating, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS cropped FROM part",
}
