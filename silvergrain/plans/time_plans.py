"""Queries by time over ``events``, and over the catalog that orders stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import TUNING
from ..operators import catalog as C
from ..operators import temporal as T
from .filter_plans import FIXTURE_SQL, images, tables
from .fixtures import journal, table, with_journal


def session_rotate(spark, sf_dir):
    return T.sessions(table(spark, sf_dir, "events"), "user_id")


def folder_bursts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.bursts(e, "user_id", "ts", "event_id", gap=3600, least=2).select("user_id", "start", "n", F.array_join("members", ",").alias("members"))


def asof_scope(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return T.as_of(e.where("event_type = 'view'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "ts", "value")


def _spans(spark, sf_dir, kind):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select((F.col("event_id") % 3).alias("lane"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("start"), (F.timestamp_micros(T.micros("ts") + (F.col("value") * 1e6).cast("long"))).alias("end"), (F.col("user_id") % 2).alias("gate"))


def interval_link(spark, sf_dir):
    return T.link_intervals(_spans(spark, sf_dir, "click"), _spans(spark, sf_dir, "view"), "lane", gate="gate")


def nearest_onset(spark, sf_dir):
    s = lambda k: _spans(spark, sf_dir, k).select("lane", "id", F.col("start").alias("ts"))
    return T.nearest_onset(s("click"), s("view"), "lane", most=1800)


def ewma_rate(spark, sf_dir):
    return T.smoothed_rate(table(spark, sf_dir, "events").withColumn("bytes", F.col("event_id") * 10 % 70001), "user_id", "ts", "bytes").withColumn("rate", F.round("rate", 6))


def speech_segments(spark, sf_dir):
    return T.segments(table(spark, sf_dir, "events").withColumn("p", F.col("value") / 20), "user_id", "event_id", "p", hang=3)


def write_debounce(spark, sf_dir):
    return T.debounced(table(spark, sf_dir, "events"), "user_id", quiet=7200, cap=20000)


def write_immediate(spark, sf_dir):
    """Writes as before, where an error is due at once, and when a write that fails so often may be tried again."""
    e = table(spark, sf_dir, "events").withColumn("now", F.col("event_type") == "error")
    return T.debounced(e, "user_id", quiet=7200, cap=20000, immediate="now").withColumn("retry", T.retry_at(F.col("due"), F.col("user_id") % 6))


def dwell_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({"image": F.col("event_id") % 200, "ms": (F.floor("value") * 1000).cast("long")})
    return T.dwell(e, "image", "ms", F.when(F.col("event_type") == "view", 1.0).otherwise(0.15), "ts", cap=6000)


def _volumes(spark):
    return spark.range(3).select(F.col("id").alias("volume"), (F.col("id") < 2).alias("online"), (F.col("id") == 1).alias("read_only"))


def _paths(spark, sf_dir):
    """Two paths an image: its own and one on the next volume; verified when ordered."""
    p = tables(spark, sf_dir)["paths"].join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderdate").alias("verified_at")), "image")
    second = p.where("image % 3 = 0").withColumns({"volume": (F.col("volume") + 1) % 3, "rel_path": F.concat(F.lit("Copy/"), F.col("rel_path")), "active": F.col("image") % 7 != 0})
    return p.unionByName(second)


def best_path(spark, sf_dir):
    return C.best_paths(_paths(spark, sf_dir), _volumes(spark), tables(spark, sf_dir)["roots"])


def availability(spark, sf_dir):
    return C.availability(_paths(spark, sf_dir), _volumes(spark), images(spark, sf_dir))


def offline_burden(spark, sf_dir):
    return C.offline_burden(_paths(spark, sf_dir), _volumes(spark))


def display_path(spark, sf_dir):
    return C.display_paths(_paths(spark, sf_dir), _volumes(spark))


def _passes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    error = F.when(F.col("l_partkey") % 7 == 0, "IO: gone").when(F.col("l_partkey") % 7 == 1, "decode:bad").when(F.col("l_partkey") % 7 == 2, "no-worker").when(F.col("l_partkey") % 7 == 3, "a Geometry disagreement").when(F.col("l_partkey") % 7 == 4, F.lit(None)).otherwise("x")
    return li.select(F.col("l_orderkey").alias("image"), F.concat(F.lit("pass"), (F.col("l_linenumber") % 3).cast("string")).alias("pass"), F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "A", "error").when(F.col("l_suppkey") % 9 == 0, "running").otherwise("done").alias("state"), error.alias("error"), (F.col("l_suppkey") % 5).alias("priority"), F.col("l_shipdate").alias("enqueued_at"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_shipdate")).alias("not_before"))


def pass_counters_pivot(spark, sf_dir):
    return C.pass_counters(_passes(spark, sf_dir), ["pending", "running", "done", "error"])


def error_taxonomy(spark, sf_dir):
    im = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("format"), F.when(F.col("o_orderkey") % 2 == 0, " RAF ").alias("raw_subtype"))
    return C.error_taxonomy(_passes(spark, sf_dir), im)


def queue_claim(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.claim_order(_passes(spark, sf_dir), _paths(spark, sf_dir), _volumes(spark), t["roots"], ["pass0", "pass2"], F.lit("1998-01-01").cast("timestamp"), 20).select("image", "pass", "priority", "enqueued_at")


def _stale(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.withColumns({"state": F.when(F.col("active"), "active").when(F.col("image") % 10 == 5, "superseded").otherwise("stale"), "stale_since": F.when(F.col("image") % 21 != 0, F.col("verified_at"))})


def orphan_cohorts(spark, sf_dir):
    return C.orphan_cohorts(_stale(spark, sf_dir), _passes(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"))


def prior_versions(spark, sf_dir):
    return C.prior_versions(_stale(spark, sf_dir))


def clock_shift_mode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.select(F.lit(1).alias("size"), F.when(F.col("event_id") % 9 == 0, 2).otherwise(1).alias("old_size"), F.when(F.col("event_id") % 2 == 0, F.lit(7201)).otherwise((F.col("event_id") * 997) % 20000).alias("delta_s"))
    return C.clock_shift(m, e.count())


def scan_reconcile(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, path = F.col("o_orderkey"), F.concat(F.lit("p/"), F.col("o_orderkey").cast("string"))
    stored = o.where("o_orderkey % 10 <> 0").select(path.alias("rel_path"), F.lit(1).alias("size"), k.alias("mtime"), F.concat(F.lit("h"), k.cast("string")).alias("hash"), F.when(k % 6 == 0, "stale").otherwise("active").alias("state"))
    walked = o.where("o_orderkey % 10 <> 1").select(path.alias("rel_path"), F.lit(1).alias("size"), (k + F.when(k % 4 == 0, 1).otherwise(0)).alias("mtime"), F.concat(F.lit("h"), F.when(k % 10 == 0, k + 1).when(k % 8 == 0, -k).otherwise(k).cast("string")).alias("hash"))
    return C.reconcile(stored, walked)


def move_correlation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("image"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("rel_path"), "ts", "event_type")
    return C.correlate_moves(e.where("event_type = 'error'"), e.where("event_type = 'view'"), window=3600)


def folder_tree(spark, sf_dir):
    return C.folder_tree(tables(spark, sf_dir)["paths"])


def folder_keys(spark, sf_dir):
    return C.folder_keys(_paths(spark, sf_dir))


def stage_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return C.stage_rollup(li.select(F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("done"), (F.col("l_quantity") + F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_linenumber"))).alias("total"), F.when(F.col("l_returnflag") == "A", F.col("l_discount")).otherwise(0.0).alias("rate"))).withColumn("eta", F.round("eta", 4))


def latency_histogram(spark, sf_dir):
    return C.latency_histogram(table(spark, sf_dir, "lineitem").select("l_linenumber", F.floor("l_extendedprice").alias("us")), "l_linenumber", "us")


def pair_stacks(spark, sf_dir):
    p = tables(spark, sf_dir)["paths"]
    raw = p.where("image % 3 = 0").select((F.col("image") + 10_000_000).alias("image"), "root", F.regexp_replace("rel_path", "[.]jpg$", ".NEF").alias("rel_path"))
    return C.pair_stacks(p.select("image", "root", "rel_path").union(raw))


def folder_delta(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("revision"), (F.col("event_id") % 777).alias("image"))
    head = log.agg(F.max("revision")).head()[0] or 0
    return C.delta(log, spark.range(0, 777, 2).select(F.col("id").alias("image")), -1, head, 0)[0]


def channel_histogram(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5 % 256).alias("g"), (F.floor("p_retailprice") % 256).alias("b"), (F.col("p_partkey") % 3).alias("a"))
    return C.histogram(p.select(*(F.col(c).cast("int").alias(c) for c in "rgba")), log=True).withColumn("height", F.round("height", 6))


def grid_sort_capture(spark, sf_dir):
    return C.grid_sorted(images(spark, sf_dir), "capture_asc").select("image", "capture_ts")


def file_classes(spark, sf_dir):
    p = tables(spark, sf_dir)["paths"].select("image", F.when(F.col("image") % 5 == 0, F.regexp_replace("rel_path", "jpg", "ARW")).when(F.col("image") % 5 == 1, F.concat(F.lit(".git/"), F.col("rel_path"))).when(F.col("image") % 5 == 2, "a/~$x.gif").otherwise(F.col("rel_path")).alias("p"))
    return p.select("image", C.file_class(F.col("p")).alias("kind"), C.excluded(F.col("p")).alias("excluded"))


def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.retry_state(F.col("event_id") % 5, F.col("event_id") % 13).alias("wait"))


QUERIES = [session_rotate, folder_bursts, asof_scope, interval_link, nearest_onset, ewma_rate, speech_segments, write_debounce, write_immediate, dwell_totals, best_path, availability, offline_burden, display_path, pass_counters_pivot, error_taxonomy, queue_claim, orphan_cohorts, prior_versions, clock_shift_mode, scan_reconcile, move_correlation, folder_tree, folder_keys, stage_rollup, latency_histogram, pair_stacks, folder_delta, channel_histogram, grid_sort_capture, file_classes, retry_delays]

_GAPS = lambda gap, op: f"SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, list_sort(list(event_id)) AS ids FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) {op} {gap}::BIGINT * 1000000 THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, s"
_SPANS = "sp AS (SELECT event_id % 3 AS lane, event_id AS id, epoch_us(ts) AS s, epoch_us(ts) + (value * 1e6::DOUBLE)::BIGINT AS e, user_id % 2 AS gate, event_type FROM events)"
_PATHS = FIXTURE_SQL + """, vol AS (SELECT unnest([0, 1, 2]) AS volume), vols AS (SELECT volume, volume < 2 AS online, volume = 1 AS read_only FROM vol),
p2 AS (SELECT p.*, o_orderdate AS verified_at FROM paths p JOIN orders ON o_orderkey = image), allp AS (SELECT image, volume, root, rel_path, active, verified_at FROM p2 UNION ALL SELECT image, (volume + 1) % 3, root, 'Copy/' || rel_path, image % 7 <> 0, verified_at FROM p2 WHERE image % 3 = 0),
passes AS (SELECT l_orderkey AS image, 'pass' || (l_linenumber % 3) AS pass, CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'A' THEN 'error' WHEN l_suppkey % 9 = 0 THEN 'running' ELSE 'done' END AS state, CASE l_partkey % 7 WHEN 0 THEN 'io' WHEN 1 THEN 'decode' WHEN 2 THEN 'no-worker' WHEN 3 THEN 'geometry' ELSE 'other' END AS category, l_suppkey % 5 AS priority, l_shipdate AS enqueued_at, CASE WHEN l_partkey % 4 = 0 THEN l_shipdate END AS not_before FROM lineitem),
st AS (SELECT *, CASE WHEN active THEN 'active' WHEN image % 10 = 5 THEN 'superseded' ELSE 'stale' END AS state, CASE WHEN image % 21 <> 0 THEN verified_at END AS stale_since FROM allp) """
_ROWS = lambda order, *more: f"r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS i, ts, {', '.join(more)} FROM events)"
_NEXT = "FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1"
_DUE = "least(last + INTERVAL 7200 SECONDS, first + INTERVAL 20000 SECONDS)"
SEGMENTS = f"""WITH RECURSIVE {_ROWS('event_id', 'event_id AS t', 'value / 20 AS p')}, f AS (SELECT user_id, i, CASE WHEN p >= {TUNING.vad_enter} THEN t END AS a, CASE WHEN p >= {TUNING.vad_enter} THEN t END AS b, 0 AS missed, NULL::BIGINT AS oa, NULL::BIGINT AS ob FROM r WHERE i = 1 UNION ALL
      SELECT r.user_id, r.i, CASE WHEN f.a IS NULL THEN CASE WHEN r.p >= {TUNING.vad_enter} THEN r.t END WHEN r.p < {TUNING.vad_exit} AND f.missed = 2 THEN NULL ELSE f.a END,
        CASE WHEN f.a IS NULL AND r.p >= {TUNING.vad_enter} OR f.a IS NOT NULL AND r.p >= {TUNING.vad_exit} THEN r.t ELSE f.b END, CASE WHEN f.a IS NULL OR r.p >= {TUNING.vad_exit} OR f.missed = 2 THEN 0 ELSE f.missed + 1 END,
        CASE WHEN f.a IS NOT NULL AND r.p < {TUNING.vad_exit} AND f.missed = 2 THEN f.a END, CASE WHEN f.a IS NOT NULL AND r.p < {TUNING.vad_exit} AND f.missed = 2 THEN f.b END {_NEXT})"""
WRITES = f"""WITH RECURSIVE {_ROWS('ts', 'event_id')}, f AS (SELECT user_id, i, ts AS first, ts AS last FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, CASE WHEN r.ts > {_DUE} THEN r.ts ELSE first END, r.ts {_NEXT}),
      w AS (SELECT user_id, first, max(last) AS last FROM f GROUP BY 1, 2) SELECT user_id, first, last, {_DUE} AS due FROM w"""
SQL = {
    "ewma_rate": f"""WITH RECURSIVE {_ROWS('ts, event_id * 10 % 70001', 'event_id * 10 % 70001 AS n')}, f AS (SELECT user_id, i, ts, ts AS last_t, n AS last_n, NULL::DOUBLE AS rate FROM r WHERE i = 1 UNION ALL
      SELECT r.user_id, r.i, r.ts, CASE WHEN r.n < f.last_n OR r.ts > f.last_t THEN r.ts ELSE f.last_t END, CASE WHEN r.n < f.last_n OR r.ts > f.last_t THEN r.n ELSE f.last_n END,
        CASE WHEN r.n < f.last_n THEN NULL WHEN r.ts > f.last_t THEN coalesce(f.rate + 0.3 * ((r.n - f.last_n) / ((epoch_us(r.ts) - epoch_us(f.last_t)) / 1e6::DOUBLE) - f.rate), (r.n - f.last_n) / ((epoch_us(r.ts) - epoch_us(f.last_t)) / 1e6::DOUBLE)) ELSE f.rate END {_NEXT}) SELECT user_id, ts, round(rate, 6) AS rate FROM f""",
    "speech_segments": f"""{SEGMENTS}
      SELECT user_id, oa AS start, ob AS "end" FROM f WHERE oa IS NOT NULL UNION ALL SELECT user_id, a, b FROM f WHERE a IS NOT NULL AND (user_id, i) IN (SELECT user_id, max(i) FROM r GROUP BY 1)""",
    "write_debounce": WRITES,
    "write_immediate": f"""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS i, ts, event_type = 'error' AS now FROM events),
      f AS (SELECT user_id, i, ts AS first, ts AS last, now, 1 AS run FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, CASE WHEN f.now OR r.ts > {_DUE} THEN r.ts ELSE first END, r.ts, r.now, run + CASE WHEN f.now OR r.ts > {_DUE} THEN 1 ELSE 0 END {_NEXT}),
      w AS (SELECT user_id, run, min(first) AS first, max(last) AS last, bool_or(now) AS now FROM f GROUP BY 1, 2), d AS (SELECT user_id, first, last, CASE WHEN now THEN last ELSE {_DUE} END AS due FROM w)
      SELECT *, CASE WHEN user_id % 6 >= 1 THEN due + to_seconds(CASE user_id % 6 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 30 ELSE 300 END) END AS retry FROM d""",
    "session_rotate": f"SELECT user_id, start, \"end\", n FROM ({_GAPS(1800, '>=')})",
    "folder_bursts": f"SELECT user_id, start, n, array_to_string(ids, ',') AS members FROM ({_GAPS(3600, '>')}) WHERE n >= 2",
    "asof_scope": """WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts AS pts, event_id AS pid, value FROM events WHERE event_type = 'purchase')
      SELECT v.*, coalesce((SELECT arg_max(value, (pts, pid)) FROM p WHERE p.user_id = v.user_id AND pts <= v.ts), (SELECT arg_min(value, (pts, pid)) FROM p WHERE p.user_id = v.user_id)) AS value,
        NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = v.user_id AND pts <= v.ts) AND EXISTS (SELECT 1 FROM p WHERE p.user_id = v.user_id) AS predated FROM v""",
    "interval_link": f"""WITH {_SPANS}, pr AS (SELECT a.id, b.id AS candidate, least(a.e, b.e) - greatest(a.s, b.s) AS o, a.gate = b.gate AS g FROM sp a JOIN sp b ON a.lane = b.lane AND b.s <= a.e + 10000000 AND b.e >= a.s - 10000000 WHERE a.event_type = 'click' AND b.event_type = 'view')
      SELECT id, arg_max(candidate, (CASE WHEN o > 0 THEN 1 ELSE 0 END, o, candidate)) AS candidate FROM pr WHERE o > 0 OR g GROUP BY id""",
    "nearest_onset": f"WITH {_SPANS} SELECT a.id, arg_min(b.id, (abs(a.s - b.s), b.id)) AS onset FROM sp a JOIN sp b ON a.lane = b.lane AND abs(a.s - b.s) <= 1800000000 WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY a.id",
    "dwell_totals": "SELECT event_id % 200 AS image, sum(least(6000, floor(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END * ms)))::BIGINT AS dwell_ms, count(*) AS episodes, max(ts) AS last_ts FROM (SELECT *, floor(value)::BIGINT * 1000 AS ms FROM events) WHERE ms >= 250 GROUP BY 1",
    "best_path": f"{_PATHS} SELECT image, volume, rel_path, online FROM (SELECT a.image, a.volume, a.rel_path, online, row_number() OVER (PARTITION BY a.image ORDER BY online DESC, CASE WHEN root <> 3 THEN 0 ELSE 1 END, read_only, verified_at DESC, a.volume, a.rel_path) AS r FROM allp a JOIN vols USING (volume) WHERE active) WHERE r = 1",
    "availability": f"{_PATHS} SELECT i.image, CASE WHEN m THEN 'available' WHEN m IS NOT NULL THEN 'offline' ELSE 'missing' END AS availability FROM images i LEFT JOIN (SELECT image, bool_or(online) AS m FROM allp JOIN vols USING (volume) WHERE active GROUP BY 1) x USING (image)",
    "offline_burden": f"{_PATHS} SELECT volume, count(DISTINCT image) AS images FROM allp JOIN vols USING (volume) WHERE active AND NOT online AND image NOT IN (SELECT image FROM allp JOIN vols USING (volume) WHERE active AND online) GROUP BY 1",
    "display_path": f"{_PATHS} SELECT image, arg_min(rel_path, (NOT active, NOT online, rel_path)) AS rel_path FROM allp JOIN vols USING (volume) GROUP BY 1",
    "pass_counters_pivot": f"{_PATHS} SELECT pass, {', '.join(f'''count(*) FILTER (WHERE state = '{s}') AS {s}''' for s in ('pending', 'running', 'done', 'error'))} FROM passes GROUP BY 1",
    "error_taxonomy": f"{_PATHS} SELECT pass, category, CASE WHEN regexp_full_match(lower(trim(o_orderpriority)), '[a-z0-9._-]{{1,32}}') THEN lower(trim(o_orderpriority)) ELSE 'other' END AS format, CASE WHEN o_orderkey % 2 = 0 THEN 'raf' END AS raw_subtype, count(*) AS n FROM passes JOIN orders ON o_orderkey = image WHERE state = 'error' GROUP BY ALL",
    "queue_claim": f"{_PATHS} SELECT image, pass, priority, enqueued_at FROM passes WHERE state = 'pending' AND pass IN ('pass0', 'pass2') AND (not_before IS NULL OR not_before <= '1998-01-01') AND image IN (SELECT image FROM allp WHERE active AND volume < 2 AND root <> 3) ORDER BY priority, enqueued_at, image, pass LIMIT 20",
    "orphan_cohorts": f"{_PATHS} SELECT image, CASE WHEN bool_or(stale_since IS NULL) THEN 'unknown' WHEN image IN (SELECT image FROM passes WHERE state = 'running') THEN 'busy' WHEN max(stale_since) <= '1996-01-01' THEN 'eligible' ELSE 'recent' END AS cohort FROM st WHERE state = 'stale' AND image NOT IN (SELECT image FROM st WHERE state = 'active') GROUP BY image",
    "prior_versions": f"{_PATHS} SELECT volume, rel_path, image, max(stale_since) AS last_seen FROM st WHERE state = 'superseded' GROUP BY ALL",
    "clock_shift_mode": "SELECT hours, n FROM (SELECT floor((d + 1800) / 3600)::BIGINT AS hours, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 7201 ELSE (event_id * 997) % 20000 END AS d FROM events WHERE event_id % 9 <> 0) WHERE floor((d + 1800) / 3600) <> 0 AND abs(d - floor((d + 1800) / 3600) * 3600) <= 2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) WHERE n * 4 > (SELECT count(*) FROM events)",
    "scan_reconcile": """SELECT 'p/' || k AS rel_path, CASE WHEN k % 10 = 1 THEN CASE WHEN k % 6 = 0 THEN 'absent' ELSE 'stale' END WHEN k % 10 = 0 THEN CASE WHEN k + 1 IN (SELECT o_orderkey FROM orders) AND (k + 1) % 6 <> 0 THEN 'moved' ELSE 'new' END
      WHEN k % 6 <> 0 AND k % 4 <> 0 THEN 'unchanged' WHEN k % 8 <> 0 THEN CASE WHEN k % 6 = 0 THEN 'relinked' ELSE 'updated' END ELSE 'superseded' END AS change,
      CASE WHEN k % 10 <> 1 THEN 'h' || CASE WHEN k % 10 = 0 THEN k + 1 WHEN k % 8 = 0 THEN -k ELSE k END END AS hash, CASE WHEN k % 10 <> 0 THEN 'h' || k END AS old_hash FROM (SELECT o_orderkey AS k FROM orders)""",
    "move_correlation": "SELECT a.event_id % 4 AS image, 'f' || a.event_id AS old_path, 'f' || b.event_id AS new_path FROM events a JOIN events b ON a.event_id % 4 = b.event_id % 4 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600::BIGINT * 1000000 WHERE a.event_type = 'error' AND b.event_type = 'view'",
    "folder_tree": f"{FIXTURE_SQL} SELECT DISTINCT root, array_to_string(string_split(rel_path, '/')[1:n], '/') AS folder FROM paths, (VALUES (1), (2), (3)) v(n) WHERE active AND n < len(string_split(rel_path, '/'))",
    "folder_keys": f"{_PATHS} SELECT image, arg_min(root, (rel_path, root)) || '/' || regexp_replace(min(rel_path), '/[^/]*$', '') AS folder FROM allp WHERE active GROUP BY image",
    "stage_rollup": "SELECT stage, done, total, rate, greatest(total - done, 0) AS remaining, CASE WHEN total - done <= 0 THEN 'done' WHEN rate > 0 THEN 'working' ELSE 'pending' END AS state, CASE WHEN total - done > 0 AND rate > 0 THEN round((total - done) / rate, 4) END AS eta FROM (SELECT l_returnflag AS stage, sum(l_quantity) AS done, sum(l_quantity + CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END) AS total, max(CASE WHEN l_returnflag = 'A' THEN l_discount ELSE 0 END) AS rate FROM lineitem GROUP BY 1)",
    "latency_histogram": "WITH b AS (SELECT l_linenumber, CASE WHEN us <= 1 THEN 0 ELSE ceil(log2(us)) END AS b, us FROM (SELECT l_linenumber, floor(l_extendedprice) AS us FROM lineitem)), c AS (SELECT l_linenumber, b, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY l_linenumber ORDER BY b) AS up, sum(n) OVER (PARTITION BY l_linenumber) AS al FROM c) SELECT l_linenumber, any_value(al)::BIGINT AS count, (SELECT sum(us) / 1000 FROM b WHERE b.l_linenumber = r.l_linenumber) AS total_ms, " + ", ".join(f"min(CASE WHEN up >= ceil(al * {q} / 100) THEN pow(2, b) / 1000 END) AS p{q}_ms" for q in (50, 95, 99)) + ", (SELECT max(us) / 1000 FROM b WHERE b.l_linenumber = r.l_linenumber) AS max_ms FROM r GROUP BY l_linenumber",
    "pair_stacks": f"{FIXTURE_SQL} SELECT root, regexp_replace(rel_path, '/[^/]*$', '') AS folder, 'img_' || image AS base, image AS \"primary\", CASE WHEN image % 3 = 0 THEN image + 10000000 END AS alt FROM paths",
    "folder_delta": "SELECT DISTINCT event_id % 777 AS image, CASE WHEN event_id % 777 % 2 = 0 THEN 'upsert' ELSE 'removed' END AS change FROM events",
    "channel_histogram": "WITH p AS (SELECT (p_partkey % 256)::INT AS r, (p_size * 5 % 256)::INT AS g, (floor(p_retailprice)::BIGINT % 256)::INT AS b FROM part WHERE p_partkey % 3 > 0), q AS (SELECT 'r' AS channel, r AS bin FROM p UNION ALL SELECT 'g', g FROM p UNION ALL SELECT 'b', b FROM p UNION ALL SELECT 'luma', round(r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE)::INT FROM p), c AS (SELECT channel, bin, count(*) AS n FROM q GROUP BY ALL) SELECT *, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY channel)), 6) AS height FROM c",
    "grid_sort_capture": f"{FIXTURE_SQL} SELECT image, capture_ts FROM images ORDER BY capture_ts NULLS LAST, image",
    "file_classes": "SELECT o_orderkey AS image, CASE o_orderkey % 5 WHEN 0 THEN 'raw' WHEN 2 THEN NULL ELSE 'image' END AS kind, o_orderkey % 5 IN (1, 2) AS excluded FROM orders",
    "retry_delays": "SELECT event_id, CASE WHEN event_id % 5 >= 3 OR event_id % 13 >= 10 THEN NULL WHEN event_id % 5 <= 1 THEN 60 ELSE 600 END AS wait FROM events",
}
