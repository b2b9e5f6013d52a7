"""How the driver's tables stand for journals, catalogs, sessions and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = {"view": "remark", "click": "stroke", "purchase": "rating", "signup": "revision", "error": "retraction"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an annotation journal."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("event_type"))
    e = e.withColumn("kind", kind)
    before = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    text_id = F.when(F.col("kind").isin("remark", "revision"), F.col("event_id"))
    meta = F.col("kind").isin("revision", "retraction")
    source = F.when(F.col("kind") == "remark", F.when(F.col("event_id") % 2 == 0, "typed").otherwise("voice")).when(F.col("kind") == "stroke", "pencil").when(F.col("kind") == "retraction", "system").otherwise("typed")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("session"), "kind", source.alias("source"),
        F.when(meta, F.last(text_id, ignorenulls=True).over(before)).alias("target_event"),
        F.when(~meta, F.col("event_id") % 500).alias("image"),
        F.when(F.col("kind").isin("remark", "revision"), F.concat(F.lit("note "), F.col("event_id").cast("string"), F.lit(" "), F.get_json_object("props", "$.k"))).alias("text"),
        F.when(F.col("kind") == "rating", (F.floor("value") % 6).cast("int")).alias("rating"),
        ((F.col("event_id") % 97 == 0) & F.col("kind").isin("remark", "revision", "stroke")).alias("scrubbed"),
    )


#: The same journal in SQL, as common table expressions ``k`` and ``journal``.
JOURNAL_SQL = """
k AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'remark' WHEN 'click' THEN 'stroke' WHEN 'purchase' THEN 'rating' WHEN 'signup' THEN 'revision' WHEN 'error' THEN 'retraction' END AS kind FROM events
), journal AS (
  SELECT event_id AS id, ts, user_id AS session, kind,
    CASE WHEN kind = 'remark' THEN CASE WHEN event_id % 2 = 0 THEN 'typed' ELSE 'voice' END WHEN kind = 'stroke' THEN 'pencil' WHEN kind = 'retraction' THEN 'system' ELSE 'typed' END AS source,
    CASE WHEN kind IN ('revision', 'retraction') THEN max(CASE WHEN kind IN ('remark', 'revision') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target_event,
    CASE WHEN kind NOT IN ('revision', 'retraction') THEN event_id % 500 END AS image,
    CASE WHEN kind IN ('remark', 'revision') THEN 'note ' || event_id || ' ' || json_extract_string(props, '$.k') END AS text,
    CASE WHEN kind = 'rating' THEN (floor(value)::BIGINT % 6)::INTEGER END AS rating,
    event_id % 97 = 0 AND kind IN ('remark', 'revision', 'stroke') AS scrubbed
  FROM k
), dead AS (
  SELECT DISTINCT target_event AS id FROM journal WHERE kind = 'retraction' AND target_event IS NOT NULL
), alive AS (
  SELECT * FROM journal WHERE id NOT IN (SELECT id FROM dead)
), chain(id, node, nkind) AS (
  SELECT r.id, t.id, t.kind FROM journal r JOIN journal t ON t.id = r.target_event WHERE r.kind = 'revision'
  UNION
  SELECT c.id, t.id, t.kind FROM chain c JOIN journal m ON m.id = c.node JOIN journal t ON t.id = m.target_event WHERE c.nkind = 'revision'
), roots AS (
  SELECT id, node AS root FROM chain WHERE nkind <> 'revision'
), revised AS (
  SELECT r.root AS id, arg_max(a.text, a.id) AS text FROM alive a JOIN roots r ON r.id = a.id WHERE a.kind = 'revision' AND NOT a.scrubbed GROUP BY r.root
), effective AS (
  SELECT j.id, coalesce(v.text, CASE WHEN NOT j.scrubbed THEN j.text END) AS text, v.text IS NOT NULL AS corrected FROM journal j LEFT JOIN revised v ON v.id = j.id WHERE j.kind = 'remark'
), stats AS (
  SELECT image, count(*) AS event_count, bool_or(kind = 'remark' AND NOT scrubbed) AS has_text, bool_or(kind = 'stroke' AND NOT scrubbed) AS has_strokes,
    count(*) FILTER (WHERE kind = 'stroke' AND NOT scrubbed) AS stroke_count, arg_max(ts, id) AS last_ts
  FROM alive WHERE kind IN ('remark', 'rating', 'stroke') GROUP BY image
), ratings AS (
  SELECT image, arg_max(rating, id) AS rating, max(id) AS event_id, arg_max(ts, id) AS ts FROM alive WHERE kind = 'rating' AND NOT scrubbed GROUP BY image
)
"""


def with_journal(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {JOURNAL_SQL}{', ' + more if more else ''} {select}"
