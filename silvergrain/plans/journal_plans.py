"""Queries over the journal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journal as J
from .fixtures import journal, with_journal


def live_events(spark, sf_dir):
    return J.live(journal(spark, sf_dir)).select("id", "kind", "session")


def revision_roots(spark, sf_dir):
    return J.revision_roots(journal(spark, sf_dir))


def journal_effective_text(spark, sf_dir):
    return J.effective_texts(journal(spark, sf_dir))


def journal_effective_targets(spark, sf_dir):
    return J.effective_targets(journal(spark, sf_dir))


def journal_entries(spark, sf_dir):
    return J.entries(journal(spark, sf_dir))


def journal_stats(spark, sf_dir):
    return J.image_stats(journal(spark, sf_dir))


def current_rating(spark, sf_dir):
    return J.current_ratings(journal(spark, sf_dir))


def _redactions(spark, sf_dir):
    """Every retraction of the fixture taken as a redaction."""
    return journal(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "retraction", "redaction").otherwise(F.col("kind")))


def redaction_registry(spark, sf_dir):
    return J.redaction_registry(_redactions(spark, sf_dir))


def scrubbed_journal(spark, sf_dir):
    j = _redactions(spark, sf_dir)
    return J.scrub(j, J.redaction_registry(j)).select("id", "scrubbed", "text", "rating")


def redaction_cascade(spark, sf_dir):
    j = journal(spark, sf_dir)
    events, _ = J.redact(j, j.where("id % 50 = 3").select("id"), first_id=10_000_000)
    return events.select("id", "target_event")


def redaction_refused(spark, sf_dir):
    j = journal(spark, sf_dir)
    return J.redact(j, j.where("id % 50 = 3").select("id").union(spark.range(-3, 0)), first_id=10_000_000)[1]


def merge_events_idempotent(spark, sf_dir):
    j = journal(spark, sf_dir)
    merged, _ = J.merge_events(j.where("id % 3 <> 0"), j.where("id % 3 <> 1"))
    return merged.select("id", "kind", "text", "scrubbed")


def merge_events_quarantine(spark, sf_dir):
    j = journal(spark, sf_dir)
    bad = j.where("id % 3 <> 1").withColumns({"rating": F.when(F.col("id") % 7 == 0, 9).otherwise(F.col("rating")), "target_event": F.when((F.col("kind") == "revision") & (F.col("id") % 5 == 0), F.col("id")).otherwise(F.col("target_event"))})
    bad = bad.withColumn("kind", F.when((F.col("kind") == "retraction") & (F.col("id") % 11 == 0), "redaction").otherwise(F.col("kind")))
    return J.merge_events(j.where("id % 3 <> 0"), bad)[1]


def merge_sessions(spark, sf_dir):
    s = lambda df: df.groupBy("session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    j = journal(spark, sf_dir)
    return J.merge_sessions(s(j.where("id % 2 = 0")), s(j.where("id % 2 = 1")))


def _linked(spark, sf_dir):
    """Strokes and remarks link to the event five before them."""
    return journal(spark, sf_dir).withColumn("linked_event", F.when(F.col("kind").isin("remark", "stroke"), F.col("id") - 5))


def reverse_links(spark, sf_dir):
    return J.reverse_links(_linked(spark, sf_dir))


def resolved_links(spark, sf_dir):
    return J.resolve_links(_linked(spark, sf_dir))


def _dirty(spark, sf_dir):
    return journal(spark, sf_dir).where("image IS NOT NULL").groupBy("image").agg(F.max(F.when(F.col("scrubbed"), "redaction").otherwise("edit")).alias("reason"), F.max("ts").alias("since"))


def dirty_drain(spark, sf_dir):
    return J.drain_order(_dirty(spark, sf_dir))


def dirty_acknowledged(spark, sf_dir):
    seen = journal(spark, sf_dir).where("image IS NOT NULL AND id % 4 <> 0").groupBy("image").agg(F.max("ts").alias("observed"))
    return J.acknowledge(_dirty(spark, sf_dir), seen)


def session_groups(spark, sf_dir):
    return J.session_groups(journal(spark, sf_dir))


QUERIES = [live_events, revision_roots, journal_effective_text, journal_effective_targets, journal_entries, journal_stats, current_rating, redaction_registry, scrubbed_journal, redaction_cascade, redaction_refused, merge_events_idempotent, merge_events_quarantine, merge_sessions, reverse_links, resolved_links, dirty_drain, dirty_acknowledged, session_groups]

_DIRTY = "dirty AS (SELECT image, max(CASE WHEN scrubbed THEN 'redaction' ELSE 'edit' END) AS reason, max(ts) AS since FROM journal WHERE image IS NOT NULL GROUP BY image)"
_CASCADE = """asked AS (SELECT id, kind, scrubbed FROM journal WHERE id % 50 = 3),
good AS (SELECT id FROM asked WHERE kind IN ('remark', 'revision', 'stroke') AND NOT scrubbed),
heads AS (SELECT DISTINCT coalesce(r.root, g.id) AS root FROM good g LEFT JOIN roots r ON r.id = g.id),
members AS (SELECT root AS id FROM heads UNION SELECT r.id FROM roots r JOIN heads h ON h.root = r.root)"""
_LINKED = "linked AS (SELECT *, CASE WHEN kind IN ('remark', 'stroke') THEN id - 5 END AS linked_event, id NOT IN (SELECT id FROM dead) AS is_live FROM journal)"
SQL = {
    "live_events": with_journal("SELECT id, kind, session FROM alive"),
    "revision_roots": with_journal("SELECT id, root FROM roots"),
    "journal_effective_text": with_journal("SELECT * FROM effective"),
    "journal_effective_targets": with_journal("""SELECT id, image FROM answered UNION ALL SELECT j.id, a.image FROM journal j JOIN answered a ON a.id = j.target_event WHERE j.kind = 'retraction'""",
        "answered AS (SELECT id, image FROM journal WHERE image IS NOT NULL UNION ALL SELECT r.id, j.image FROM roots r JOIN journal j ON j.id = r.root WHERE j.image IS NOT NULL)"),
    "journal_entries": with_journal("""SELECT a.id, ts, CASE WHEN scrubbed THEN 'redacted' ELSE kind END AS entry, source, CASE WHEN NOT scrubbed THEN image END AS image, CASE WHEN kind = 'remark' AND NOT scrubbed THEN e.text END AS text,
        kind = 'remark' AND NOT scrubbed AND coalesce(e.corrected, false) AS corrected, rating FROM alive a LEFT JOIN effective e ON e.id = a.id
        WHERE kind IN ('rating', 'stroke') OR (kind = 'remark' AND (scrubbed OR e.text IS NOT NULL))"""),
    "journal_stats": with_journal("SELECT * FROM stats"),
    "current_rating": with_journal("SELECT * FROM ratings"),
    "redaction_registry": with_journal("SELECT target_event AS target, min(id) AS redaction FROM journal WHERE kind = 'retraction' AND target_event IS NOT NULL GROUP BY 1"),
    "scrubbed_journal": with_journal("SELECT id, s AS scrubbed, CASE WHEN NOT s THEN text END AS text, CASE WHEN NOT s OR kind = 'rating' THEN rating END AS rating FROM (SELECT *, scrubbed OR id IN (SELECT id FROM dead) AS s FROM journal)"),
    "redaction_cascade": with_journal("SELECT 10000000 + row_number() OVER (ORDER BY m.id) - 1 AS id, m.id AS target_event FROM members m JOIN journal j ON j.id = m.id WHERE NOT j.scrubbed", _CASCADE),
    "redaction_refused": with_journal("SELECT * FROM (SELECT id, CASE WHEN kind NOT IN ('remark', 'revision', 'stroke') THEN 'kind' WHEN scrubbed THEN 'scrubbed' END AS reason FROM asked UNION ALL SELECT unnest([-3, -2, -1]), 'missing') WHERE reason IS NOT NULL", _CASCADE),
    "merge_events_idempotent": with_journal("SELECT id, kind, CASE WHEN NOT scrubbed THEN text END AS text, scrubbed FROM journal"),
    "merge_events_quarantine": with_journal("""SELECT id, 'invalid' AS reason FROM bad WHERE kind = 'rating' AND NOT rating BETWEEN 0 AND 5
        UNION ALL SELECT b.id, 'target' FROM bad b JOIN allof t ON t.id = b.target_event WHERE b.kind = 'redaction' AND t.kind NOT IN ('remark', 'revision', 'stroke')""",
        "bad AS (SELECT id, CASE WHEN kind = 'retraction' AND id % 11 = 0 THEN 'redaction' ELSE kind END AS kind, CASE WHEN id % 7 = 0 THEN 9 ELSE rating END AS rating, target_event FROM journal WHERE id % 3 <> 1), allof AS (SELECT id, kind FROM journal WHERE id % 3 <> 0 UNION SELECT id, kind FROM bad)"),
    "merge_sessions": with_journal("SELECT session, min(s) AS started, max(e) AS ended, min(s) <> max(s) AS mismatch FROM (SELECT session, min(ts) AS s, max(ts) AS e FROM journal GROUP BY session, id % 2) GROUP BY session"),
    "reverse_links": with_journal("SELECT linked_event AS id, min(id) AS linked_by FROM linked WHERE linked_event IS NOT NULL GROUP BY 1", _LINKED),
    "resolved_links": with_journal("""SELECT r.id, coalesce(f.id, (SELECT min(s.id) FROM linked s WHERE s.kind = 'stroke' AND s.is_live AND s.linked_event = r.id)) AS stroke
        FROM linked r LEFT JOIN linked f ON f.id = r.linked_event AND f.kind = 'stroke' AND f.is_live WHERE r.kind = 'remark' AND r.is_live QUALIFY stroke IS NOT NULL""".replace("QUALIFY stroke IS NOT NULL", ""), _LINKED),
    "dirty_drain": with_journal("SELECT * FROM dirty ORDER BY CASE WHEN reason = 'redaction' THEN 0 ELSE 1 END, since, image", _DIRTY),
    "dirty_acknowledged": with_journal("SELECT d.* FROM dirty d LEFT JOIN (SELECT image, max(ts) AS observed FROM journal WHERE image IS NOT NULL AND id % 4 <> 0 GROUP BY 1) s USING (image) WHERE observed IS NULL OR since > observed", _DIRTY),
    "session_groups": with_journal("SELECT session, id, kind, id IN (SELECT id FROM dead) AS retracted, max(id) OVER (PARTITION BY session) AS session_last, count(*) FILTER (WHERE id IN (SELECT id FROM dead)) OVER (PARTITION BY session) AS session_retracted FROM journal WHERE kind IN ('remark', 'rating', 'stroke')"),
}
SQL["resolved_links"] = f"SELECT * FROM ({SQL['resolved_links']}) WHERE stroke IS NOT NULL"
