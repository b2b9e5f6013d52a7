"""Folds of the append-only annotation journal into its current state.

A journal has the columns of ``model.JOURNAL``: the integer ``id`` is the log's order, ``ts``
only testimony. Every fold is a pure function of the journal; nothing is maintained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CONTENT_KINDS, LEGAL_TARGETS, valid_event
from ..storage import written

#: Pointer jumping doubles what it spans; no chain is longer than two to this power.
MOST_JUMPS = 48


def retracted(journal: DataFrame) -> DataFrame:
    """(id) of events that a retraction names."""
    return journal.where((F.col("kind") == "retraction") & F.col("target_event").isNotNull()).select(F.col("target_event").alias("id")).distinct()


def live(journal: DataFrame) -> DataFrame:
    """Events that no retraction names."""
    return journal.join(retracted(journal), "id", "left_anti")


def revision_roots(journal: DataFrame) -> DataFrame:
    """(id, root) of revisions whose chain reaches an event that is no revision.

    Chains that end in a missing event or run in a circle have no root. Each round doubles the
    span of every open pointer, so rounds grow with the logarithm of the longest chain; what
    is still open when nothing new closes is a circle.
    """
    ends = journal.where(F.col("kind") != "revision").select(F.col("id").alias("end"))
    steps = journal.where((F.col("kind") == "revision") & F.col("target_event").isNotNull()).select("id", F.col("target_event").alias("to"))
    closed = steps.join(ends, F.col("to") == F.col("end"), "left_semi").select("id", F.col("to").alias("root"))
    open_ = steps.join(ends, F.col("to") == F.col("end"), "left_anti")
    closed, open_ = written(closed, "closed"), written(open_, "open")
    for _ in range(MOST_JUMPS):
        ahead = open_.select(F.col("id").alias("via"), F.col("to").alias("further"))
        done = closed.select(F.col("id").alias("via"), "root")
        hop = open_.join(done, F.col("to") == done["via"], "left").drop("via").join(ahead, F.col("to") == ahead["via"], "left").drop("via")
        hop = written(hop, "hop")
        found = hop.where(F.col("root").isNotNull()).select("id", "root")
        rest = hop.where(F.col("root").isNull() & F.col("further").isNotNull()).select("id", F.col("further").alias("to"))
        n_found, n_rest = hop.agg(F.count("root"), F.count_if(F.col("root").isNull() & F.col("further").isNotNull())).head()
        closed = closed.unionByName(found)  # of written tables, one a round
        if not n_found or not n_rest:
            break  # a longer chain would hold one that closes now: what is left runs in circles
        open_ = rest
    return closed


def effective_texts(journal: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(id, text, corrected) of every remark: the text of its newest live unscrubbed revision, else its own."""
    roots = revision_roots(journal) if roots is None else roots
    usable = live(journal).where((F.col("kind") == "revision") & ~F.col("scrubbed") & F.col("text").isNotNull()).select("id", "text")
    newest = usable.join(roots, "id").groupBy("root").agg(F.max(F.struct("id", "text")).alias("r")).select(F.col("root").alias("id"), F.col("r.text").alias("revised"))
    remarks = journal.where(F.col("kind") == "remark").select("id", F.when(~F.col("scrubbed"), F.col("text")).alias("own"))
    joined = remarks.join(newest, "id", "left")
    return joined.select("id", F.coalesce("revised", "own").alias("text"), F.col("revised").isNotNull().alias("corrected"))


def effective_targets(journal: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(id, image): own image of content events; meta events answer through what they point at, or not at all."""
    roots = revision_roots(journal) if roots is None else roots
    own = journal.where(F.col("kind").isin(*CONTENT_KINDS)).select("id", "image")
    revised = roots.join(own.select(F.col("id").alias("root"), "image"), "root").select("id", "image")
    answered = own.union(revised)
    others = journal.where(F.col("kind").isin("retraction", "redaction") & F.col("target_event").isNotNull()).select("id", F.col("target_event").alias("to"))
    through = others.join(answered.select(F.col("id").alias("to"), "image"), "to").select("id", "image")
    return answered.union(through).where(F.col("image").isNotNull())


def entries(journal: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Live content events as the journal shows them: (id, ts, entry, source, image, text, corrected, rating).

    ``entry`` is the kind, or ``redacted`` for the stub of a scrubbed remark or stroke.
    """
    texts = effective_texts(journal, roots).select("id", F.col("text").alias("shown"), "corrected")
    content = live(journal).where(F.col("kind").isin(*CONTENT_KINDS)).join(texts, "id", "left")
    stub = F.col("scrubbed") & F.col("kind").isin("remark", "stroke")
    is_remark = (F.col("kind") == "remark") & ~stub
    shown = content.where(stub | (F.col("kind") == "stroke") | (is_remark & F.col("shown").isNotNull()) | ((F.col("kind") == "rating") & F.col("rating").isNotNull()))
    return shown.select(
        "id", "ts", F.when(stub, "redacted").otherwise(F.col("kind")).alias("entry"), "source",
        F.when(~stub, F.col("image")).alias("image"), F.when(is_remark, F.col("shown")).alias("text"),
        F.coalesce(F.when(is_remark, F.col("corrected")), F.lit(False)).alias("corrected"), F.when(F.col("kind") == "rating", F.col("rating")).alias("rating"),
    )


def image_stats(journal: DataFrame) -> DataFrame:
    """Per image over live content events; ``last_ts`` is that of the greatest id, not the latest."""
    clean = ~F.col("scrubbed")
    return (
        live(journal).where(F.col("kind").isin(*CONTENT_KINDS) & F.col("image").isNotNull())
        .groupBy("image")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.max((F.col("kind") == "remark") & clean).alias("has_text"),
            F.max((F.col("kind") == "stroke") & clean).alias("has_strokes"),
            F.count_if((F.col("kind") == "stroke") & clean).alias("stroke_count"),
            F.max_by("ts", "id").alias("last_ts"),
        )
    )


def current_ratings(journal: DataFrame) -> DataFrame:
    """(image, rating, event_id, ts) by the greatest live, unscrubbed rating event."""
    rated = live(journal).where((F.col("kind") == "rating") & ~F.col("scrubbed") & F.col("rating").isNotNull() & F.col("image").isNotNull())
    return rated.groupBy("image").agg(F.max(F.struct("id", "rating", "ts")).alias("w")).select("image", F.col("w.rating").alias("rating"), F.col("w.id").alias("event_id"), F.col("w.ts").alias("ts"))


def redaction_registry(journal: DataFrame) -> DataFrame:
    """(target, redaction): the smallest redaction event of each target."""
    return journal.where((F.col("kind") == "redaction") & F.col("target_event").isNotNull()).groupBy(F.col("target_event").alias("target")).agg(F.min("id").alias("redaction"))


def scrub(journal: DataFrame, registry: DataFrame) -> DataFrame:
    """Content of registered targets becomes null; the rows stay as stubs."""
    named = registry.select(F.col("target").alias("id")).distinct().withColumn("__named", F.lit(True))
    out = journal.join(named, "id", "left").withColumn("scrubbed", F.coalesce("__named", F.lit(False)) | F.col("scrubbed")).drop("__named")
    return out.withColumns({"text": F.when(~F.col("scrubbed"), F.col("text")), "rating": F.when(~F.col("scrubbed") | (F.col("kind") == "rating"), F.col("rating"))})


def redact(journal: DataFrame, targets: DataFrame, first_id: int, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Redact remarks, revisions and strokes (id): (new redaction events, targets refused with the reason).

    A remark's or revision's whole chain is redacted, a stroke alone; members scrubbed before need no event.
    New events are numbered from ``first_id`` in the order of their targets.
    """
    roots = revision_roots(journal) if roots is None else roots
    asked = targets.select("id").distinct().join(journal.select("id", "kind", "scrubbed"), "id", "left")
    why = F.when(F.col("kind").isNull(), "missing").when(~F.col("kind").isin(*LEGAL_TARGETS["redaction"]), "kind").when(F.col("scrubbed"), "scrubbed")
    refused = asked.select("id", why.alias("reason")).where(F.col("reason").isNotNull())
    good = asked.where(why.isNull())
    head = good.join(roots, "id", "left").select(F.coalesce("root", "id").alias("root")).distinct()
    members = head.select(F.col("root").alias("id")).union(roots.join(head, "root", "left_semi").select("id")).distinct()
    fresh = members.join(journal.where(~F.col("scrubbed")).select("id", "session"), "id")
    numbered = dense_number(fresh, "id", "n")
    events = numbered.select(
        (F.col("n") + first_id).alias("id"), F.lit(None).cast("timestamp").alias("ts"), "session", F.lit("redaction").alias("kind"), F.lit("system").alias("source"),
        F.col("id").alias("target_event"), F.lit(None).cast("long").alias("image"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("rating"), F.lit(False).alias("scrubbed"),
    )
    return events, refused


def dense_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """0, 1, 2, ... in the order of ``key``: ranges are sorted apart, and each starts after the rows before it."""
    spread = written(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("c"), F.min("__at").alias("__from")).collect()  # a row a partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before[r["__part"]] = total - r["__from"]
        total += r["c"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    shift = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return spread.withColumn(name, F.col("__at") + F.element_at(shift, F.col("__part"))).drop("__part", "__at")


def merge_events(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge a second journal: (merged journal, quarantined arrivals with the reason).

    The result is a set by id and does not depend on the order of arrival: invalid rows and
    illegal targets are set aside, redactions scrub what they name on both sides, a scrubbed
    copy replaces an unscrubbed one, and otherwise the row that is there stays.
    """
    arriving = theirs.withColumn("__ok", valid_event())
    invalid = arriving.where(~F.col("__ok")).select("id", F.lit("invalid").alias("reason"))
    good = arriving.where("__ok").drop("__ok")
    ranked = good.groupBy("id").agg(F.max_by(F.struct(*good.columns), F.struct(F.col("scrubbed"), (-F.xxhash64(*good.columns)).alias("h"))).alias("r")).select("r.*")
    kinds = ours.select("id", "kind").union(ranked.select("id", "kind")).groupBy("id").agg(F.first("kind").alias("target_kind")).withColumnRenamed("id", "target_event")
    # rows without a target are legal, and as many as they are they would all meet in one task
    aimed = ranked.where(F.col("target_event").isNotNull())
    checked = aimed.join(kinds, "target_event", "left")
    legal = F.lit(True)
    for kind, targets in LEGAL_TARGETS.items():
        legal = F.when(F.col("kind") == kind, F.col("target_kind").isNull() | F.col("target_kind").isin(*targets)).otherwise(legal)
    bad_target = checked.where(~legal).select("id", F.lit("target").alias("reason"))
    kept = checked.where(legal).select(ours.columns).unionByName(ranked.where(F.col("target_event").isNull()).select(ours.columns))
    both = ours.withColumn("__own", F.lit(True)).unionByName(kept.withColumn("__own", F.lit(False)))
    one = both.groupBy("id").agg(F.max_by(F.struct(*ours.columns), F.struct("scrubbed", "__own")).alias("r")).select("r.*")
    return scrub(one, redaction_registry(one)), invalid.unionByName(bad_target)


def merge_sessions(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Sessions (session, started, ended) of both: the later end wins; ``mismatch`` where the starts differ."""
    both = ours.unionByName(theirs)
    return both.groupBy("session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), (F.min("started") != F.max("started")).alias("mismatch"))


def reverse_links(journal: DataFrame, linked: str = "linked_event") -> DataFrame:
    """(id, linked_by): the first event that links to each event."""
    return journal.where(F.col(linked).isNotNull()).groupBy(F.col(linked).alias("id")).agg(F.min("id").alias("linked_by"))


def resolve_links(journal: DataFrame, linked: str = "linked_event") -> DataFrame:
    """Remarks with the stroke linked to them either way: their own link if it names a live stroke, else the first live stroke linking back."""
    strokes = live(journal).where(F.col("kind") == "stroke")
    forward = strokes.select(F.col("id").alias("__f"))
    back = strokes.where(F.col(linked).isNotNull()).groupBy(F.col(linked).alias("__r")).agg(F.min("id").alias("back"))
    remarks = live(journal).where(F.col("kind") == "remark")
    return remarks.join(forward, F.col(linked) == F.col("__f"), "left").join(back, F.col("id") == F.col("__r"), "left").select("id", F.coalesce("__f", "back").alias("stroke")).where(F.col("stroke").isNotNull())


def drain_order(dirty: DataFrame) -> DataFrame:
    """A dirty queue (image, reason, since) in the order it is drained: redactions first, then the oldest."""
    return dirty.orderBy(F.when(F.col("reason") == "redaction", 0).otherwise(1), F.col("since").asc_nulls_last(), "image")


def acknowledge(dirty: DataFrame, seen: DataFrame) -> DataFrame:
    """What stays of a dirty queue when (image, observed) are done: rows marked again later stay."""
    done = seen.groupBy("image").agg(F.max("observed").alias("observed"))
    return dirty.join(done, "image", "left").where(F.col("observed").isNull() | (F.col("since") > F.col("observed"))).drop("observed")


def session_groups(journal: DataFrame) -> DataFrame:
    """Journal rows with their session's last id and number of retracted rows; newest session first, rows ascending."""
    dead = retracted(journal).withColumn("retracted", F.lit(True))
    rows = journal.where(F.col("kind").isin(*CONTENT_KINDS)).join(dead, "id", "left").withColumn("retracted", F.coalesce("retracted", F.lit(False)))
    heads = rows.groupBy("session").agg(F.max("id").alias("session_last"), F.count_if("retracted").alias("session_retracted"))
    return rows.join(heads, "session").select("session", "id", "kind", "retracted", "session_last", "session_retracted")
