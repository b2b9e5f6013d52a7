"""Topics: affinity, suggestions, attention, collection candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..model import TUNING, Tuning

MOST_SUGGESTIONS = 24
LEAST_IMAGES = 3
MOST_MEMBERS = 500
#: Affinities at or below this are none.
FLOOR = 1e-4


def affinity(visual: DataFrame, annotation: DataFrame, scope: DataFrame, alpha: float = TUNING.alpha) -> DataFrame:
    """(image, affinity) of the whole scope, best first: a blend of two scores; a missing one is 0."""
    a = min(1.0, max(0.0, alpha))
    joined = scope.select("image").distinct().join(visual.select("image", F.col("score").alias("v")), "image", "left").join(annotation.select("image", F.col("score").alias("n")), "image", "left")
    blend = F.coalesce("v", F.lit(0.0)) * a + F.coalesce("n", F.lit(0.0)) * (1 - a)
    return joined.select("image", F.round(blend, 9).alias("affinity")).orderBy(F.desc("affinity"), "image")


def bake(ranked: DataFrame, threshold: float) -> DataFrame:
    """Images at or above a threshold."""
    return ranked.where(F.col("affinity") >= threshold)


def phrase_counts(notes: DataFrame, body: str = "text") -> DataFrame:
    """(phrase, n) over note texts as they were written."""
    return notes.select(F.explode(text.grams(text.words(F.col(body)))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def suggestions(notes: DataFrame, collections: DataFrame, body: str = "text", limit: int = MOST_SUGGESTIONS) -> DataFrame:
    """(phrase, source, n): collection names (name, n) first, then phrases used twice or more."""
    named = collections.groupBy(F.lower("name").alias("phrase")).agg(F.max("n").alias("n")).withColumn("source", F.lit("collection"))
    mined = phrase_counts(notes, body).where("n >= 2").join(named.select("phrase"), "phrase", "left_anti").withColumn("source", F.lit("note"))
    both = named.select("phrase", "source", "n").unionByName(mined.select("phrase", "source", "n"))
    return both.orderBy("source", F.desc("n"), "phrase").limit(limit)


def co_annotated(links: DataFrame, started: DataFrame, least: int = LEAST_IMAGES) -> DataFrame:
    """(label, source, score, members): images annotated together in a session (session, image)."""
    groups = links.groupBy("session").agg(F.array_sort(F.collect_set("image")).alias("members")).where(F.size("members") >= least)
    day = F.date_format("started", "yyyy-MM-dd")
    label = F.when(day.isNull(), "worked together").otherwise(F.concat(F.lit("worked together "), day))
    return groups.join(started.select("session", "started"), "session", "left").select(label.alias("label"), F.lit("co_annotation").alias("source"), F.size("members").cast("double").alias("score"), "members")


def repeated_phrases(notes: DataFrame, body: str = "text", least: int = LEAST_IMAGES) -> DataFrame:
    """(label, source, score, members): images that share a phrase; of phrases with the same images the longest, then the first."""
    found = notes.select("image", F.explode(text.grams(text.words(F.col(body)))).alias("phrase")).groupBy("phrase").agg(F.array_sort(F.collect_set("image")).alias("members")).where(F.size("members") >= least)
    length = F.size(F.split("phrase", " "))
    one = found.groupBy("members").agg(F.min(F.struct((-length).alias("l"), "phrase")).alias("p"))
    return one.select(F.concat(F.lit('images you called "'), F.col("p.phrase"), F.lit('"')).alias("label"), F.lit("repeated_phrase").alias("source"), F.size("members").cast("double").alias("score"), "members")


def burst_candidates(bursts: DataFrame, folder: str) -> DataFrame:
    """(label, source, score, members) of bursts (folder, start, n, members)."""
    label = F.concat(F.lit("burst, "), text.base_name(F.col(folder).cast("string")), F.lit(", "), F.date_format("start", "yyyy-MM-dd"))
    return bursts.select(label.alias("label"), F.lit("time_folder").alias("source"), F.col("n").cast("double").alias("score"), "members")


def collection_suggestions(*candidates: DataFrame, limit: int = MOST_SUGGESTIONS) -> DataFrame:
    """The best candidates of all sources; long member lists are cut for display."""
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c)
    return every.orderBy(F.desc("score"), "source", "label").limit(limit).withColumn("members", F.slice("members", 1, MOST_MEMBERS))


def intensity(images: DataFrame, now: Column | None, tuning: Tuning = TUNING) -> DataFrame:
    """(image, intensity) in [0, 1] of (image, dwell_ms, events, strokes, last_ts), relative to the scope's greatest.

    With ``now`` older attention counts half after each half-life; times to come count as now.
    """
    raw = F.coalesce("dwell_ms", F.lit(0)) * tuning.dwell_weight + F.coalesce("events", F.lit(0)) * tuning.events_weight + F.coalesce("strokes", F.lit(0)) * tuning.strokes_weight
    if now is not None:
        age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 86_400e6)
        raw = raw * F.pow(F.lit(0.5), F.coalesce(age, F.lit(0.0)) / tuning.half_life_days)
    scored = images.select("image", raw.alias("raw"))
    most = scored.agg(F.max("raw")).head()[0] or 0.0
    return scored.select("image", (F.col("raw") / most if most > 0 else F.lit(0.0)).alias("intensity"))


def _by_topic(nodes: DataFrame) -> DataFrame:
    """(topic, aff, heat, m) of nodes (affinities, intensity, mass) for affinities over the floor."""
    return nodes.select(F.posexplode("affinities").alias("topic", "aff"), F.coalesce("intensity", F.lit(0.0)).alias("heat"), F.coalesce("mass", F.lit(1)).alias("m")).where(F.col("aff") > FLOOR)


def _relative(c: str) -> Column:
    most = F.max(c).over(W.partitionBy(F.lit(1)))  # a row a topic
    return F.when(most > 0, F.col(c) / most).otherwise(F.lit(0.0))


def engaged_topics(nodes: DataFrame) -> DataFrame:
    """(topic, score, mean): where the heat is; the score is relative to the hottest topic."""
    sums = _by_topic(nodes).groupBy("topic").agg(F.sum(F.col("aff") * F.col("heat") * F.col("m")).alias("w"), F.sum(F.col("aff") * F.col("m")).alias("mass"))
    return sums.select("topic", _relative("w").alias("score"), F.when(F.col("mass") > 0, F.col("w") / F.col("mass")).otherwise(0.0).alias("mean")).orderBy(F.desc("score"), "topic")


def overlooked_topics(nodes: DataFrame) -> DataFrame:
    """(topic, score, mean): coherent topics with little attention."""
    sums = _by_topic(nodes).groupBy("topic").agg(F.sum(F.col("aff") * F.col("m")).alias("mass"), F.sum(F.col("aff") * F.col("aff") * F.col("m")).alias("c"), F.sum(F.col("aff") * F.col("heat") * F.col("m")).alias("h"))
    both = sums.select("topic", (F.col("c") / F.col("mass")).alias("c"), (F.col("h") / F.col("mass")).alias("h")).withColumns({"c": _relative("c"), "h": _relative("h")})
    return both.select("topic", (F.col("c") * (1 - F.col("h"))).alias("score"), F.col("h").alias("mean")).orderBy(F.desc("score"), "topic")


def dominant_topic(affinities: Column) -> Column:
    """The first greatest positive affinity's place, -1 without one."""
    most = F.array_max(affinities)
    return F.when(most > 0, F.array_position(affinities, most).cast("int") - 1).otherwise(F.lit(-1))


def super_nodes(nodes: DataFrame) -> DataFrame:
    """(topic, mass, affinities): nodes grouped by dominant topic, with the mean of their affinities."""
    rows = nodes.select(dominant_topic(F.col("affinities")).alias("topic"), "affinities")
    mass = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("mass"))
    means = rows.select("topic", F.posexplode("affinities").alias("i", "a")).groupBy("topic", "i").agg(F.avg("a").alias("a")).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("c"))
    return mass.join(means, "topic", "left").select("topic", "mass", F.transform("c", lambda c: F.round(c["a"], 6)).alias("affinities"))


def overlay(nodes: DataFrame, overlooked: DataFrame, mode: str) -> DataFrame:
    """(image, score): engaged shows intensity, overlooked the node's topic's score dimmed by its own heat."""
    if mode == "engaged":
        return nodes.select("image", F.coalesce("intensity", F.lit(0.0)).alias("score"))
    scored = nodes.withColumn("topic", dominant_topic(F.col("affinities"))).join(overlooked.select("topic", F.col("score").alias("s")), "topic", "left")
    return scored.select("image", (F.coalesce("s", F.lit(0.0)) * (1 - F.coalesce("intensity", F.lit(0.0)))).alias("score"))


def cluster_topics(members: DataFrame, notes: DataFrame, body: str = "text") -> DataFrame:
    """(cluster, size, affinity, label) of (cluster, image, cosine): the label is the most frequent phrase, longer before shorter, then the first."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("cosine").alias("affinity"))
    found = members.select("cluster", "image").join(notes.select("image", body), "image").select("cluster", F.explode(text.grams(text.words(F.col(body)))).alias("phrase")).groupBy("cluster", "phrase").agg(F.count(F.lit(1)).alias("n"))
    best = found.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.size(F.split("phrase", " "))).alias("w"), "phrase")).alias("b"))
    return size.join(best, "cluster", "left").select("cluster", "size", F.round("affinity", 6).alias("affinity"), F.coalesce("b.phrase", F.concat(F.lit("Group "), (F.col("cluster") + 1).cast("string"))).alias("label"))
