"""Queries with hard filters, over orders taken as images."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters as X
from .fixtures import table

NOW = dt.datetime(1998, 6, 15)


def images(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("capture_ts"), F.col("o_orderpriority").alias("camera"), F.col("o_orderstatus").alias("lens"))


def tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "image")
    k, c = F.col("image"), F.col("o_custkey")
    paths = o.select("image", (c % 3).alias("volume"), (c % 5).alias("root"), F.concat(F.lit("Shoot"), (c % 40).cast("string"), F.lit("/roll"), (k % 7).cast("string"), F.when(k % 13 == 0, "/").otherwise("/sub/"), F.lit("IMG_"), k.cast("string"), F.lit(".jpg")).alias("rel_path"), (k % 5 != 0).alias("active"))
    return {
        "paths": paths,
        "ratings": o.where("image % 4 <> 0").select("image", (F.floor("o_totalprice") % 6).cast("int").alias("rating")),
        "stats": o.where("image % 2 = 0").select("image", (k % 3 == 0).alias("has_strokes"), (k % 8 == 0).alias("has_text")),
        "events": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "A", "typed").when(F.col("l_returnflag") == "R", "voice").otherwise("pencil").alias("source")),
        "members": o.select(F.col("o_custkey").alias("collection"), "image", F.col("o_orderdate").alias("added_ts"), F.when(F.col("o_orderstatus") == "F", F.expr("o_orderdate + INTERVAL 30 DAYS")).alias("removed_ts")),
        "volumes": spark.range(3).select(F.col("id").alias("volume"), F.concat(F.lit("disk"), F.col("id").cast("string")).alias("name"), (F.col("id") < 2).alias("online")),
        "roots": spark.range(5).select(F.col("id").alias("root"), F.concat(F.lit("root"), (F.col("id") % 3).cast("string")).alias("name"), (F.col("id") != 3).alias("active")),
    }


CASES = {
    "filter_captured_range": ([X.Captured(dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1))], "capture_ts >= '1996-01-01' AND capture_ts < '1997-01-01'"),
    "filter_season": ([X.Captured(*X.season(NOW, "winter", 1))], "capture_ts >= '1997-12-01' AND capture_ts < '1998-03-01'"),
    "filter_last_months": ([X.Captured(*X.last_months(NOW, 4))], "capture_ts >= '1998-02-15'"),
    "filter_last_weeks": ([X.Captured(*X.last_weeks(NOW, 10))], "capture_ts >= '1998-04-06'"),
    "filter_month": ([X.Captured(*X.month(NOW, 9))], "capture_ts >= '1997-09-01' AND capture_ts < '1997-10-01'"),
    "filter_year": ([X.Captured(*X.whole_year(1995))], "year(capture_ts) = 1995"),
    "filter_annotated": ([X.Annotated(dt.datetime(1998, 3, 1), dt.datetime(1998, 3, 5))], "image IN (SELECT image FROM ev WHERE ts >= '1998-03-01' AND ts < '1998-03-05')"),
    "filter_camera": ([X.Gear("camera", "5-low")], "lower(camera) = '5-low'"),
    "filter_camera_contains": ([X.Gear("camera", "MED", contains=True)], "contains(lower(camera), 'med')"),
    "filter_lens": ([X.Gear("lens", "p")], "lower(lens) = 'p'"),
    "filter_subtree": ([X.Subtree("/shoot7/roll2/")], "image IN (SELECT image FROM paths WHERE active AND starts_with(lower(rel_path), 'shoot7/roll2/'))"),
    "filter_subtree_any": ([X.Subtree("/")], "image IN (SELECT image FROM paths WHERE active)"),
    "filter_folder_contains": ([X.FolderContains("SUB")], "image IN (SELECT image FROM paths WHERE active AND lower(rel_path) LIKE '%sub%/%')"),
    "filter_root": ([X.Root("root0")], "image IN (SELECT image FROM paths WHERE active AND root = 0)"),
    "filter_rating_between": ([X.Rating(4, 2)], "image IN (SELECT image FROM ratings WHERE rating BETWEEN 2 AND 4)"),
    "filter_rating_at_most": ([X.Rating(high=1)], "image IN (SELECT image FROM ratings WHERE rating <= 1)"),
    "filter_rating_at_least": ([X.Rating(low=5)], "image IN (SELECT image FROM ratings WHERE rating >= 5)"),
    "filter_has_strokes": ([X.HasStrokes(True)], "image % 6 = 0"),
    "filter_no_strokes": ([X.HasStrokes(False)], "image % 6 <> 0"),
    "filter_source": ([X.Source(("voice",))], "image IN (SELECT image FROM ev WHERE source = 'voice')"),
    "filter_source_none": ([X.Source(())], "false"),
    "filter_volume_online": ([X.Volume("online")], "image IN (SELECT image FROM paths WHERE active AND volume < 2)"),
    "filter_volume_offline": ([X.Volume("offline")], "image NOT IN (SELECT image FROM paths WHERE active AND volume < 2)"),
    "filter_volume_named": ([X.Volume("disk2")], "image IN (SELECT image FROM paths WHERE active AND volume = 2)"),
    "filter_collection": ([X.Collection(7)], "image IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F')"),
    "filters_combined": ([X.Captured(dt.datetime(1995, 1, 1), None), X.Rating(low=3), X.Subtree("Shoot1"), X.HasStrokes(False), X.Volume("online")],
        "capture_ts >= '1995-01-01' AND image IN (SELECT image FROM ratings WHERE rating >= 3) AND image IN (SELECT image FROM paths WHERE active AND starts_with(lower(rel_path), 'shoot1/')) AND image % 6 <> 0 AND image IN (SELECT image FROM paths WHERE active AND volume < 2)"),
}

FIXTURE_SQL = """WITH images AS (SELECT o_orderkey AS image, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS capture_ts, o_orderpriority AS camera, o_orderstatus AS lens FROM orders),
paths AS (SELECT o_orderkey AS image, o_custkey % 3 AS volume, o_custkey % 5 AS root, 'Shoot' || (o_custkey % 40) || '/roll' || (o_orderkey % 7) || CASE WHEN o_orderkey % 13 = 0 THEN '/' ELSE '/sub/' END || 'IMG_' || o_orderkey || '.jpg' AS rel_path, o_orderkey % 5 <> 0 AS active FROM orders),
ratings AS (SELECT o_orderkey AS image, (floor(o_totalprice)::BIGINT % 6)::INTEGER AS rating FROM orders WHERE o_orderkey % 4 <> 0),
ev AS (SELECT l_orderkey AS image, l_shipdate AS ts, CASE l_returnflag WHEN 'A' THEN 'typed' WHEN 'R' THEN 'voice' ELSE 'pencil' END AS source FROM lineitem) """


def _case(name, wanted):
    def query(spark, sf_dir):
        return X.admit(images(spark, sf_dir), wanted, tables(spark, sf_dir)).select("image")

    query.__name__ = name
    return query


def browse_topk(spark, sf_dir):
    return X.browse(images(spark, sf_dir), [X.Rating(low=2)], tables(spark, sf_dir)).select("image", "capture_ts")


def vocabulary_grounding(spark, sf_dir):
    return X.vocabulary(table(spark, sf_dir, "part"), "p_type")


def direct_children(spark, sf_dir):
    return X.children(tables(spark, sf_dir)["paths"], "Shoot3/roll4/sub").select("image", "rel_path")


def folder_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return X.folder_rows(t["paths"], images(spark, sf_dir), t["stats"], t["volumes"], t["ratings"])


QUERIES = [_case(k, v[0]) for k, v in CASES.items()] + [browse_topk, vocabulary_grounding, direct_children, folder_rows]
SQL = {k: f"{FIXTURE_SQL} SELECT image FROM images WHERE {v[1]}" for k, v in CASES.items()} | {
    "browse_topk": f"{FIXTURE_SQL} SELECT image, capture_ts FROM images WHERE image IN (SELECT image FROM ratings WHERE rating >= 2) ORDER BY capture_ts DESC NULLS LAST, image LIMIT 500",
    "vocabulary_grounding": "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    "direct_children": f"{FIXTURE_SQL} SELECT image, rel_path FROM paths WHERE active AND regexp_full_match(rel_path, 'Shoot3/roll4/sub/[^/]*')",
    "folder_rows": f"{FIXTURE_SQL} SELECT p.image, rel_path, capture_ts, p.image % 2 = 0 AND (p.image % 8 = 0 OR p.image % 3 = 0) AS has_journal, volume >= 2 AS offline, p.image % 4 <> 0 AS has_preview FROM paths p JOIN images USING (image) WHERE active",
}
