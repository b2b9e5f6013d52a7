"""Values of a foreign document are sought once; rows without a target don't meet in one task."""

from pyspark.sql import functions as F

from silvergrain.operators import journal as J
from silvergrain.plans.fixtures import journal
from silvergrain.sources import files


def test_each_value_of_a_document_is_sought_once(spark):
    xmp = '<x:D tiff:Orientation="6" xmp:Label="Red" a:b-c:Rating = "3" crs:HasCrop="True" crs:CropTop="0.1" crs:CropLeft="0.2" crs:CropBottom="0.8" crs:CropRight="0.9" :CropAngle="7">'
    rows = spark.createDataFrame([(1, xmp), (2, "<x/>"), (3, None)], "id long, xmp string")
    found = rows.select("id", files.foreign_edits(F.col("xmp")).alias("e")).select("id", "e.label", "e.rating", "e.crop.top", "e.crop.right", "e.crop.angle")
    assert sorted(map(tuple, found.collect())) == [(1, "Red", 3, 0.1, 0.9, None), (2, *[None] * 5), (3, *[None] * 5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract") <= 4 * 9  # an attribute and an element of nine values, each tested and taken


def test_rows_without_target_are_not_joined_by_it(spark, data):
    j = journal(spark, data)
    merged, _ = J.merge_events(j.where("id % 3 <> 0"), j.where("id % 3 <> 1"))
    assert merged.count() == j.count()
    plan = merged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftOuter, (target_event" in line)
    assert any("isnotnull(" in line and "target_event" in line for line in plan[at + 1 : at + 6])
