"""Odd rows go through every stage of the pipeline with a defined result."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, n_shingles string, component_id string, kept string"


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    return lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_stages_on_odd_rows(spark, data, prose):
    one, long_ = prose(60), prose(60_000)
    extra = ("c", "n", "i", "k")
    rows = [(1, one, "en", "a"), (2, one, "en", "a"), (2, one, "en", "a"), (3, None, "en", "a"), (4, "", None, None), (None, prose(50), "en", "a"), (None, None, None, None), (5, long_, "en", None), (6, prose(40), None, "b"), (6, prose(45), None, "b"), (7, prose(30), "de", None)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows], SCHEMA)
    (_, quality), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = quality(spark, docs, data)
    assert good.columns == docs.columns and good.where("text IS NULL OR text = ''").count() == 0 and good.count() == 8
    once = dedup(spark, good, data)
    assert once.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text)) for r in once.collect()) == sorted((i or 0, len(t)) for i, t in [(1, one), (None, rows[5][1]), (5, long_), (6, rows[8][1]), (6, rows[9][1]), (7, rows[10][1])])
    assert once.select("copy", "component_id").distinct().collect() == [("c", "i")]
    mixed = mix(spark, once, data)
    assert mixed.columns == docs.columns and mixed.exceptAll(mixed.join(once, mixed.text == once.text, "left_semi")).count() == 0
    coded = encode(spark, once, data)
    assert coded.count() == 6 and coded.where("NOT exact").count() == 0 and coded.where(F.col("doc_id") == 5).head().n_tokens > 60_000
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
