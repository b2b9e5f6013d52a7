"""The Jaccard join and its stage where ids repeat."""

import corpus_pipeline
from silvergrain.llm import jaccard

A = " ".join(f"a{i}" for i in range(200))
B = " ".join(f"b{i}" for i in range(200))
C = " ".join(f"c{i}" for i in range(200))


def test_texts_of_one_id_are_told_apart(spark):
    rows = [(1, A), (1, B), (5, A + " x"), (6, B + " y"), (7, C), (7, C), (8, C + " z"), (0, B + " w")]
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 0), (1, 1), (5, 1), (6, 0), (7, 7), (7, 7), (8, 7)]


def test_links_of_both_texts_of_an_id_are_found(spark):
    rows = [(1, A), (1, B), (5, A + " x"), (6, B + " y")]
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (5, 1), (6, 1)]


def test_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, A), (1, B), (5, A + " x"), (7, C), (7, C), (8, C + " z"), (0, B + " w"), (9, ""), (9, ""), (9, " "), (None, C), (None, C)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(kept, key=repr) == sorted([(1, A), (7, C), (0, B + " w"), (9, ""), (9, " "), (None, C), (None, C)], key=repr)
