"""Folding of all marks, ties by last annotation, one pass over the texts, circles of revisions."""

import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from silvergrain.functions import text
from silvergrain.operators import journal as J
from silvergrain.operators import search as S
from silvergrain.plans import text_plans

T0 = dt.datetime(2026, 1, 1)


def test_every_letter_with_marks_folds(spark):
    words = ["Ærø", "ŽIŽKOV", "Łódź", "Việt", "Ἀθῆναι", "ёлка", "naïve", "naïve", "ǰ", "Čeština", "straße", "한국", "ﬁ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(text.folded(F.col("w"))).collect()]
    slow = lambda w: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not 0x300 <= ord(c) < 0x370))
    assert got == [slow(w) for w in words] and got[3] == "viet" and got[6] == got[7] == "naive"
    assert all(S._fold(w) == r for w, r in zip(words, [[slow(w)] for w in words], strict=True))
    hits = S.search(spark.createDataFrame([(1, "Phở ở Việt Nam"), (2, "nothing")], "doc_id long, text string"), "viet")
    assert [r.doc_id for r in hits.collect()] == [1]


def test_equal_scores_go_to_the_last_annotated(spark):
    found = spark.createDataFrame([(1, -2.0), (2, -2.0), (3, -2.0), (4, -3.0), (5, -2.0)], "image long, score double")
    recency = spark.createDataFrame([(2, T0), (3, T0 + dt.timedelta(days=1)), (5, T0)], "image long, last_ts timestamp")
    assert [(r.image, r.place) for r in S.ordered_images(found, recency).orderBy("place").collect()] == [(4, 1), (3, 2), (2, 3), (5, 4), (1, 5)]
    assert S.ordered_images(found, recency, 2).count() == 2


def test_a_circle_costs_one_round_more(spark, monkeypatch):
    schema = "id long, kind string, target_event long"
    chain = [(0, "remark", None)] + [(i, "revision", i - 1) for i in range(1, 21)]
    straight = spark.createDataFrame(chain, schema)
    circle = spark.createDataFrame([*chain, (50, "revision", 51), (51, "revision", 50), (52, "revision", 51), (60, "revision", 60), (70, "revision", 999)], schema)
    rounds, real = [], J.written
    monkeypatch.setattr(J, "written", lambda df, name: rounds.append(name) or real(df, name))
    told = []
    for j in (straight, circle):
        rounds.clear()
        assert sorted(J.revision_roots(j).collect()) == [(i, 0) for i in range(1, 21)]
        told.append(rounds.count("hop"))
    assert told[0] <= 6 and told[1] <= told[0] + 1
    rounds.clear()
    assert J.revision_roots(circle.where("id >= 50")).count() == 0 and rounds.count("hop") == 1


def test_an_index_of_other_files_is_built_anew(spark, tmp_path):
    docs = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string").coalesce(1)
    docs("the nation", "the").write.parquet(f"{tmp_path}/documents.parquet")
    assert text_plans.bm25_indexed(spark, str(tmp_path)).count() == 0
    docs("the tionic", "the").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in text_plans.bm25_indexed(spark, str(tmp_path)).collect()] == [0]


def test_texts_are_cut_into_tokens_once(spark, tmp_path):
    spark.createDataFrame([(i, "a b a c"[: i % 8]) for i in range(20)] + [(99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"{tmp_path}/d.parquet")
    queries = spark.createDataFrame([(1, "a b"), (2, "zzz"), (3, "c"), (4, None)], "item_id long, text string")
    got = S.search_batch(docs, queries)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "d.parquet" not in plan, "the ranked rows come from the written postings"
    one = {r.doc_id: r.score for r in S.search(docs.withColumn("text", F.concat("text", F.lit(" "))), "a b ", limit=None).collect()}
    assert {r.doc_id for r in got.where("item_id = 1").collect()} <= set(one) and got.where("item_id IN (2, 4)").count() == 0
