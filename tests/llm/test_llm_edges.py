"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import json

import pytest
from pyspark.sql import functions as F

from silvergrain.llm import chat, html, jaccard, mixing, neardup, pieces, quality, records, registry, sharding, warc

LONG = "a very long text of many words indeed and more. " * 25_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, ids string, kept string, slot string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62, "x", "y", "z", "s", "t"),
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 62, "x", "y", "z", "s", "t"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "", 0, None, None, None, None, None),
        (None, "one two three four five six seven eight nine ten eleven twelve", None, "b", 62, None, None, None, None, None),
        (5, LONG, "en", "b", len(LONG), None, None, None, None, None),
        (6, " \n\t", "en", "a", 3, None, None, None, None, None),
        (7, "ONE two three four five six seven eight nine ten eleven twelve", "en", "a", 62, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_quality(docs, nothing):
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.assess(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 12, False, True)] * 2 + [(2, 0, True, False), (3, 0, True, False), (None, 12, False, True), (5, 250_000, True, False), (6, 0, True, False), (7, 12, False, True)]))
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.assess(nothing).count() == 0 and quality.filter_documents(nothing).count() == 0


def test_pieces(docs, nothing):
    path = registry.vocabulary("piece_bpe_32k.model")
    got = pieces.encode_documents(docs, path, decoded_name="decoded")
    rows = got.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == 8 and all(r.decoded == (r.text or "") for r in rows)
    assert all(len(r.ids) == 0 for r in rows if not r.text)
    back = pieces.decode_documents(got.drop("decoded"), path)
    assert all(r.decoded == (r.text or "") for r in back.select("text", "decoded").collect())
    assert pieces.encode_documents(nothing, path).count() == 0


def test_records(spark, docs, nothing):
    path = registry.vocabulary("byte_bpe_50k.json")
    rows = records.round_trip(docs, path, end_id=2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 5, 6, 7]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(8)]
    assert rows[3].n_tokens == rows[4].n_tokens == 1
    assert records.round_trip(nothing, path, end_id=2).count() == 0


def test_jaccard(docs, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(1, 8, 1), (1, 8, 1), (2, 0, 2), (3, 0, 3), (None, 8, None), (5, 10, 5), (6, 0, 6), (7, 8, 1)], key=str)
    assert jaccard.jaccard_join(nothing).count() == 0


def test_sharding_and_mixing(docs, nothing):
    placed = sharding.place(docs, "doc_id", registry.SHARDS)
    assert placed.count() == 8 and placed.where("shard IS NULL OR slot IS NULL").count() == 0
    assert placed.columns.count("shard") == 1 and placed.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.place(nothing, "doc_id", registry.SHARDS).count() == 0
    mixed = mixing.replicate(docs, seed=1)
    assert mixed.schema["copy"].dataType.simpleString() == "int" and mixed.count() >= 0
    assert mixing.replicate(nothing).count() == 0
    assert mixing.replicate(docs, weights={}).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, level string"
    rows = [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (1, 1, "assistant", None, None), (None, 1, "user", "q", None), (2, None, "assistant", "", None), (2, 3, None, LONG, None), (3, 5, "assistant", "{broken", None)]
    df = spark.createDataFrame(rows, schema)
    got = chat.format_chats(chat.reply_links(df), registry.CHAT_SCHEMAS)
    out = got.collect()
    assert len(out) == 7 and got.schema["level"].dataType.simpleString() == "int"
    assert [r.linked for r in out if r.role == "assistant" and r.conv_id == 1] == [True]
    assert all(json.loads(r.json) is not None for r in out)
    assert chat.format_chats(chat.reply_links(df.limit(0)), registry.CHAT_SCHEMAS).count() == 0


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + LONG), (3, "u", "<p>" + LONG), (4, "u", "<!-- never ends"), (5, "u", "<script>x"), (6, "u", "<div"), (7, "u", "&amp &lt; &am")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract_pages(df).collect()}
    assert got[1] == got[2] == got[4] == got[5] == got[6] == "" and got[3] == LONG.strip() and got[7] == "& < &am"
    assert html.extract_pages(df.limit(0)).count() == 0


def test_warc(spark):
    big = "x" * 2000
    rows = [(1, "http://a b/é", big), (2, None, big), (2, None, big), (None, "u", big), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u\nv", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want = [(1, 2000, "revisit", 2), (2, 2000, "response", None), (2, 2000, "revisit", 2), (None, 2000, "revisit", 2), (3, 0, "response", None), (4, 5, "response", None), (5, 5, "response", None), (6, len(LONG), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
