"""Token counts against the library, and the table of lengths against a dictionary."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silvergrain.llm import counts, pieces, registry

PATH = registry.vocabulary("piece_bpe_32k.model")
ALPHABET = "ab the in on  \n.▁éß漢1-é\t'%𝄞\x00"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


TEXTS = st.lists(st.none() | st.text(alphabet=ALPHABET, max_size=60) | st.text(max_size=30), max_size=6)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.booleans())
def test_any_texts(texts, known):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    words = [b" the", b"\n", b" in", b" ", b"  ", b" a", " é".encode(), b" on"] if known else []
    counter = counts.TokenCounter(PATH, counts.LengthTable(dict(zip(words, counts.word_counts(pieces.model(PATH), words), strict=True))))
    assert counter.counts(pa.array(texts, pa.string())).tolist() == [len(library.encode(t or "")) for t in texts]


def test_words_are_those_of_the_encoder():
    model, rng = pieces.model(PATH), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t▁é") for _ in range(rng.randrange(1, 40)))
        data, edges = counts.cut_bytes(pa.array([text], pa.large_string()), model.prefix)
        starts = counts.word_starts(data[:-16], edges, model.own_line)
        body = data[:-16].tobytes()
        assert [body[a:b].decode() for a, b in zip(starts, [*starts[1:], len(body)], strict=True)] == model.split(text)


def test_table_finds_what_it_holds_and_nothing_else():
    rng = random.Random(1)
    words = list({rng.randbytes(rng.randrange(1, 16)) for _ in range(5000)} | {b"a", b"a\x00", b"a\x00\x00", b"\x00", b"12345678", b"12345678\x00"})
    others = [w for w in {rng.randbytes(rng.randrange(1, 16)) for _ in range(5000)} if w not in set(words)]
    held = {w: rng.randrange(1, 60_000) for w in words} | {b"x" * 16: 3, b"": 2}
    sought = words + others
    sizes = np.array([len(w) for w in sought])
    data = np.frombuffer(b"".join(sought) + bytes(16), np.uint8)
    for table, want in ((counts.LengthTable(held), [held[w] for w in words] + [-1] * len(others)), (counts.LengthTable({}), [-1] * len(sought))):
        assert table.find(*counts.packed(data, np.cumsum(sizes) - sizes, sizes)).tolist() == want


def test_op11(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op11_token_counts(spark, data).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def test_no_word_is_shuffled(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = counts.count_tokens(docs, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_sample_is_bounded(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(7)
    few = counts.sampled_words(docs, PATH, parts=2, texts=3, most=20)
    assert len(few) == 20 and all(len(w) <= counts.SHORT for w in few)
    assert counts.sampled_words(docs.limit(0), PATH) == {}


def test_odd_rows(spark, library):
    long = "a very long text of many words indeed and more. " * 25_000
    odd = [None, "", " ", "\n", long, "x" * 30_000, "one two", "one two", "<s>▁</s> <unk>", "  \n  a"]
    df = spark.createDataFrame([(i % 7, t, "clash") for i, t in enumerate(odd)], "doc_id long, text string, n_tokens string").withColumn("other", F.lit(1))
    got = counts.count_tokens(df, PATH).collect()
    assert {(r.text, r.n_bytes, r.n_tokens, r.over_limit, r.other) for r in got} == {(t, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096, 1) for t in odd}
    assert len(got) == len(odd)
    assert counts.count_tokens(df.limit(0), PATH).count() == 0


def test_worker_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 50)
    counter, rng = counts.TokenCounter(PATH, counts.LengthTable({})), random.Random(2)
    for _ in range(20):
        counter.counts(pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(40))]))
        assert len(counter.seen) <= 50 + 200
