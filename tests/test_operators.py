"""Operators against hand values and plain Python."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silvergrain.functions import dates, similarity, text
from silvergrain.operators import evaluate, filters, fusion, graph, search, select, temporal, vectors
from silvergrain.sources import files, vectorfile

T0 = dt.datetime(2026, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_queries_are_words_not_syntax():
    assert search.parse_query("fog ba") == (["fog"], "ba")
    assert search.parse_query(" \t ") == ([], None)
    assert search.parse_query("NEAR -fog OR") == (["NEAR", "-fog"], "OR")


def test_limit_comes_before_filters(spark):
    docs = spark.range(501).select(F.col("id").alias("doc_id"), F.lit("fog").alias("text"))
    hits = search.search(docs, "fog")
    assert hits.count() == 500 and hits.where("doc_id = 500").count() == 0


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Éclair au café")], "doc_id long, text string")
    assert [r.doc_id for r in search.search(docs, "eclair caf").collect()] == [3]
    assert search.search(docs, "").count() == 0
    assert search.search(docs.limit(0), "x").count() == 0


@pytest.mark.parametrize("ref,hyp,want", [("a b c", "a b c", (3, 0, 0, 0)), ("a b c", "a c", (2, 0, 1, 0)), ("a", "b", (0, 1, 0, 0)), ("", "x y", (0, 0, 0, 2)), ("a b", "", (0, 0, 2, 0))])
def test_alignment(ref, hyp, want):
    assert similarity.align(ref.split(), hyp.split()) == want


def test_jaro_winkler_hand_values():
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert similarity.jaro_winkler("", "a") == 0.0 and similarity.jaro_winkler("a", "a") == 1.0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=4000))
def test_chunks_cover_all_words(body):
    body = body * 3
    spans = search.chunk_spans(body)
    words = [i for i, c in enumerate(body) if not c.isspace()]
    assert all(any(s <= i < e for s, e, _ in spans) for i in words)
    assert all(a[0] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_relative_dates():
    now = dt.datetime(2026, 6, 15)
    assert filters.season(now, "winter", 1) == (dt.datetime(2025, 12, 1), dt.datetime(2026, 3, 1))
    assert filters.last_months(dt.datetime(2026, 5, 31), 3)[0] == dt.datetime(2026, 2, 28)
    assert filters.month(now, 9)[0] == dt.datetime(2025, 9, 1)
    assert filters.month(now, 12) == (dt.datetime(2025, 12, 1), dt.datetime(2026, 1, 1))


def test_clause_firewall():
    good, dropped = filters.clauses([{"type": "camera", "value": "leica"}, {"type": "camera", "value": "nokia"}, {"type": "rating", "low": 3}, {"type": "rating", "low": 9}, {"nonsense": 1}, {"type": "source", "values": ["typed"]}], T0, cameras=["Leica"])
    assert len(good) == 3 and len(dropped) == 3


def test_unknown_filters_are_errors(spark):
    images = spark.range(1).withColumnRenamed("id", "image")
    for f in (filters.Kind("remark"), filters.Collection(None)):
        with pytest.raises(ValueError):
            f.apply(images, {})


def test_session_rotates_at_the_gap_and_bursts_do_not(spark):
    rows = spark.createDataFrame([("a", i, at(s)) for i, s in enumerate((0, 1800, 3599))], "who string, id long, ts timestamp")
    assert sorted(r.n for r in temporal.sessions(rows, "who").collect()) == [1, 2]
    assert [r.n for r in temporal.bursts(rows, "who", "ts", "id", least=1).collect()] == [3]


def test_interval_links(spark):
    span = lambda *rows: spark.createDataFrame([("l", i, at(s), at(e)) for i, s, e in rows], "lane string, id long, start timestamp, end timestamp")
    spans = span((1, 10, 20), (2, 100, 101), (3, 300, 301))
    candidates = span((11, 5, 12), (12, 15, 25), (13, 104, 105), (14, 90, 96), (15, 312, 320))
    assert {tuple(r) for r in temporal.link_intervals(spans, candidates, "lane").collect()} == {(1, 12), (2, 13)}


def test_as_of_before_all_states(spark):
    facts = spark.createDataFrame([("a", at(5), 1), ("a", at(50), 2), ("b", at(1), 3)], "k string, ts timestamp, id long")
    states = spark.createDataFrame([("a", at(10), 7, "x"), ("a", at(50), 8, "y")], "k string, sts timestamp, sid long, v string")
    got = {r.id: (r.v, r.predated) for r in temporal.as_of(facts, states, "k", "ts", "sid", "sts", "v").collect()}
    assert got == {1: ("x", True), 2: ("y", False), 3: (None, False)}


def test_rate_resets_and_ignores_a_still_clock(spark):
    rows = spark.createDataFrame([("a", at(0), 0), ("a", at(1), 100), ("a", at(1), 300), ("a", at(2), 400), ("a", at(3), 5)], "k string, t timestamp, n long")
    got = [r.rate for r in temporal.smoothed_rate(rows, "k", "t", "n").orderBy("t", "rate").collect()]
    assert got[0] is None and 100.0 in got and got[-1] is None and pytest.approx(160.0) == got[-2]


def test_segments_close_at_the_last_speech(spark):
    p = [0.1, 0.6, 0.4, 0.2, 0.2, 0.4, 0.2, 0.2, 0.2, 0.9]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "k string, i long, p double")
    assert sorted((r.start, r.end) for r in temporal.segments(rows, "k", "i", "p", hang=3).collect()) == [(1, 5), (9, 9)]


def test_knn_orders_ties_and_clamps(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r.src, r.dst, r.sim) for r in vectors.knn_graph(v, k=2).collect()}
    assert {(4, 1, 0.0), (4, 2, 0.0), (1, 2, 1.0), (1, 3, 0.0)} <= got
    assert vectors.knn_graph(v.limit(1)).count() == 0 and vectors.knn_graph(v, k=0).count() == 0


def test_quantising_round_trip(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((50, 8)).astype("float32")
    scale, offset, codes = vectorfile.decode_file(vectorfile.encode_file(m))
    assert np.abs(codes * scale + offset - m).max() <= scale.max() * 0.51
    with pytest.raises(ValueError):
        vectorfile.decode_file(b"nothing like it")


def test_fusion_ties_by_recency_then_image(spark):
    rows = spark.createDataFrame([(1, 0.5)], "image long, score double")
    other = spark.createDataFrame([(2, 0.5)], "image long, score double")
    third = spark.createDataFrame([(3, 0.5)], "image long, score double")
    recent = spark.createDataFrame([(2, at(9))], "image long, last_ts timestamp")
    got = [r.image for r in fusion.fuse([fusion.Ranked("a", rows), fusion.Ranked("b", other), fusion.Ranked("c", third)], recent).collect()]
    assert got == [2, 1, 3]


def test_hybrid_without_vectors_is_the_text_result(spark):
    hits = spark.createDataFrame([(5, -1.0), (4, -2.0)], "image long, score double")
    assert [r.image for r in fusion.hybrid(hits, []).collect()] == [4, 5]


@pytest.mark.parametrize("threshold", [0, 3, 8, 64])
def test_hamming_pairs_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    sigs = [int(x) for x in base] + [int(x) ^ (1 << int(b)) ^ (1 << int(c)) for x, b, c in zip(base, rng.integers(0, 62, 30), rng.integers(0, 62, 30), strict=True)] + [int(base[0])]
    rows = spark.createDataFrame([*enumerate(sigs), (999, None)], "k long, s long")
    got = {(r.a, r.b, r.distance) for r in graph.hamming_pairs(rows, "k", "s", threshold).collect()}
    want = {(i, j, d) for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := ((sigs[i] ^ sigs[j]) & (2**64 - 1)).bit_count()) <= threshold}
    assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 500 for i in range(500, 540)) and len(got) == 101


@pytest.mark.parametrize("method", sorted(select.METHODS))
def test_diversify(spark, method):
    items = spark.createDataFrame([(1, i, float(q)) for i, q in ((1, 1), (2, 5), (3, 0), (9, 0))] + [(2, 4, 0.0)], "scope long, image long, quality double")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.85), (1, 4, 0.99)], "a long, b long, sim double")
    shown = lambda t: {r.image for r in select.diversify(items, edges, method, t).where("shown").collect()}
    assert shown(0.0) == {1, 2, 3, 4, 9}
    assert shown(0.5) == {2, 4, 9}  # the best of each likeness, and those without neighbours


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(5)
    centers = np.eye(4) * 10
    rows = [(i, [float(x) for x in centers[i % 4] + rng.normal(0, 0.1, 4)]) for i in range(80)]
    got = {r.vec_id: r.cluster for r in select.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4).collect()}
    assert len({(i % 4, c) for i, c in got.items()}) == 4
    assert select.cluster_count(8) == 2 and select.cluster_count(200) == 10 and select.cluster_count(10**6) == 12


def test_metrics_by_hand(spark):
    q = spark.createDataFrame([("q",), ("none",)], "query string")
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "a", 4)], "query string, item string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "c")], "query string, item string")
    got = {r["query"]: r for r in evaluate.query_metrics(q, ranked, relevant, k=3).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].mrr) == (0.333333, 0.5, 0.333333)
    assert got["q"].ndcg == pytest.approx(0.5 / (1 + 1 / np.log2(3)), abs=1e-6) and got["none"].ndcg == 0.0


def test_dates_and_edits(spark):
    rows = spark.createDataFrame([("2026:02:03 04:05:06", "+01:00", '<a xmp:Rating="4"/>'), ("2026:13:03 04:05:06", None, "<x/>"), (None, None, None)], "t string, o string, x string")
    got = rows.select(dates.capture_time(F.col("t"), F.col("o")).alias("t"), files.foreign_edits(F.col("x")).alias("e")).collect()
    assert got[0].t == dt.datetime(2026, 2, 3, 3, 5, 6) and got[1].t is None and got[2].t is None
    assert got[0].e.rating == 4 and got[1].e is None and got[2].e is None


def test_listing_skips_what_is_not_an_archive(spark, tmp_path):
    for name in ("a.jpg", "sub/b.NEF", ".git/c.jpg", "d.txt", "~$e.png"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(name.encode())
    got = {(r.rel_path, r.kind) for r in files.list_files(spark, f"file://{tmp_path}").collect()}
    assert got == {("a.jpg", "image"), ("sub/b.NEF", "raw")}
    stored = files.list_files(spark, f"file://{tmp_path}", content=True)
    assert files.hash_changed(spark, f"file://{tmp_path}", stored).count() == 2


def test_only_changed_files_are_read(spark, tmp_path):
    import hashlib

    for name, data in (("same.jpg", b"1"), ("longer.jpg", b"22"), ("new one%20.jpg", b"3"), ("unhashed.jpg", b"4"), ("empty.jpg", b"")):
        (tmp_path / name).write_bytes(data)
    at = {r.rel_path: r for r in files.list_files(spark, f"file://{tmp_path}").collect()}
    stored = spark.createDataFrame(
        [("same.jpg", 1, at["same.jpg"].mtime, "kept"), ("longer.jpg", 1, at["longer.jpg"].mtime, "old"), ("unhashed.jpg", 1, at["unhashed.jpg"].mtime, None), ("gone.jpg", 1, 0, "gone")], "rel_path string, size long, mtime long, hash string"
    )
    got = {r.rel_path: r.hash for r in files.hash_changed(spark, f"file://{tmp_path}", stored).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"same.jpg": "kept", "longer.jpg": sha(b"22"), "new one%20.jpg": sha(b"3"), "unhashed.jpg": sha(b"4")}  # a file without a byte is not listed


def test_grams(spark):
    row = spark.createDataFrame([("The harbor at dusk, ok",)], "t string").select(text.grams(text.words(F.col("t"))).alias("g")).head()
    assert set(row.g) == {"harbor", "dusk", "dusk ok", "harbor at dusk"}


def test_plans_push_filters_and_columns(spark, data):
    plan = spark._jvm.PythonSQLUtils.explainString(filters.browse(spark.read.parquet(f"{data}/orders.parquet").selectExpr("o_orderkey AS image", "o_orderdate AS capture_ts"), [filters.Captured(dt.datetime(1996, 1, 1))], {})._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan and "TakeOrderedAndProject" in plan and "o_totalprice" not in plan


def test_an_index_gives_what_a_scan_gives_and_reads_only_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(("fog", "barn", "fogbank", "Éclair")[k % 4] for k in range(i % 7 + 1))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    search.build_index(docs, str(tmp_path))
    for q in ("fog", "barn fo", "eclair barn", "none", ""):
        got, want = search.search_index(spark, str(tmp_path), q), search.search(docs, q)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    plan = spark._jvm.PythonSQLUtils.explainString(search.search_index(spark, str(tmp_path), "barn fo")._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [Or(EqualTo(term,barn),StringStartsWith(term,fo))]" in plan


def test_stroke_geometry(spark):
    pts = "array<struct<x:double,y:double>>"
    row = spark.createDataFrame([([(0.0, 0.0), (0.5, 0.0), (0.5, 0.5)], [(0.25, 0.75)], [], 6, 1)], f"p {pts}, one {pts}, none {pts}, drawn int, shown int").select(
        graph.stroke_length(F.col("p"), 6000, 3000).alias("length"), graph.stroke_length(F.col("one")).alias("dot"), graph.stroke_length(F.col("none")).alias("nothing"),
        graph.distance_to_stroke(F.col("p"), F.lit(0.25), F.lit(0.1)).alias("near"), graph.quantized_points(F.transform("one", lambda p: F.struct((p["x"] * 8).alias("x"), p["y"].alias("y")))).alias("q"),
        graph.remapped(F.col("one"), F.col("drawn"), F.col("shown")).alias("back"), *(graph.remapped(graph.remapped(F.col("one"), F.lit(1), F.lit(k)), F.lit(k), F.lit(1)).alias(f"r{k}") for k in range(1, 9)),
        graph.worth_keeping(F.lit(0.0001), F.lit(10)).alias("tiny"), graph.worth_keeping(F.lit(0.0001), F.lit(900)).alias("slow"),
    ).head()
    assert row.length == pytest.approx(0.5 + 0.25) and row.dot == row.nothing == 0.0 and row.near == pytest.approx(0.1)
    assert (row.q[0].x, row.q[0].y) == (graph.GRID + graph.OVERSHOOT, 7500)
    assert all((row[f"r{k}"][0].x, row[f"r{k}"][0].y) == (0.25, 0.75) for k in range(1, 9))
    assert (row.back[0].x, row.back[0].y) == (0.75, 0.75) and not row.tiny and row.slow
