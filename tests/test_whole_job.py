"""Queries do the whole job: no prefix of a text, no share of the rows, no cap."""

import os
import random
import re

import duckdb
import pytest

from silvergrain.functions import similarity
from silvergrain.plans import registry


def _align(a, b):
    rows = [list(range(len(b) + 1))]
    for i, r in enumerate(a, 1):
        row = [i]
        for j, h in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (r != h), rows[-1][j] + 1, row[j - 1] + 1))
        rows.append(row)
    i, j, out = len(a), len(b), [0, 0, 0, 0]
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out[int(a[i - 1] != b[j - 1])] += 1
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            out[2] += 1
            i -= 1
        else:
            out[3] += 1
            j -= 1
    return tuple(out)


def test_alignment_by_rows_equals_cell_by_cell():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(25))] for _ in "ab")
        assert similarity.align(a, b) == _align(a, b)


def test_word_errors_are_of_whole_turns(spark, data):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    pairs = {k: (words(t), words(turns[k[0], k[1] + 1])) for k, t in turns.items() if (k[0], k[1] + 1) in turns}
    assert any(len(turns[k] or "") > 400 for k in pairs)
    want = {k: (*_align(a, b), len(a), len(b)) for k, (a, b) in pairs.items()}
    got = {(r.conv_id, r.turn): (r.hits, r["sub"], r["del"], r["ins"], r.ref_words, r.hyp_words) for r in registry.queries()["wer_by_turn"](spark, data).collect()}
    assert got == want
    whole = registry.queries()["wer_corpus"](spark, data).collect()[0]
    assert (whole.ref_words, whole.edits) == (sum(v[4] for v in want.values()), sum(sum(v[1:4]) for v in want.values()))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def _whole(duck, name, *cuts):
    """Rows of the registered SQL without its cuts, if it has them."""
    sql = registry.oracle_sql()[name]
    for cut, whole in cuts:
        sql = sql.replace(cut, whole)
    found = duck.sql(sql)
    return found.columns, found.fetchall()


def test_co_annotation_has_all_annotations(spark, data, duck):
    columns, want = _whole(duck, "co_annotation", (" AND id % 20 = 0", ""))
    got = registry.queries()["co_annotation"](spark, data).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    links = duck.sql("SELECT count(*) FROM (SELECT DISTINCT user_id, event_id % 500 FROM events WHERE event_type IN ('view', 'click', 'purchase'))").fetchall()[0][0]
    few = duck.sql("SELECT coalesce(sum(n), 0) FROM (SELECT count(DISTINCT event_id % 500) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id) WHERE n < 3").fetchall()[0][0]
    assert sum(r.score for r in got) == links - few


def test_collection_suggestions_count_all_annotations(spark, data, duck):
    most = [r[0] for r in duck.sql("SELECT count(DISTINCT event_id % 500) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id ORDER BY 1 DESC LIMIT 24").fetchall()]
    got = registry.queries()["collection_suggestions"](spark, data).collect()
    scores = sorted((r.score for r in got if r.source == "co_annotation"), reverse=True)
    assert scores and scores == most[: len(scores)]


@pytest.mark.parametrize("name,cap", [("grid_sort_capture", " LIMIT 300"), ("dirty_drain", " LIMIT 50")])
def test_sorted_lists_are_whole(spark, data, duck, name, cap):
    columns, want = _whole(duck, name, (cap, ""))
    assert len(want) > int(cap.split()[1])
    got = registry.queries()[name](spark, data).select(columns).collect()
    assert list(map(tuple, got)) == want


@pytest.mark.parametrize("name,cuts", [
    ("folder_delta", [(" WHERE event_id > 300 AND event_id <= 900", "")]),
    ("topic_suggestions", [(" WHERE n_nationkey < 6", "")]),
    ("collection_counts", [(" AND o_orderkey % 7 = 0", "")]),
])
def test_queries_take_all_ids(spark, data, duck, name, cuts):
    columns, want = _whole(duck, name, *cuts)
    got = registry.queries()[name](spark, data).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)
