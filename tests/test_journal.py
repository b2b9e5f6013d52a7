"""Folds on hand-made journals."""

import datetime as dt
import random

import pytest

from silvergrain import model
from silvergrain.operators import journal as J

T0 = dt.datetime(2026, 1, 1)


def journal(spark, *rows):
    """(id, kind, target, image, text, rating, scrubbed, ts offset)"""
    full = []
    for r in rows:
        i, kind, target, image, text, rating, scrubbed, at = (list(r) + [None] * 8)[:8]
        source = {"stroke": "pencil", "retraction": "system", "redaction": "system"}.get(kind, "typed")
        full.append((i, T0 + dt.timedelta(seconds=at if at is not None else i), 1, kind, source, target, image, text, rating, bool(scrubbed)))
    return spark.createDataFrame(full, model.JOURNAL)


def test_cycles_and_dangling_chains_are_inert(spark):
    j = journal(spark, (1, "remark", None, 7, "a"), (2, "revision", 1, None, "b"), (3, "revision", 4, None, "c"), (4, "revision", 3, None, "d"), (5, "revision", 5, None, "e"), (6, "revision", 99, None, "f"), (7, "revision", 2, None, "g"))
    assert {(r.id, r.root) for r in J.revision_roots(j).collect()} == {(2, 1), (7, 1)}


def test_a_long_chain_reaches_its_root(spark):
    j = journal(spark, (0, "remark", None, 1, "x"), *((i, "revision", i - 1, None, f"r{i}") for i in range(1, 70)))
    assert {r.root for r in J.revision_roots(j).collect()} == {0}
    assert [tuple(r) for r in J.effective_texts(j).collect()] == [(0, "r69", True)]


def test_a_retracted_newest_revision_falls_back(spark):
    j = journal(spark, (1, "remark", None, 7, "a"), (2, "revision", 1, None, "b"), (3, "revision", 2, None, "c"), (4, "retraction", 3))
    assert [tuple(r) for r in J.effective_texts(j).collect()] == [(1, "b", True)]


def test_last_ts_follows_the_greatest_id(spark):
    j = journal(spark, (1, "remark", None, 7, "a", None, False, 500), (2, "rating", None, 7, None, 3, False, 100))
    row = J.image_stats(j).head()
    assert row.last_ts == T0 + dt.timedelta(seconds=100) and row.event_count == 2 and row.has_text and not row.has_strokes


def test_scrubbed_events_count_but_carry_nothing(spark):
    j = journal(spark, (1, "remark", None, 7, None, None, True), (2, "stroke", None, 7, None, None, True))
    row = J.image_stats(j).head()
    assert (row.event_count, row.has_text, row.has_strokes, row.stroke_count) == (2, False, False, 0)
    assert {r.entry for r in J.entries(j).collect()} == {"redacted"}


def test_zero_is_a_rating(spark):
    j = journal(spark, (1, "rating", None, 7, None, 5), (2, "rating", None, 7, None, 0), (3, "rating", None, 8, None, 4), (4, "retraction", 3))
    assert [(r.image, r.rating) for r in J.current_ratings(j).collect()] == [(7, 0)]


def test_redaction_takes_the_whole_chain(spark):
    j = journal(spark, (1, "remark", None, 7, "a"), (2, "revision", 1, None, "b"), (3, "revision", 2, None, "c"), (4, "stroke", None, 7), (5, "rating", None, 7, None, 1))
    events, refused = J.redact(j, spark.createDataFrame([(2,), (5,), (77,)], "id long"), first_id=100)
    assert sorted((r.id, r.target_event) for r in events.collect()) == [(100, 1), (101, 2), (102, 3)]
    assert {tuple(r) for r in refused.collect()} == {(5, "kind"), (77, "missing")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_does_not_depend_on_order(spark, seed):
    rng = random.Random(seed)
    rows = [(0, "remark", None, 1, "t0")]
    for i in range(1, 40):
        kind = rng.choice(["remark", "rating", "stroke", "revision", "retraction", "redaction"])
        target = rng.randrange(i) if kind in model.META_KINDS else None
        rows.append((i, kind, target, None if target is not None else rng.randrange(5), f"t{i}" if kind in ("remark", "revision") else None, rng.randrange(6) if kind == "rating" else None))
    cut = rng.sample(range(40), 25)
    a, b = [r for r in rows if r[0] in cut], [r for r in rows if r[0] not in cut[:10]]
    one = {tuple(r) for r in J.merge_events(journal(spark, *a), journal(spark, *b))[0].collect()}
    again = {tuple(r) for r in J.merge_events(J.merge_events(journal(spark, *a), journal(spark, *b))[0], journal(spark, *b))[0].collect()}
    assert one == again


def test_empty_journal(spark):
    j = spark.createDataFrame([], model.JOURNAL)
    for fold in (J.revision_roots, J.effective_texts, J.effective_targets, J.entries, J.image_stats, J.current_ratings, J.redaction_registry):
        assert fold(j).count() == 0


def test_validity(spark):
    j = journal(spark, (1, "rating", None, 7, None, 6), (2, "rating", None, 7, None, 5), (3, "remark", 1, 7, "x"), (4, "revision", 1, 7, "x"))
    assert [r.id for r in j.where(model.valid_event()).collect()] == [2]
