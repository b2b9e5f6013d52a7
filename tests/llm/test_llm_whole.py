"""Training-data operators lose nothing to one odd row."""

import math

import numpy as np

from silvergrain.llm import chat, neardup

MESSAGES = f"conv_id long, turn long, role string, content string, calls {chat.CALLS}, result_of string"


def _call(name):
    return [(name, "t", "{}")]


def _places(spark, rows):
    return {(r.conv_id, r.content): (r.anchor_turn, r.level) for r in chat.format_chats(spark.createDataFrame(rows, MESSAGES), {"t": {}}).collect()}


def test_a_circle_moves_no_other_call(spark):
    good = [(1, 0, "tool", "x", None, "b"), (1, 1, "tool", "y", _call("b"), "a"), (1, 5, "assistant", "z", _call("a"), None)]
    own = [(2, 3, "tool", "self", _call("s"), "s"), (3, 1, "tool", "p", _call("p"), "q"), (3, 2, "tool", "q", _call("q"), "p"), (3, 0, "tool", "behind", _call("r"), "p"), (3, 7, "assistant", "free", _call("f"), None), (3, 4, "tool", "late", None, "f")]
    got = _places(spark, good + own)
    assert (got[1, "z"], got[1, "y"], got[1, "x"]) == ((5, 0), (5, 1), (5, 2))
    assert got[2, "self"] == (3, 1)
    assert (got[3, "p"], got[3, "q"], got[3, "behind"]) == ((2, 1), (2, 0), (1, 1))
    assert (got[3, "free"], got[3, "late"]) == ((7, 0), (7, 1))


def test_chains_of_any_depth_are_placed(spark):
    n = 75
    rows = [(1, n - k, "tool", str(k), _call(f"c{k}"), f"c{k - 1}" if k else None) for k in range(n)]
    rows += [(2, 0, "tool", "lost", _call("l"), "missing"), (2, 1, "tool", "on", _call("o"), "l")]
    got = _places(spark, rows)
    assert [got[1, str(k)] for k in range(n)] == [(n, k) for k in range(n)]
    assert (got[2, "lost"], got[2, "on"]) == ((0, 0), (1, 0))


def test_pairs_that_collide_once_are_linked(spark):
    n, rng = 1000, np.random.default_rng(3)
    a, b = rng.standard_normal((2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.905 * a + math.sqrt(1 - 0.905**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    signs, tables = neardup.calibrate(2 * n)
    x, y = neardup.Signatures(a, signs, tables), neardup.Signatures(b, signs, tables)
    met = ((x.bucket == y.bucket) & (np.abs(x.place - y.place) <= neardup.WINDOW_SIGMAS * math.sqrt(2 - 2 * neardup.COSINE))).sum(axis=1)
    assert (met == 1).sum() >= 5
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(n)] == (met > 0).astype(int).tolist()
