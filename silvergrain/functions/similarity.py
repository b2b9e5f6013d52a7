"""String similarity: Jaro-Winkler, bounded edit distance, word error rate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    mine, theirs = [], [False] * len(b)
    for i, c in enumerate(a):
        lo, hi = max(0, i - reach), min(len(b), i + reach + 1)
        j = next((j for j in range(lo, hi) if not theirs[j] and free[j] == c), -1)
        if j >= 0:
            theirs[j] = True
            mine.append(c)
    if not mine:
        return 0.0
    other = [c for c, used in zip(b, theirs, strict=True) if used]
    moved = sum(x != y for x, y in zip(mine, other, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1, longest: int = 4, boost_from: float = 0.7) -> float:
    """Jaro, raised by the common prefix where it is over ``boost_from`` already."""
    j = jaro(a, b)
    if j <= boost_from:
        return j
    common = next((k for k, (x, y) in enumerate(zip(a[:longest], b[:longest], strict=False)) if x != y), min(len(a), len(b), longest))
    return j + common * prefix_weight * (1 - j)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def close(token: Column, value: Column) -> Column:
    """Whether ``value`` (lower case) holds the token, or one of its words is within the token's edit budget."""
    budget = F.when(F.length(token) <= 4, 1).otherwise(2)
    parts = F.filter(F.split(value, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    return value.contains(token) | F.exists(parts, lambda p: (F.abs(F.length(p) - F.length(token)) <= budget) & (F.levenshtein(token, p) <= budget))


def align(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a shortest alignment; the diagonal is preferred, then deletion.

    Costs are worked out a row at a time; of each cell only the move that leads to it is kept, a byte.
    """
    numbers: dict[str, int] = {}
    a = [numbers.setdefault(w, len(numbers)) for w in reference]
    b = np.array([numbers.setdefault(w, len(numbers)) for w in hypothesis], dtype=np.int64)
    places = np.arange(len(b) + 1)
    above = places
    moves = np.empty((len(a), len(b)), dtype=np.uint8)
    for i, word in enumerate(a):
        diagonal, down = above[:-1] + (b != word), above[1:] + 1
        row = np.minimum.accumulate(np.concatenate(([i + 1], np.minimum(diagonal, down))) - places) + places
        moves[i] = np.where(row[1:] == diagonal, 0, np.where(row[1:] == down, 1, 2))
        above = row
    i, j = len(a), len(b)
    counts = {"hit": 0, "sub": 0, "del": 0, "ins": 0}
    while i and j:
        move = moves[i - 1, j - 1]
        if move == 0:
            counts["hit" if a[i - 1] == b[j - 1] else "sub"] += 1
            i, j = i - 1, j - 1
        elif move == 1:
            counts["del"] += 1
            i -= 1
        else:
            counts["ins"] += 1
            j -= 1
    return counts["hit"], counts["sub"], counts["del"] + i, counts["ins"] + j
