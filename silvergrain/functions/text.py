"""Column functions on text: folding, tokens, n-grams, labels."""

from __future__ import annotations

import unicodedata
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> dict[str, str]:
    """Letters that Unicode takes apart into a letter and marks above or below it, and that letter; the marks by themselves become nothing."""
    marks = {chr(c) for c in range(0x300, 0x370)}
    found = {}
    for c in map(chr, range(0xC0, 0x10000)):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and unicodedata.category(c)[0] == "L" and marks.issuperset(apart[1:]):
            found[c] = apart[0]
    return found | dict.fromkeys(sorted(marks), "")


FOLDS = _folds()
MARKED, PLAIN = "".join(FOLDS), "".join(FOLDS.values())
#: Between tokens: anything but letters and digits of any script.
GAP = r"[^\p{L}\p{N}]+"
# Words at which no suggested phrase begins or ends.
STOP_WORDS = (
    "the a an and or but of to in on at for with is it this that was are be as by i im its my we so up "
    "out if no not just very really got get had has into"
).split()


def folded(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """The folded tokens of a text, in order."""
    return F.array_remove(F.split(folded(text), GAP), "")


def words(text: Column) -> Column:
    """Lower-case alphanumeric words, marks kept."""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def _window(word_array: Column, n: int, start: Column) -> Column:
    return F.slice(word_array, start, n)


def grams(word_array: Column, widths: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Phrases of the given widths that neither begin nor end with a stop word; single words have over two bytes."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    parts = []
    for n in widths:
        starts = F.when(F.size(word_array) >= n, F.sequence(F.lit(1), F.size(word_array) - (n - 1))).otherwise(F.array().cast("array<int>"))
        windows = F.transform(starts, partial(_window, word_array, n))
        ok = F.filter(windows, lambda w: ~F.array_contains(stop, F.element_at(w, 1)) & ~F.array_contains(stop, F.element_at(w, -1)))
        if n == 1:
            ok = F.filter(ok, lambda w: F.octet_length(F.element_at(w, 1)) > 2)
        parts.append(F.transform(ok, lambda w: F.array_join(w, " ")))
    return F.concat(*parts)


def collapsed(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")
