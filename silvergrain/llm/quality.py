"""Quality rules as a short-circuit cascade.

Each rule is a predicate over one document that says *reject*. Before the main pass every
rule is timed on a bounded sample, together with how often it rejects; the cascade then
runs the rules by rejections per second of work, and a document leaves at the first rule
that rejects it. The order changes only the time: a document is kept if no rule rejects it.

Edge cases: a null or empty text has no words, so it fails the base rule and is not kept;
repeated rows are judged alike, each by itself; an empty table gives an empty result; other
columns of the input pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

import operator
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Rows on which rules are timed, twice as many at most; a documented sample, used for the order only.
SAMPLE_ROWS = 400
SAMPLE_SEED = 11

#: ASCII printing characters that are no letters.
NOT_LETTERS = bytes(c for c in range(33, 127) if not chr(c).isalpha())
UPPER = bytes(range(65, 91))


def repeated_window_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words lying in a window of ``window`` words that occurs twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    spread = _spread(len(number))[ids]
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + spread[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(window)):  # two windows with one key: compare the words
        return _repeated_exactly(ids, window)
    again = np.zeros(n, bool)
    again[a] = True
    again[b] = True
    return _covered(again, len(words), window)


def _repeated_exactly(ids: np.ndarray, window: int) -> int:
    n = len(ids) - window + 1
    _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, window), axis=0, return_inverse=True, return_counts=True)
    return _covered((counts >= 2)[inverse.reshape(n)], len(ids), window)


def _covered(starts: np.ndarray, n_words: int, window: int) -> int:
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _spread(n: int) -> np.ndarray:
    """A fixed well-mixed 64-bit value for each of the numbers below ``n``."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Doc:
    """One text with the features that rules ask for, each computed when first needed."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_window_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 20 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` looks at one document. ``name`` is what reports show."""

    name: str
    rejects: Callable[[Doc], bool]


def _few_letters(d: Doc) -> bool:
    other = len(d.raw) - len(d.raw.translate(None, NOT_LETTERS))
    return 10 * other > 6 * d.word_chars


def _shouting(d: Doc) -> bool:
    upper = len(d.raw) - len(d.raw.translate(None, UPPER))
    return 2 * upper > d.word_chars


def _duplicate_lines(d: Doc) -> bool:
    if not d.n_dup_lines:
        return False
    counts = Counter(d.lines)
    return 10 * sum((n - 1) * len(x) for x, n in counts.items()) > 3 * sum(n * len(x) for x, n in counts.items())


def _stutter(d: Doc) -> bool:
    return 10 * sum(map(operator.eq, d.words[1:], d.words)) > 3 * d.n_words


#: The production rules. Each asks for a clear majority signal, so ordinary prose of any
#: language or length passes all of them.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("stutter", _stutter),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words),
    Rule("few_letters", _few_letters),
    Rule("shouting", _shouting),
    Rule("base", lambda d: d.base_failed),
)


def first_rejection(doc: Doc, rules: Sequence[Rule]) -> str | None:
    """The name of the first rule that rejects ``doc``; later rules are not run."""
    return next((r.name for r in rules if r.rejects(doc)), None)


def measure(docs: DataFrame, rules: Sequence[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (rule, n, rejected, seconds) measured on about ``rows`` rows spread over ``docs``, never more than twice as many.

    Rows are drawn by their places, whatever they hold, so copies of one text are no likelier
    than others. A rule is timed on its own, from the bare text, so its cost holds the features
    it asks for.
    """
    total = docs.count()
    sample = docs.select(text).sample(min(1.0, rows / max(1, total)), SAMPLE_SEED).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = []
            for r in rules:
                began, rejected = time.perf_counter(), 0
                for t in texts:
                    rejected += bool(r.rejects(Doc(t)))
                out.append((r.name, len(texts), rejected, time.perf_counter() - began))
            names, n, rejected_, seconds = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n, pa.int64()), pa.array(rejected_, pa.int64()), pa.array(seconds, pa.float64())], ["rule", "n", "rejected", "seconds"])

    return (
        sample.mapInArrow(run, "rule string, n long, rejected long, seconds double")
        .groupBy("rule")
        .agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    )


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, best first. Only one row a rule comes to the driver."""
    found = {r["rule"]: (r["rejected"] + 0.01) / max(r["seconds"], 1e-9) for r in measure(docs, rules, text, rows).collect()}
    return sorted(rules, key=lambda r: (-found.get(r.name, 0.0), r.name))


def verdict_udf(rules: Sequence[Rule]) -> Callable[[str | Column], Column]:
    """A column function: the name of the first rule that rejects the text, null if it is kept."""
    order = list(rules)

    @F.arrow_udf(T.StringType())
    def rejected_by(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in texts:
            yield pa.array([first_rejection(Doc(t), order) for t in chunk.to_pylist()], pa.string())

    return rejected_by


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: ``key``, the base measures, ``kept`` and the rule that rejected it."""
    order = [r for r in plan_cascade(docs, rules, text) if r.name != "base"]
    schema = docs.select(key).schema.add("n_words", "long")
    for field in T.StructType.fromDDL(MEASURES).fields[1:]:
        schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                d = Doc(t)
                why = "base" if d.base_failed else first_rejection(d, order)
                out.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed, why is None, why))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def filter_documents(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    order = plan_cascade(docs, rules, text)
    flag = "__silvergrain_rejected_by"
    return docs.withColumn(flag, verdict_udf(order)(F.col(text))).where(F.col(flag).isNull()).drop(flag)
