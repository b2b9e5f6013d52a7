"""Token counts of texts without writing their ids: a broadcast table of frequent words, then worker caches.

Texts are cut into pre-tokens (words with the spaces before them, line feeds) in numpy, over the
UTF-8 bytes of a whole batch. A pre-token of up to ``SHORT`` bytes is packed with its length into
two 64-bit numbers, so it is compared whole, not by a hash of it. The first tier is an
open-addressing hash table of such numbers with the token counts of the ``TABLE_WORDS`` most
frequent pre-tokens of a sample, a few MB, broadcast to every executor; a batch looks all its
pre-tokens up at once. What it lacks goes to the second tier, a dictionary of each worker, which
encodes what it has not seen by merge rounds (``pieces``). So each document's count is made where
the document lies: nothing is shuffled.

The sample holds up to ``SAMPLE_TEXTS`` texts from the beginning of each of ``SAMPLE_PARTS``
partitions, spread evenly. It decides how fast the counts come, never what they are.

Edge cases: a null text counts as an empty one, with no bytes and no tokens; texts of any length
are cut and counted whole; words too long to remember are encoded where they stand; repeated rows
are counted alike; an empty table stays empty; other columns pass through, and those that bear an
output's name give way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import pieces
from .runtime import rechunk

#: Pre-tokens of more bytes are not in the table: two numbers hold fifteen bytes and their length.
SHORT = 15
#: Entries of the broadcast table; half of its slots of 18 bytes stay free.
TABLE_WORDS = 60_000
SAMPLE_PARTS, SAMPLE_TEXTS = 24, 64
#: Pre-tokens a worker remembers, and the bytes of the longest of them.
REMEMBERED, REMEMBERED_BYTES = 400_000, 128
#: Bytes of text that are cut at once, but for a longer single text.
CHUNK = 4 << 20
LIMIT = 4096
SPACE, LINE = 32, 10


def word_starts(data: np.ndarray, edges: np.ndarray, own_line: bool) -> np.ndarray:
    """Where pre-tokens begin in the bytes of texts that begin at ``edges``: at a run of spaces, at and after a line feed."""
    space = data == SPACE
    start = space.copy()
    start[1:] &= ~space[:-1]
    if own_line:
        line = data == LINE
        start |= line
        start[1:] |= line[:-1] & ~space[1:]
        # spaces before a line feed stand by themselves, as a line feed begins anew; spaces after it begin a word
    start[edges] = True
    return np.flatnonzero(start)


def packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each pre-token of up to SHORT bytes: its bytes, its length at the top; ``data`` has 16 bytes more behind."""
    windows = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))
    low, high = (np.ascontiguousarray(windows[starts + k]).view("<u8").reshape(-1) for k in (0, 8))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = sizes.astype(np.uint64)
    first, second = np.minimum(n, 8), np.maximum(n, 8) - np.uint64(8)
    low = np.where(first < 8, low & ~(ones << (first * np.uint64(8) % np.uint64(64))), low)
    high = high & ~(ones << (second * np.uint64(8)))  # seven bytes at most
    return low, high | n << np.uint64(56)


class LengthTable:
    """Token counts by packed pre-token; linear probing, all keys of a batch at once."""

    def __init__(self, counts: Mapping[bytes, int]):
        words = [w for w in counts if 0 < len(w) <= SHORT]
        slots = 1 << max(1, (2 * len(words)).bit_length())
        self.mask = np.uint64(slots - 1)
        self.low, self.high, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint16)
        if not words:
            return
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
        low, high = packed(data, np.cumsum(sizes) - sizes, sizes)
        n, left, slot = np.array([counts[w] for w in words], np.uint16), np.arange(len(words)), self._slot(low, high)
        while len(left):
            free = np.flatnonzero(self.high[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)  # one key a slot
            own = free[first]
            at, k = slot[own], left[own]
            self.low[at], self.high[at], self.n[at] = low[k], high[k], n[k]
            stay = np.ones(len(left), bool)
            stay[own] = False
            left, slot = left[stay], slot[stay]
            taken = self.high[slot] != 0
            slot[taken] = slot[taken] + np.uint64(1) & self.mask

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ high * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
        return (h ^ h >> np.uint64(32)) & self.mask

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The count of each key, -1 where it is not in the table."""
        out, left, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(left):
            there = self.high[slot]
            hit = (there == high[left]) & (self.low[slot] == low[left])
            out[left[hit]] = self.n[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on] + np.uint64(1) & self.mask
        return out


#: What this worker has encoded, by model: pre-token to its number of tokens.
_seen: dict[str, dict[bytes, int]] = {}


class TokenCounter:
    """Counts of batches of texts by one model, a table and this worker's cache."""

    def __init__(self, path: str, table: LengthTable):
        self.model, self.table, self.seen = pieces.model(path), table, _seen.setdefault(path, {})

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.model.inner:  # pieces reach over words: no pre-tokens
            return np.array([len(x) // 4 for x in self.model.encode_batch(texts.to_pylist())], np.int64)
        filled = np.flatnonzero(pc.binary_length(texts).to_numpy() > 0)
        out = np.zeros(len(texts), np.int64)
        if len(filled):
            out[filled] = self._filled(texts.take(pa.array(filled)))
        return out

    def _filled(self, texts: pa.Array) -> np.ndarray:
        data, edges = cut_bytes(texts, self.model.prefix)
        starts = word_starts(data[:-16], edges, self.model.own_line)
        sizes = np.diff(np.r_[starts, len(data) - 16])
        n = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        n[short] = self.table.find(*packed(data, starts[short], sizes[short]))
        missing = np.flatnonzero(n < 0)
        if len(missing):
            body = data.tobytes()
            n[missing] = self._missed([body[a:b] for a, b in zip(starts[missing].tolist(), (starts + sizes)[missing].tolist(), strict=True)])
        return np.add.reduceat(n, np.searchsorted(starts, edges))

    def _missed(self, words: list[bytes]) -> list[int]:
        if len(self.seen) > REMEMBERED:  # the first seen are the frequent ones
            for w in list(islice(self.seen, REMEMBERED // 3, None)):
                del self.seen[w]
        new = list(set(words) - self.seen.keys())
        coded = dict(zip(new, word_counts(self.model, new), strict=True))
        out = [coded[w] if w in coded else self.seen[w] for w in words]
        self.seen.update((w, k) for w, k in coded.items() if len(w) <= REMEMBERED_BYTES)
        return out


def cut_bytes(texts: pa.Array, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-empty texts as the model sees them, with 16 more behind, and where each text begins."""
    if pc.any(pc.match_substring(texts, pieces.SPACE)).as_py():
        texts = pc.replace_substring(texts, pieces.SPACE, " ")
    if prefix:
        texts = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(offsets[-1] - offsets[0] + 16, np.uint8)
    data[:-16] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0]


def word_counts(model: pieces.PieceModel, words: list[bytes]) -> list[int]:
    return [len(x) // 4 for x in model.encode_words([w.decode() for w in words])]


def sampled_words(docs: DataFrame, path: str, text: str = "text", parts: int = SAMPLE_PARTS, texts: int = SAMPLE_TEXTS, most: int = TABLE_WORDS) -> dict[bytes, int]:
    """Token counts of the ``most`` most frequent short pre-tokens in ``texts`` texts from each of ``parts`` partitions.

    Only those partitions are read, and only their beginnings; each sends ``most`` words at most.
    """
    rows = docs.select(text).rdd
    n = rows.getNumPartitions()
    chosen = sorted({i * n // parts for i in range(parts)}) if n else []

    def frequent(some: Iterable[Row]) -> Iterator[tuple[bytes, int]]:
        model, seen = pieces.model(path), Counter()
        for row in islice(some, texts):
            filled = pa.array([row[0]] if row[0] else [], pa.large_string())
            if len(filled) and not model.inner:
                data, edges = cut_bytes(filled, model.prefix)
                starts = word_starts(data[:-16], edges, model.own_line)
                body = data[:-16].tobytes()
                seen.update(w for w in map(body.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(body)])) if len(w) <= SHORT)
        return iter(seen.most_common(most))

    total: Counter[bytes] = Counter()
    for word, times in docs.sparkSession.sparkContext.runJob(rows, frequent, chosen) if chosen else []:
        total[word] += times
    words = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]
    return dict(zip(words, word_counts(pieces.model(path), words), strict=True))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(LengthTable(sampled_words(docs, path, text)))

    @F.arrow_udf("n_bytes long, n_tokens long")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = TokenCounter(path, shared.value)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            chunks = [counter.counts(part.column(0)) for part in rechunk(iter([batch]), 4096, 0, CHUNK)]
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.StructArray.from_arrays([n_bytes, pa.array(np.concatenate([np.zeros(0, np.int64), *chunks]))], ["n_bytes", "n_tokens"])

    made = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn("__sg_counted", counted(F.col(text)))
    return made.withColumns({"n_bytes": F.col("__sg_counted.n_bytes"), "n_tokens": F.col("__sg_counted.n_tokens"), "over_limit": F.col("__sg_counted.n_tokens") > limit}).drop("__sg_counted")
