"""Word shingles of texts as sorted arrays of 64-bit hashes, and their compact transport."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

WIDTH = 5
#: Words a worker remembers the hash of.
REMEMBERED = 100_000
# Fixed odd multipliers, one a place in the shingle.
_PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of ``text``, sorted.

    A-Z are lower-cased; words lie between ASCII white space. Fewer words than ``width`` make
    one shingle, none make none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    key = h[:n] * _PLACES[0]
    for k in range(1, width):
        key += h[k : k + n] * _PLACES[k]
    key ^= key >> np.uint64(29)  # the top bits order and deal out shingles
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key.sort()
    return key[np.r_[True, key[1:] != key[:-1]]]


def digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; small ones take few bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def steps(ordered: np.ndarray) -> np.ndarray:
    """Sorted values as differences."""
    out = ordered.copy()
    out[1:] -= ordered[:-1]
    return out


def range_cuts(ordered: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of 64-bit values begins in sorted ``ordered``; one more than ranges."""
    edges = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
    return np.r_[np.searchsorted(ordered, edges), len(ordered)]


def by_range(batches: Iterator, key: str = "range") -> Iterator[tuple[int, list]]:
    """Rows of Arrow batches sorted by ``key``, gathered by its value."""
    at, rows = None, []
    for batch in batches:
        i = batch.schema.get_field_index(key)
        for k, row in zip(batch.column(i).to_pylist(), batch.to_pylist(), strict=True):
            if k != at and rows:
                yield at, rows
                rows = []
            at = k
            rows.append(row)
    if rows:
        yield at, rows
