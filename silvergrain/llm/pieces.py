"""SentencePiece BPE encoding and decoding without calling the library on texts.

The model file gives pieces and scores. Texts are cut at the places over which no piece
reaches (before a run of spaces, around a line feed), which leaves few different words;
each distinct word is encoded once per worker. A batch's new words become one flat array of
symbols. In each round every word looks up the rank of its symbol pairs, takes the least
(a segmented minimum), merges all its occurrences from the left at once, and words without
a pair left are taken out, until none remains.

The library merges one pair at a time, best score first, then leftmost. Merging all
occurrences at once is the same unless a merge makes a pair that ranks as well or better
than itself; the next round sees that, and such words (runs of spaces, mostly) are done
again one merge at a time. Words of over ``LONG`` characters are cut where no piece reaches over;
parts that stay as long are encoded from a heap of pairs, so time grows about as a text's length.

Edge cases: a null text is encoded as an empty one, to no ids; characters without a piece
become byte pieces, or the unknown piece if the model has none; bytes that form no
character decode to U+FFFD; repeated rows are encoded alike; an empty table stays empty;
other columns pass through ``encode_documents``, and those that bear an output's name give way.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import rechunk

SPACE = "▁"
NO_PAIR = np.int64(1) << np.int64(62)
#: Words a worker remembers; some 60 MB. Beyond, it keeps the first third and goes on. Longer words are not remembered.
REMEMBERED, REMEMBERED_CHARS = 200_000, 200
#: Longer words are cut where no piece reaches over; what stays longer is encoded one merge at a time.
LONG = 1024
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_models: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces, pair ranks and decoding tables of one BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no BPE model with the identity normaliser")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.size = len(proto.pieces)
        self.unknown = proto.trainer_spec.unk_id
        self.symbol = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        for c in sorted({c for p in self.symbol for c in p} - self.symbol.keys()):
            self.symbol[c] = self.size + len(self.symbol)  # a character that only longer pieces hold
        self.base = max([self.size, *self.symbol.values()]) + 2
        self.other = self.base - 1
        scores = sorted({p.score for p in proto.pieces if p.type == NORMAL}, reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        pairs = {}
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                for k in range(1, len(p.piece)):
                    a, b = self.symbol.get(p.piece[:k]), self.symbol.get(p.piece[k:])
                    if a is not None and b is not None:
                        pairs[a * self.base + b] = (rank[p.score], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)], np.int64)
        self.merged = np.array([pairs[k][1] for k in sorted(pairs)], np.int64)
        surfaces = [b"" if p.type == CONTROL else proto.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.surfaces = pa.array(surfaces, pa.large_binary())
        #: Whether a piece reaches from one word into the next, and whether none reaches over a line feed.
        self.inner = inner = any(SPACE in p.lstrip(SPACE) for p in self.symbol)
        self.own_line = own_line = not any("\n" in p and len(p) > 1 for p in self.symbol)
        #: Words: where no piece reaches over. A model with pieces that do gets whole texts.
        joints = sorted({ord(a) << 32 | ord(b) for p in self.symbol for a, b in zip(p, p[1:], strict=False)})
        #: Pairs of characters that some piece holds side by side.
        self.joints = np.array(joints, np.uint64)
        self.words = re.compile("(?s).+" if inner else " *+[^ \n]+|\n| +" if own_line else " *+[^ ]+| +")
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return self.words.findall(" " + text if self.prefix else text)

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 3))  # the first seen are the frequent ones
        split = [self.split(t or "") for t in texts]
        new = list(set().union(*split) - self.known.keys())
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            self.known.update(zip(part, self.encode_words(part), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]
        return out

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word; long words in parts."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if not long:
            return self._encode_together(words)
        parts = {i: self._parts(words[i]) for i in long}
        distinct = list({p for own in parts.values() for p in own})
        short = [p for p in distinct if len(p) <= LONG]
        coded = dict(zip(short, self._encode_together(short), strict=True)) | {p: np.array(self._encode_word(p), "<i4").tobytes() for p in distinct if len(p) > LONG}
        others = [w for w in words if len(w) <= LONG]
        rest = iter(self._encode_together(others))
        return [b"".join(map(coded.__getitem__, parts[i])) if i in parts else next(rest) for i in range(len(words))]

    def _parts(self, word: str) -> list[str]:
        """``word`` cut between characters that no piece holds side by side, so that no merge reaches over a cut."""
        codes = np.frombuffer(word.replace(" ", SPACE).encode("utf-32-le"), np.uint32).astype(np.uint64)
        pairs = codes[:-1] << np.uint64(32) | codes[1:]
        joined = self.joints[np.minimum(np.searchsorted(self.joints, pairs), len(self.joints) - 1)] == pairs if len(self.joints) else np.zeros(len(pairs), bool)
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _encode_together(self, words: Sequence[str]) -> list[bytes]:
        flat = "".join(words).replace(" ", SPACE)
        codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        chars, inverse = np.unique(codes, return_inverse=True)
        symbols = np.array([self.symbol.get(chr(c), self.other) for c in chars], np.int64)[inverse]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word, at = np.repeat(np.arange(len(words)), lengths), np.arange(len(flat))
        done_word, done_symbol, done_at, one_by_one = [], [], [], set()
        last = np.full(len(words), -1, np.int64)  # the rank of a word's last round, if that merged more than once
        rank, merged = self._ranks(symbols[:-1], symbols[1:], word[:-1] == word[1:])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best, owner = np.minimum.reduceat(rank, first), word[first]
            doubtful = best <= last[owner]
            one_by_one.update(owner[doubtful].tolist())
            over = (best == NO_PAIR) | doubtful
            if over.any():
                spans = np.diff(np.r_[first, len(word)])
                leave = np.repeat(over, spans)
                done_word.append(word[leave])
                done_symbol.append(symbols[leave])
                done_at.append(at[leave])
                stay = ~leave
                best = np.repeat(best, spans)[stay]
                symbols, word, at, rank, merged = symbols[stay], word[stay], at[stay], rank[stay], merged[stay]
                if not len(symbols):
                    break
            else:
                best = np.repeat(best, np.diff(np.r_[first, len(word)]))
            hit = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            offset = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[offset % 2 == 0]
            times = np.bincount(word[hit], minlength=len(words))
            last[word[hit]] = np.where(times[word[hit]] > 1, rank[hit], -1)
            symbols[hit] = merged[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, word, at, rank, merged = symbols[stay], word[stay], at[stay], rank[stay], merged[stay]
            hit -= np.arange(len(hit))  # each merge before it took one symbol away
            near = np.zeros(len(symbols), bool)
            near[hit] = near[np.maximum(hit - 1, 0)] = True
            changed = np.flatnonzero(near)
            after = np.minimum(changed + 1, len(symbols) - 1)
            rank[changed], merged[changed] = self._ranks(symbols[changed], symbols[after], (word[changed] == word[after]) & (changed != after), False)
        w, s, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_word, done_symbol, done_at))
        order = np.argsort(p)  # places rise from word to word
        w, s, p = w[order], s[order], p[order]
        single = s < self.size
        if not single.all():
            spelled = [[x] if ok else self._pieces_of(flat[place]) for x, ok, place in zip(s.tolist(), single.tolist(), p.tolist(), strict=True)]
            w = np.repeat(w, [len(x) for x in spelled])
            s = np.array([y for x in spelled for y in x], np.int64)
        ends = np.cumsum(np.bincount(w, minlength=len(words))) * 4
        data = s.astype("<i4").tobytes()
        ids = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(words) else []
        for i in one_by_one:
            ids[i] = np.array(self._encode_word(words[i]), "<i4").tobytes()
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray, pad: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of symbols its rank and what it merges to; ``pad`` adds a last symbol without a pair."""
        n = len(left) + pad
        rank, merged = np.full(n, NO_PAIR), np.zeros(n, np.int64)
        at = np.flatnonzero(joined & (left != self.other) & (right != self.other))
        pair = left[at] * self.base + right[at]
        i = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        ok = self.keys[i] == pair
        rank[at[ok]], merged[at[ok]] = self.ranks[i[ok]], self.merged[i[ok]]
        return rank, merged

    def _pieces_of(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _encode_word(self, word: str) -> list[int]:
        """One merge at a time: best rank, then leftmost."""
        chars = word.replace(" ", SPACE)
        symbols: list[int | None] = [self.symbol.get(c, self.other) for c in chars]
        left, right = list(range(-1, len(chars) - 1)), [*range(1, len(chars)), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.pairs.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(queue, (found[0], i, j, symbols[i], symbols[j]))

        for i in range(len(chars) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if symbols[i] != a or symbols[j] != b or right[i] != j:
                continue
            symbols[i], symbols[j] = self.pairs[a * self.base + b][1], None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for i, s in enumerate(symbols) if s is not None for x in ([s] if s < self.size else self._pieces_of(chars[i]))]

    def decode_batch(self, ids: pa.ListArray | pa.LargeListArray) -> pa.Array:
        """The texts of lists of ids."""
        offsets = ids.offsets.cast(pa.int64())
        start, end = offsets[0].as_py(), offsets[-1].as_py()
        parts = pa.LargeListArray.from_arrays(pc.subtract(offsets, start), self.surfaces.take(ids.values.slice(start, end - start)))
        joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).to_pylist()
        return pa.array([(t[1:] if self.prefix and t[:1] == b" " else t).decode("utf-8", "replace") for t in joined], pa.string())


def model(path: str) -> PieceModel:
    """The model of ``path``, loaded once a worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids_name: str = "ids", decoded_name: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text and, if named, the text decoded from those ids."""
    docs = docs.drop(ids_name, *([decoded_name] if decoded_name else []))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType(), False))])
    if decoded_name:
        schema.add(decoded_name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in rechunk(batches, 128):
            ids = _lists(pieces.encode_batch(batch.column(at).to_pylist()))
            more = [pieces.decode_batch(ids)] if decoded_name else []
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids_name: str = "ids", decoded_name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give an empty text."""
    encoded = encoded.drop(decoded_name)
    at = encoded.columns.index(ids_name)
    schema = T.StructType([*encoded.schema.fields, T.StructField(decoded_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            lists = pa.array(batch.column(at).to_pylist(), pa.list_(pa.int32())).fill_null([])
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces.decode_batch(lists)], names=schema.names)

    return encoded.mapInArrow(run, schema)
