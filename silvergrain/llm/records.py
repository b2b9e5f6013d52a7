"""Token ids as length-delimited binary records with masked checksums and an offset index.

A data file is a run of frames: the payload's length as 8 bytes, a masked CRC-32C of those
bytes, the payload, a masked CRC-32C of the payload (little-endian throughout; the frames of
the common record format that training loaders read). A payload is a header of 16 bytes
(version, bytes an id, flags, 5 zero bytes, the 64-bit document id) and the ids, 2 bytes
each if the vocabulary allows and else 4. Beside each data file an index file holds 24 bytes
a record: offset of its frame, number of ids, document id; so a loader can read records in
any order, as ``read_shuffled`` does. ``manifest`` has a row a file with the number of ids
before it.

Documents are dealt by range of (id, hash of the text), so the files in order hold ascending
ids however unevenly ids are spread, and one id with many rows fills several files. A task
writes to a name of its own and renames at the end: a repeated task replaces equal bytes.

Edge cases: null texts are encoded as empty ones and have only the end id; null document ids
come first, flagged in the header; rows with equal ids are ordered by the text's hash, rows
equal in both are equal; an empty table gives no files and no rows; texts of any length are
one record.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import new_folder, open_fs, rechunk, running_total, written

VERSION = 1
NULL_ID = 1
HEADER = np.dtype([("version", "u1"), ("width", "u1"), ("flags", "u1"), ("zero", "u1", 5), ("doc_id", "<i8")])
INDEX = np.dtype([("offset", "<u8"), ("n_tokens", "<u8"), ("doc_id", "<i8")])
BLOCK = 512
#: Chunks of text a worker remembers the ids of.
REMEMBERED = 500_000
#: Texts of so many bytes are encoded at once.
TEXT_BYTES = 4 << 20
#: A file's index stays in memory while it is written; files begin anew after so many records.
FILE_RECORDS = 200_000
FILE_BYTES = 256 << 20
#: The read side gets so many bytes at a time.
READ_BYTES = 8 << 20

# ---------------------------------------------------------------- checksums


@cache
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables for one word of 4 bytes, and for ``BLOCK`` bytes of zeros."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0x82F63B78), first >> 1)
    word = [first]
    for _ in range(3):
        word.append((word[-1] >> 8) ^ first[word[-1] & 255])
    tables = np.array(word, np.uint32)
    shift = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK // 4):
        shift = _step(shift, tables)
    return tables, shift


def _step(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[3][crc & 255] ^ tables[2][(crc >> 8) & 255] ^ tables[1][(crc >> 16) & 255] ^ tables[0][crc >> 24]


def crc32c(parts: Sequence[bytes]) -> np.ndarray:
    """CRC-32C of each of ``parts`` (4 bytes each at least), all blocks of all parts at once."""
    tables, shift = _crc_tables()
    if not parts:
        return np.zeros(0, np.uint32)
    blocks = np.array([-(-len(p) // BLOCK) for p in parts])
    ends = np.cumsum(blocks) * BLOCK
    padded = np.zeros(int(ends[-1]), np.uint8)
    for p, end in zip(parts, ends.tolist(), strict=True):  # zeros in front change nothing while the register is zero
        padded[end - len(p) : end] = np.frombuffer(p, np.uint8)
        padded[end - len(p) : end - len(p) + 4] ^= 255
    words = np.ascontiguousarray(padded.view("<u4").reshape(-1, BLOCK // 4).T)
    crc = np.zeros(words.shape[1], np.uint32)
    for row in words:
        crc = _step(crc ^ row, tables)
    start = np.cumsum(blocks) - blocks
    out = np.zeros(len(parts), np.uint32)
    for k in range(int(blocks.max())):
        more = np.flatnonzero(blocks > k)
        before = out[more]
        out[more] = shift[0][before & 255] ^ shift[1][(before >> 8) & 255] ^ shift[2][(before >> 16) & 255] ^ shift[3][before >> 24] ^ crc[start[more] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: Sequence[bytes]) -> list[bytes]:
    """The payloads as frames."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    head, tail = masked(crc32c(lengths)), masked(crc32c(payloads))
    return [b"".join((n, h.tobytes(), p, t.tobytes())) for n, h, p, t in zip(lengths, head.astype("<u4"), payloads, tail.astype("<u4"), strict=True)]


def unframed(data: bytes, sizes: Sequence[int]) -> list[bytes]:
    """The payloads of whole frames of the given sizes; raises where a checksum is wrong."""
    at = np.cumsum([0, *sizes])[:-1].tolist()
    lengths = [data[a : a + 8] for a in at]
    payloads = [data[a + 12 : a + n - 4] for a, n in zip(at, sizes, strict=True)]
    if any(int.from_bytes(n, "little") != len(p) for n, p in zip(lengths, payloads, strict=True)):
        raise ValueError("a record's length differs from the index")
    said = np.array([[int.from_bytes(data[a + 8 : a + 12], "little"), int.from_bytes(data[a + n - 4 : a + n], "little")] for a, n in zip(at, sizes, strict=True)], np.uint32).reshape(-1, 2)
    if (said[:, 0] != masked(crc32c(lengths))).any() or (said[:, 1] != masked(crc32c(payloads))).any():
        raise ValueError("a record's checksum is wrong")
    return payloads


# ---------------------------------------------------------------- encoding

#: Letters of Latin scripts, all letters to the tokenizer's pattern too.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Chunks that are one pre-token, also when run together.
SPACED_WORD = re.compile(f" [{LETTERS}]+")
# Kinds of bytes: letter, digit, other printing or control character, apostrophe, space, other
# white space, part of a character unknown here, part of one that may be white space.
LETTER, DIGIT, OTHER, QUOTE, SPACE, WHITE, HIGH, UNSURE = range(8)


def _kinds() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    of[128:] = HIGH
    for kind, chars in ((LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), (DIGIT, b"0123456789"), (QUOTE, b"'"), (SPACE, b" "), (WHITE, b"\t\n\v\f\r"), (UNSURE, b"\x1c\x1d\x1e\x1f")):
        of[list(chars)] = kind
    return of


def _pairs() -> np.ndarray:
    """Whether a pre-token surely ends between two bytes of the kinds; white space behind white space needs a look further."""
    cut = np.zeros((8, 8), bool)
    for a in (LETTER, DIGIT, OTHER, QUOTE):
        for b in (LETTER, DIGIT, OTHER, QUOTE):
            cut[a, b] = a != b and not (a in (OTHER, QUOTE) and b in (OTHER, QUOTE)) and not (a == QUOTE and b == LETTER)
    for a in (LETTER, DIGIT, OTHER, QUOTE, HIGH):
        cut[a, SPACE] = cut[a, WHITE] = cut[WHITE, a] = True
    return cut.reshape(-1)


KIND, CUT = _kinds(), _pairs()


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin that no pre-token reaches over, in the UTF-8 bytes of texts that begin at ``starts``."""
    kind = KIND[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
    lead = lead[lead + 2 < len(data)] if len(lead) else lead
    if len(lead):
        first, second, third = data[lead], data[lead + 1], data[lead + 2]
        latin = (first >= 0xC3) & (first <= 0xC9) & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) & ((first < 0xC9) | (second < 0x90))
        kind[lead[latin]] = kind[lead[latin] + 1] = LETTER
        two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
        spaces = (first == 0xE2) & (((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F)))
        three = spaces | ((first == 0xE1) & (second == 0x9A) & (third == 0x80)) | ((first == 0xE3) & (second == 0x80) & (third == 0x80))
        for at, n in ((lead[two], 2), (lead[three], 3)):
            for k in range(n):
                kind[at + k] = UNSURE
    for at in range(max(0, len(data) - 4), len(data)):  # the last bytes, which the look ahead above leaves out
        kind[at] = UNSURE if data[at] >= 128 else kind[at]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = CUT[kind[:-1] * np.uint8(8) + kind[1:]]
    white = (kind == SPACE) | (kind == WHITE)
    last = white[:-2] & white[1:-1] & ~white[2:] & (kind[2:] != UNSURE)  # the last of several in a row stands by itself
    last[starts[(starts >= 2) & (starts < len(data))] - 2] = False
    cut[1:-2] |= last
    cut[starts] = True
    return np.flatnonzero(cut[:-1])


_tokenizers: dict[str, ByteTokenizer] = {}


class ByteTokenizer:
    """Byte-level BPE by the tokenizers library, which sees each distinct chunk of text once a worker.

    Texts are cut into chunks in numpy, Arrow numbers the distinct ones of a batch, and their
    ids are gathered from one flat array of all known chunks' ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        shape = json.loads(self.library.to_str())
        self.added = [t["content"] for t in shape["added_tokens"]]
        pre = shape["pre_tokenizer"] or {}
        #: Whether texts may be cut; else the library gets whole texts.
        self.cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not shape["normalizer"] and not shape.get("truncation") and not shape.get("padding")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        #: Chunk to its number; ids of chunk i are ids[start[i] : start[i] + size[i]], and batches[i] batches held it.
        self.known: dict[bytes, int] = {}
        self.start, self.size, self.batches = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids, self.n_ids = np.zeros(8192, self.kind), 0

    def _library(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, chunks: Sequence[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, more = len(self.known), len(chunks)
        while n + more > len(self.start):
            self.start, self.size, self.batches = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.size, self.batches))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.start[n : n + more] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[n : n + more], self.batches[n : n + more] = sizes, 0
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        self.known.update(zip(chunks, range(n, n + more), strict=True))

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks; words with their space go to the library in one string, which numbers its pre-tokens."""
        texts = [c.decode() for c in chunks]
        words = [i for i, t in enumerate(texts) if SPACED_WORD.fullmatch(t)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            coded = self.library.encode("".join([texts[i] for i in part]), add_special_tokens=False)
            sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part))
            if len(sizes) == len(part):
                self._add([chunks[i] for i in part], np.array(coded.ids, self.kind), sizes)
        rest = [i for i, c in enumerate(chunks) if c not in self.known]
        for at in range(0, len(rest), 50_000):
            part = rest[at : at + 50_000]
            ids = self._library([texts[i] for i in part])
            self._add([chunks[i] for i in part], np.array([x for e in ids for x in e], self.kind), np.array([len(e) for e in ids], np.int64))

    def _forget(self) -> None:
        """Keep the chunks that most batches held."""
        n = len(self.known)
        keep = self.batches[:n] > max(1, int(np.partition(self.batches[:n], n - REMEMBERED // 2)[n - REMEMBERED // 2]))
        chunks = [c for c, k in zip(self.known, keep.tolist(), strict=True) if k]
        at = np.flatnonzero(keep)
        ids, sizes, batches = self.ids[_runs(self.start[at], self.size[at])], self.size[at], self.batches[at]
        self.known, self.n_ids = {}, 0
        self._add(chunks, ids, sizes)
        self.batches[: len(at)] = batches // 2

    def encode_batch(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text, ``width`` bytes each."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("").cast(pa.large_binary())
        if not len(column):
            return []
        if len(self.known) > REMEMBERED:
            self._forget()
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        body = raw.tobytes()
        added = [a for a in (t.encode() for t in self.added) if a in body]
        whole = [i for i in range(len(column)) if any(a in body[edges[i] : edges[i + 1]] for a in added)] if self.cut else list(range(len(column)))
        if not len(raw) or len(whole) == len(column):
            out = [b""] * len(column)
        else:
            starts = chunk_starts(raw, edges[:-1][edges[:-1] < len(raw)])
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
            distinct = chunks.dictionary.to_pylist()
            self._learn([c for c in distinct if c not in self.known])
            number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
            self.batches[number] += 1
            each = number[chunks.indices.to_numpy()]
            sizes = self.size[each]
            ids = self.ids[_runs(self.start[each], sizes)].tobytes()
            at = np.r_[0, np.cumsum(sizes, dtype=np.int64)][np.searchsorted(starts, edges)] * self.width
            out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if whole:
            ids = self._library([body[edges[i] : edges[i + 1]].decode() for i in whole])
            for i, e in zip(whole, ids, strict=True):
                out[i] = np.array(e, self.kind).tobytes()
        return out


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of the runs, one run after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of ``path``, loaded once a worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


# ---------------------------------------------------------------- files

MANIFEST = "part int, file int, path string, n_records long, n_tokens long, n_bytes long, min_id long, max_id long"


class _FileWriter:
    def __init__(self, folder: str, part: int, file: int):
        self.part, self.file, self.path = part, file, f"{folder}/part-{part:06d}-{file:04d}"
        self.fs, self.inner = open_fs(self.path)
        self.attempt = f"{self.inner}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.attempt)
        self.index: list[np.ndarray] = []
        self.records = self.tokens = self.bytes = 0
        self.lowest: int | None = None
        self.highest: int | None = None

    def write(self, ids: list[int | None], framed: list[bytes], counts: list[int]) -> None:
        rows = np.zeros(len(ids), INDEX)
        sizes = np.array([len(f) for f in framed], np.int64)
        rows["offset"] = self.bytes + np.cumsum(sizes) - sizes
        rows["n_tokens"], rows["doc_id"] = counts, [i or 0 for i in ids]
        self.index.append(rows)
        self.out.write(b"".join(framed))
        self.records, self.tokens, self.bytes = self.records + len(ids), self.tokens + sum(counts), self.bytes + int(sizes.sum())
        there = [i for i in ids if i is not None]
        if there:
            self.lowest = there[0] if self.lowest is None else self.lowest
            self.highest = there[-1]

    def close(self) -> tuple:
        self.out.close()
        with self.fs.open_output_stream(f"{self.attempt}.idx") as out:
            out.write(np.concatenate(self.index).tobytes())
        self.fs.move(f"{self.attempt}.idx", f"{self.inner}.idx")
        self.fs.move(self.attempt, f"{self.inner}.rec")
        return self.part, self.file, self.path, self.records, self.tokens, self.bytes, self.lowest, self.highest


def write_records(docs: DataFrame, path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` and write their records to ``folder``; the manifest, a row a file of up to 256 MB.

    Runs jobs. The manifest is the table ``manifest`` in ``folder``; ``start`` counts the ids
    of all files before.
    """
    spark = docs.sparkSession
    tie = "__sg_tie"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias(tie))
    dealt = rows.repartitionByRange(partitions, "doc_id", tie) if partitions else rows.repartitionByRange("doc_id", tie)
    dealt = dealt.sortWithinPartitions("doc_id", tie).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, writer, file, done = tokenizer(path), TaskContext.get().partitionId(), None, 0, []
        end = np.array([end_id], coder.kind).tobytes()
        for batch in rechunk(batches, 1024, 1, TEXT_BYTES):
            ids = batch.column(0).to_pylist()
            coded = coder.encode_batch(batch.column(1))
            heads = np.zeros(len(ids), HEADER)
            heads["version"], heads["width"] = VERSION, coder.width
            heads["flags"], heads["doc_id"] = [NULL_ID * (i is None) for i in ids], [i or 0 for i in ids]
            payloads = [h.tobytes() + c + end for h, c in zip(heads, coded, strict=True)]
            writer = writer or _FileWriter(folder, part, file)
            writer.write(ids, frames(payloads), [len(c) // coder.width + 1 for c in coded])
            if writer.records >= FILE_RECORDS or writer.bytes >= FILE_BYTES:
                done.append(writer.close())
                writer, file = None, file + 1
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], arrow)

    schema = spark.createDataFrame([], MANIFEST).schema
    names = schema.names
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
    files = written(dealt.mapInArrow(run, schema), "record-files")
    running_total(files, "part", "file", "n_tokens", "start").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _decoded(payloads: Sequence[bytes], counts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    heads = [np.frombuffer(p[: HEADER.itemsize], HEADER)[0] for p in payloads]
    if any(h["version"] != VERSION for h in heads):
        raise ValueError("a record's version is not known")
    wide = [np.frombuffer(p, f"<u{h['width']}", offset=HEADER.itemsize).astype("<u4").tobytes() for p, h in zip(payloads, heads, strict=True)]
    if [len(w) // 4 for w in wide] != counts.tolist():
        raise ValueError("a record's number of ids differs from the index")
    return pa.RecordBatch.from_arrays([
        pa.array([None if h["flags"] & NULL_ID else int(h["doc_id"]) for h in heads], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
        pa.array([zlib.crc32(w) for w in wide], pa.int64()), pa.array(wide, pa.binary()),
    ], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _index(fs: pafs.FileSystem, inner: str, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a file's records: offset, size, number of ids, ids of all records before."""
    with fs.open_input_file(f"{inner}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    at, counts = index["offset"].astype(np.int64), index["n_tokens"].astype(np.int64)
    return at, np.diff(np.r_[at, fs.get_file_info(f"{inner}.rec").size]), counts, start + np.cumsum(counts) - counts


def _by_file(manifest: DataFrame) -> DataFrame:
    """A task a file."""
    return manifest.repartitionByRange(max(1, manifest.count()), "part", "file").select("path", "start")


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of the files in order: doc_id, start, n_tokens, ids_crc32, ids as binary of 32-bit integers.

    Reads through the index, checks lengths and checksums, a few MB at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = open_fs(path)
                offsets, sizes, counts, starts = _index(fs, inner, start)
                with fs.open_input_file(f"{inner}.rec") as f:
                    at = 0
                    while at < len(offsets):
                        to = max(at + 1, int(np.searchsorted(offsets + sizes, offsets[at] + READ_BYTES)))
                        yield _decoded(unframed(f.read(int(sizes[at:to].sum())), sizes[at:to].tolist()), counts[at:to], starts[at:to])
                        at = to

    return _by_file(manifest).mapInArrow(run, RECORD)


def record_index(manifest: DataFrame) -> DataFrame:
    """The offset index of all files: path, offset, size, n_tokens, start of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                columns = _index(*open_fs(path), start)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0]), pa.string()), *map(pa.array, columns)], names=["path", "offset", "size", "n_tokens", "start"])

    return _by_file(manifest).mapInArrow(run, "path string, offset long, size long, n_tokens long, start long")


def read_wanted(wanted: DataFrame) -> DataFrame:
    """The records of rows of ``record_index``, in the rows' order within each partition.

    Each record is read by itself at its offset, so a loader may ask for any of them in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rechunk(batches, 256):
            path, offset, size, counts, starts = (c.to_pylist() for c in batch.columns)
            frames_: list[bytes] = [b""] * len(path)
            for p in dict.fromkeys(path):
                fs, inner = open_fs(p)
                with fs.open_input_file(f"{inner}.rec") as f:
                    for i in sorted((i for i, x in enumerate(path) if x == p), key=offset.__getitem__):
                        frames_[i] = f.read_at(size[i], offset[i])
            yield _decoded(unframed(b"".join(frames_), size), np.array(counts, np.int64), np.array(starts, np.int64))

    return wanted.select("path", "offset", "size", "n_tokens", "start").mapInArrow(run, RECORD)


def read_shuffled(manifest: DataFrame, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """All records in a random order given by ``seed``: only the index is shuffled, records are read where they lie."""
    rows = record_index(manifest).withColumn("__sg_order", F.xxhash64(F.lit(seed), "path", "offset"))
    dealt = rows.repartitionByRange(partitions, "__sg_order") if partitions else rows.repartitionByRange("__sg_order")
    return read_wanted(dealt.sortWithinPartitions("__sg_order"))


def round_trip(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as records and read them back."""
    return read_records(write_records(docs, path, end_id, folder or new_folder(docs.sparkSession, "records")))
