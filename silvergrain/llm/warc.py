"""Legacy ARC archives and their conversion to WARC.

``write_arcs`` packs pages into ARC files of version 1 or 2. ``convert`` turns ARC files into
WARC files: it parses the version block, then each record by the header line of that version;
the declared length alone says where a record ends, so files may be plain, compressed as one
member, or a member a record. It synthesises record ids (a UUID of URI, date, digest and place),
WARC dates from the 14 digits, types and SHA-1 digests; and writes a record per member. HTTP
responses stay responses; of those with equal payloads of ``MIN_BYTES`` or more one is the
response, the others become revisits that refer to it. Blocks of other kinds (``dns:`` answers, pages
without an HTTP head) become resources, the block being the payload. ``read_warcs`` reads WARC
files back, plain ones too.

Which records share a payload is found by a table of (digest, place), so no payload is ever
shuffled, and a digest that a third of the records carry is one row a task after partial
aggregation.

Header lines are taken as bytes and split from the right, so a URL may hold spaces; bytes that
are no UTF-8 are read as Latin-1, and what a URI can't hold is percent-encoded.

Edge cases: a file that breaks off inside a record, a record without its version's fields and
a file without a version block raise; a null html is an empty payload, a null url ``about:blank``; characters that an
ARC header line can't hold are percent-encoded in the target URI; of repeated rows with the
largest id one is the response; a null id has no rank, so it is a response only where no
record with an id has its payload; an empty table writes no files; other columns stay out.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import new_folder, open_fs, rechunk, written

#: Payloads shorter than this stay responses.
MIN_BYTES = 1000
#: Files begin anew after so many bytes (of members) or records, so a task's list of places stays small.
FILE_BYTES = 64 << 20
FILE_RECORDS = 50_000
READ_BYTES, FEED_BYTES, MOST_LINE = 1 << 20, 1 << 14, 1 << 20
#: When pages without a capture time were taken, in seconds; a page's id is added.
EPOCH = 1_577_836_800
SHORT_FIELDS = ("url", "ip", "date", "type", "length")
#: The header lines of the two versions of the legacy format.
FIELDS = {
    b"1": SHORT_FIELDS,
    b"2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs


def member(data: bytes) -> bytes:
    """``data`` as a gzip member of its own, without a time."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bytes:
    """The bytes of a plain or gzip file of any number of members, read forward; ``at`` counts them as unpacked."""

    def __init__(self, stream: io.RawIOBase):
        self.stream, self.held, self.pos, self.at = stream, b"", 0, 0
        self.raw, self.next, self.unzip = stream.read(READ_BYTES) or b"", 0, None
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def _chunk(self) -> bytes:
        """The next bytes as unpacked; none at the end."""
        while True:
            if self.next == len(self.raw):
                self.raw, self.next = self.stream.read(READ_BYTES) or b"", 0
            if not self.raw:
                if self.unzip:
                    raise ValueError("the archive ends inside a record")
                return b""
            if not self.packed:
                self.next = len(self.raw)
                return self.raw
            if not self.unzip:
                if self.raw[self.next] == 0:  # padding between members
                    self.next += 1
                    continue
                self.unzip = zlib.decompressobj(31)
            fed = self.raw[self.next : self.next + FEED_BYTES]  # short, as what a member leaves of it is copied
            out = self.unzip.decompress(fed)
            self.next += len(fed) - len(self.unzip.unused_data)
            if self.unzip.eof:
                self.unzip = None
            if out:
                return out

    def _fill(self, n: int) -> bool:
        """Hold ``n`` bytes from the place on, if there are as many."""
        have = len(self.held) - self.pos
        if have >= n:
            return True
        parts = [self.held[self.pos :]]
        while have < n and (more := self._chunk()):
            parts.append(more)
            have += len(more)
        self.held, self.pos = b"".join(parts), 0
        return have >= n

    def read(self, n: int) -> bytes:
        if not self._fill(n):
            raise ValueError("a record is shorter than it declares")
        out = self.held[self.pos : self.pos + n]
        self.pos, self.at = self.pos + n, self.at + n
        return out

    def line(self) -> bytes | None:
        """The bytes up to a line feed, which is passed over; None at the end."""
        if not self._fill(1):
            return None
        looked = 0
        while (end := self.held.find(b"\n", self.pos + looked)) < 0:
            looked = len(self.held) - self.pos
            if looked > MOST_LINE:
                raise ValueError("a header line has no end")
            if not self._fill(looked + 1):
                end = len(self.held)
                break
        out = self.held[self.pos : end]
        passed = min(end + 1, len(self.held)) - self.pos
        self.pos, self.at = self.pos + passed, self.at + passed
        return out


# ---------------------------------------------------------------- ARC


def arc_header(version: bytes, url: str, date: str, kind: str, length: int, offset: int = 0, filename: str = "-") -> bytes:
    values = {"url": url, "ip": "0.0.0.0", "date": date, "type": kind, "code": "200", "checksum": "-", "location": "-", "offset": str(offset), "filename": filename, "length": str(length)}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


def arc_version_block(version: bytes, filename: str, date: str) -> bytes:
    body = version + b" 0 silvergrain\n" + TITLES[version] + b"\n"
    header = dict(url=f"filedesc://{filename}", ip="0.0.0.0", date=date, type="text/plain", length=str(len(body) + 1))
    return " ".join(header[f] for f in SHORT_FIELDS).encode() + b"\n" + body + b"\n"


def _decoded(field: bytes) -> str:
    try:
        return field.decode()
    except UnicodeDecodeError:
        return field.decode("latin-1")


def arc_records(stream: io.RawIOBase) -> Iterator[tuple[int, dict, bytes]]:
    """Place (in the unpacked bytes), header fields and block of each record of an ARC file, by the version that it declares."""
    data = Bytes(stream)
    line = data.line()
    if line is None:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError("no version block at the archive's start")
    version, titles, *_ = [*data.read(_length(line.rsplit(b" ", 1)[-1])).split(b"\n"), b""]
    fields = FIELDS.get(version.split(b" ")[0])
    if fields is None or len(titles.strip().split(b" ")) != len(fields):
        raise ValueError(f"unknown version of the archive: {version[:40]!r}")
    while True:
        at, line = data.at, data.line()
        if line is None:
            return
        line = line.rstrip(b"\r")
        if not line:  # records are set apart by line feeds
            continue
        values = line.rsplit(b" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in a header line of {len(fields)}")
        header = {f: _decoded(v) for f, v in zip(fields, values, strict=True)}
        yield at, header, data.read(_length(values[-1]))


def _length(digits: bytes) -> int:
    if not digits.strip().isdigit():
        raise ValueError(f"no length: {digits[:40]!r}")
    return int(digits)


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """The head of an HTTP response with its blank line, its fields in lower case, the payload; a block of another kind is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    ends = [(at, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := block.find(gap)) >= 0]
    at, gap = min(ends, default=(len(block), 0))
    fields = {}
    for line in block[:at].split(b"\n")[1:]:
        name, _, value = line.partition(b":")
        fields[_decoded(name.strip()).lower()] = _decoded(value.strip())
    return block[: at + gap], fields, block[at + gap :]


def target_uri(url: str) -> str:
    """``url`` with what a URI can't hold percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"


def stamp(seconds: int) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).strftime("%Y%m%d%H%M%S")


class _Files:
    """Writes members to files of bounded size in ``folder``; each file appears when it is whole."""

    def __init__(self, folder: str, part: int, suffix: str):
        self.folder, self.part, self.suffix, self.number, self.out, self.done = folder, part, suffix, 0, None, []

    def room(self) -> bool:
        """Whether an open file has room; else the next ``add`` starts one."""
        if self.out and (self.bytes >= FILE_BYTES or self.records >= FILE_RECORDS):
            self.close()
        return self.out is not None

    def start(self) -> str:
        self.name = f"part-{self.part:06d}-{self.number:04d}.{self.suffix}"
        self.fs, self.path = open_fs(f"{self.folder}/{self.name}")
        self.attempt = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.bytes, self.records = self.fs.open_output_stream(self.attempt, compression=None), 0, 0
        return self.name

    def add(self, data: bytes) -> None:
        z = member(data)
        self.out.write(z)
        self.bytes += len(z)
        self.records += 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.attempt, self.path)
            self.done.append((f"{self.folder}/{self.name}", self.records, self.bytes))
            self.out, self.number = None, self.number + 1


FILES = "path string, n_records long, n_bytes long"
_FILES_ARROW = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _listing(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_FILES_ARROW.names, d, strict=True)) for d in done], _FILES_ARROW)


def write_arcs(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pack ``pages`` into ARC files, by partition of version 1 or 2 in turn; a table with a row a file. Runs a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = b"1" if part % 2 == 0 else b"2"
        files = _Files(folder, part, "arc.gz")
        for batch in rechunk(batches, 256):
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                date = stamp(EPOCH + (i or 0) % (10 * 365 * 86400))
                if not files.room():
                    files.add(arc_version_block(version, files.start(), date))
                payload = (h or "").encode()
                own = "" if i is None else f"X-Page-Id: {i}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                files.add(arc_header(version, target_uri(u or ""), date, "text/html", len(head) + len(payload), files.bytes, files.name) + head + payload + b"\n")
        files.close()
        if files.done:
            yield _listing(files.done)

    return written(pages.select(F.col(key).cast("long"), url, html).mapInArrow(run, FILES), "arc-files")


# ---------------------------------------------------------------- conversion


def record_id(uri: str, date: str, digest: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((uri, date, digest, place)))}>"


def warc_date(digits: str) -> str:
    """ISO date of the 14 digits; missing ones are the earliest they can be."""
    digits = "".join(c for c in digits if c in "0123456789")[:14]
    full = digits + "00000101000000"[len(digits):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, *lines]) + "\r\n").encode() + block + b"\r\n\r\n"


PLACES = "file string, place long, http boolean, rank long, uri string, date string, digest string, n_bytes long, id string"
_PLACES_ARROW = pa.schema([("file", pa.string()), ("place", pa.int64()), ("http", pa.bool_()), ("rank", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64()), ("id", pa.string())])


def _page_id(http: dict[str, str]) -> int | None:
    own = http.get("x-page-id", "")
    return int(own) if own.lstrip("-").isdigit() else None


def _file_name(path: str) -> str:
    return path.rpartition("/")[2]


def places(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """A row per record of the ARC files: its place, payload digest and WARC id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_fs(path)
                rows = []
                with fs.open_input_stream(inner, compression=None) as stream:
                    for at, header, block in arc_records(stream):
                        head, http, payload = split_http(block)
                        digest, uri = hashlib.sha1(payload).hexdigest(), target_uri(header["url"])
                        rows.append((path, at, bool(head), _page_id(http), uri, warc_date(header["date"]), digest, len(payload), record_id(uri, header["date"], digest, f"{_file_name(path)}@{at}")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACES_ARROW, strict=True)], schema=_PLACES_ARROW)

    return _paths(arcs).mapInArrow(run, PLACES)


def _paths(files: DataFrame) -> DataFrame:
    """The files' paths, about a task a file."""
    return files.select("path").repartition(max(1, files.count()), "path")


def revisits(found: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """Of records with equal payloads, those that refer to another: (file, place, id, uri, date) of the other as ``to``.

    The record with the greatest rank, then the last place, is the one referred to.
    """
    order = F.struct(F.col("rank"), F.col("file"), F.col("place"))
    long_ones = found.where((F.col("n_bytes") >= least) & F.col("http"))
    kept = long_ones.groupBy("digest", "n_bytes").agg(F.max(F.struct(order.alias("o"), "id", "uri", "date")).alias("to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return long_ones.join(kept.hint("merge"), ["digest", "n_bytes"]).where((F.col("file") != F.col("to.o.file")) | (F.col("place") != F.col("to.o.place"))).select("file", "place", F.struct("to.id", "to.uri", "to.date").alias("to"))


def convert(spark: SparkSession, arcs: DataFrame, folder: str, least: int = MIN_BYTES) -> DataFrame:
    """Write the ARC files as WARC files, one each; a table with a row a file. Runs a job.

    A file's revisits come to its task as one row, no more than the file has records.
    """
    per_file = revisits(places(spark, arcs), least).groupBy("file").agg(F.collect_list(F.struct("place", "to")).alias("revisits"))
    work = _paths(arcs).join(per_file.hint("merge"), F.col("path") == F.col("file"), "left").select("path", "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refer = {x["place"]: x["to"] for x in listed or ()}
                fs, inner = open_fs(path)
                out = _Files(folder, 0, "warc.gz")
                name = _file_name(path).removesuffix(".gz").removesuffix(".arc") + ".warc.gz"
                out.fs, out.path = open_fs(f"{folder}/{name}")
                out.attempt = f"{out.path}.{uuid.uuid4().hex}.tmp"
                out.name, out.out, out.bytes, out.records = name, out.fs.open_output_stream(out.attempt, compression=None), 0, 0
                info = f"software: silvergrain\r\nformat: WARC File Format 1.1\r\nsource: {_file_name(path)}\r\n".encode()
                out.add(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "", "", "info")), ("WARC-Date", warc_date("")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
                with fs.open_input_stream(inner, compression=None) as stream:
                    for at, header, block in arc_records(stream):
                        head, _, payload = split_http(block)
                        digest, uri, to = hashlib.sha1(payload).hexdigest(), target_uri(header["url"]), refer.get(at)
                        fields = [
                            ("WARC-Type", "revisit" if to else "response" if head else "resource"),
                            ("WARC-Record-ID", record_id(uri, header["date"], digest, f"{_file_name(path)}@{at}")),
                            ("WARC-Date", warc_date(header["date"])),
                            ("WARC-Target-URI", uri),
                            ("WARC-IP-Address", header["ip"]),
                            ("WARC-Payload-Digest", "sha1:" + base32(digest)),
                            ("Content-Type", "application/http; msgtype=response" if head else "text/dns" if uri.startswith("dns:") else header["type"] or "application/octet-stream"),
                        ]
                        if to:
                            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", to["id"]), ("WARC-Refers-To-Target-URI", to["uri"]), ("WARC-Refers-To-Date", to["date"]), ("WARC-Truncated", "length")]
                        out.add(warc_record(fields, head if to else block))
                out.close()
                yield _listing(out.done)

    return written(work.mapInArrow(run, FILES), "warc-files")


# ---------------------------------------------------------------- reading

RECORDS = "record_id string, record_type string, uri string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, payload binary"


def warc_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (in lower case) and block of each record; digests of blocks are checked where they are told."""
    data = Bytes(stream)
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {}
        while line := (data.line() or b"").strip():
            name, _, value = line.partition(b":")
            fields[_decoded(name.strip()).lower()] = _decoded(value.strip())
        block = data.read(int(fields["content-length"]))
        if fields.get("warc-block-digest", "").startswith("sha1:") and "sha1:" + base32(hashlib.sha1(block).hexdigest()) != fields["warc-block-digest"]:
            raise ValueError(f"the block of {fields['warc-record-id']} is damaged")
        yield fields, block


def read_warcs(spark: SparkSession, warcs: DataFrame, payloads: bool = True) -> DataFrame:
    """Responses, resources and revisits of WARC files. A revisit's digest is the declared one, others' are taken of their payloads."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = T.StructType.fromDDL(RECORDS)
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_fs(path)
                rows: list[tuple] = []
                with fs.open_input_stream(inner, compression=None) as stream:
                    for fields, block in warc_records(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        _, http, payload = split_http(block) if kind != "resource" else (b"", {}, block)
                        told = fields.get("warc-payload-digest", "")
                        declared = base64.b32decode(told.removeprefix("sha1:")).hex() if told.startswith("sha1:") else None
                        digest = declared if kind == "revisit" else hashlib.sha1(payload).hexdigest()
                        if declared is not None and digest != declared:
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        n = len(payload) if kind != "revisit" else int(http.get("content-length", 0))
                        rows.append((fields["warc-record-id"], kind, fields["warc-target-uri"], fields["warc-date"], _page_id(http), n, digest, fields.get("warc-refers-to"), payload if payloads else None))
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return _paths(warcs).mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_BYTES) -> DataFrame:
    """Pages to ARC to WARC and back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    warcs = convert(spark, write_arcs(pages, new_folder(spark, "arc"), key, url, html), new_folder(spark, "warc"), least)
    read = read_warcs(spark, warcs, payloads=False).drop("payload")
    to = read.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least)).select(F.col("record_id").alias("__id"), F.col("page_id").alias("refers_to"))
    return read.join(to.hint("merge"), F.col("refers_to_id") == F.col("__id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

