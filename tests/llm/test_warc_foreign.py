"""Archives that others wrote: plain, one member, a member a record, of both versions, with odd headers."""

import gzip
import io

import pytest

from silvergrain.llm import warc
from silvergrain.llm.runtime import new_folder

LONG = b"<html>" + b"x" * 1500
HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n"
V1 = [
    (b"http://a.example/ 10.0.0.1 20010203040506 text/html %d", HTTP + LONG),
    (b"http://b.example/a b?q=\xe9 10.0.0.2 200102030405 text/html %d", HTTP + LONG),
    (b"dns:a.example 10.0.0.3 20010203 text/dns %d", b"20010203040506\na.example. 3600 IN A 10.0.0.1\n"),
    (b"http://c.example/ 10.0.0.4 20010203040506 text/html %d", b"HTTP/1.0 200 OK\nServer: old\n\n<p>line feeds only\n\nand a gap"),
    (b"http://d.example/ 10.0.0.5 20010203040506 text/html %d", LONG),
    (b"http://e.example/ 10.0.0.6 20010203040506 no-type %d", b""),
    (b"http://f.example/ 10.0.0.7 20010203040506 text/html %d", b"HTTP/1.0 304 Not Modified\r\nX-Page-Id: none"),
]
V2 = [(h.replace(b" %d", b" 200 - - 0 f.arc %d"), b) for h, b in V1]


def pieces_of(version, records):
    titles = warc.TITLES[version]
    body = version + b" 0 Other Crawler\n" + titles + b"\n"
    tail = b" 200 - - 0 f.arc" if version == b"2" else b""
    first = b"filedesc://f.arc 0.0.0.0 20010203040506 text/plain" + tail + b" %d\n" % len(body) + body + b"\n"
    return [first, *[h % len(b) + b"\n" + b + b"\n" for h, b in records]]


def packings(parts):
    whole = b"".join(parts)
    return {"plain": whole, "one": gzip.compress(whole), "each": b"".join(map(gzip.compress, parts)), "padded": b"".join(map(gzip.compress, parts)) + bytes(700)}


@pytest.mark.parametrize("version, records", [(b"1", V1), (b"2", V2)])
@pytest.mark.parametrize("packing", ["plain", "one", "each", "padded"])
def test_records_are_found_by_their_lengths(version, records, packing):
    data = packings(pieces_of(version, records))[packing]
    got = list(warc.arc_records(io.BytesIO(data)))
    assert [b for _, _, b in got] == [b for _, b in records]
    assert [h["url"] for _, h, _ in got][:3] == ["http://a.example/", "http://b.example/a b?q=é", "dns:a.example"]
    assert len({at for at, _, _ in got}) == len(got)
    if packing != "padded":
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(data[:-30])))


def test_blocks_of_every_kind():
    assert warc.split_http(V1[3][1]) == (b"HTTP/1.0 200 OK\nServer: old\n\n", {"server": "old"}, b"<p>line feeds only\n\nand a gap")
    assert warc.split_http(V1[2][1]) == (b"", {}, V1[2][1]) and warc.split_http(b"") == (b"", {}, b"")
    assert warc.split_http(V1[6][1])[2] == b""
    assert warc.warc_date("20010203") == "2001-02-03T00:00:00Z" and warc.warc_date("200102030405") == "2001-02-03T04:05:00Z"
    assert warc.target_uri("http://b.example/a b?q=é") == "http://b.example/a%20b?q=%C3%A9"


@pytest.mark.parametrize("bad", [b"", b"http://x/ 0.0.0.0 2001 text/html 3\nabc", b"filedesc://f 0.0.0.0 2001 text/plain x\n", b"filedesc://f 0.0.0.0 2001 text/plain 6\n9 0 X\n"])
def test_other_files_raise(bad):
    if not bad:
        assert list(warc.arc_records(io.BytesIO(bad))) == []
        return
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(bad)))


def test_foreign_archives_become_warcs(spark, tmp_path):
    for version, records in ((b"1", V1), (b"2", V2)):
        for name, data in packings(pieces_of(version, records)).items():
            if name != "padded":
                (tmp_path / f"{name}-{version.decode()}.arc{'' if name == 'plain' else '.gz'}").write_bytes(data)
    paths = [(f"file://{p}",) for p in sorted(tmp_path.iterdir())]
    warcs = warc.convert(spark, spark.createDataFrame(paths, "path string"), new_folder(spark, "foreign"))
    rows = warc.read_warcs(spark, warcs).collect()
    assert len(rows) == 6 * len(V1)
    kinds = [r.record_type for r in rows]
    # of twelve responses with one long payload one stays; the same bytes without an HTTP head are resources
    assert kinds.count("revisit") == 11 and kinds.count("resource") == 18 and kinds.count("response") == 13
    kept = next(r for r in rows if r.record_type == "response" and r.payload == LONG)
    assert {r.refers_to_id for r in rows if r.record_type == "revisit"} == {kept.record_id}
    dns = [r for r in rows if r.uri == "dns:a.example"]
    assert {(r.record_type, bytes(r.payload), r.date) for r in dns} == {("resource", V1[2][1], "2001-02-03T00:00:00Z")} and len({r.record_id for r in rows}) == len(rows)
    assert {r.uri for r in rows if r.uri.startswith("http://b")} == {"http://b.example/a%20b?q=%C3%A9"}


def test_a_plain_warc_is_read(spark, tmp_path):
    block = HTTP + b"hello"
    (tmp_path / "w.warc").write_bytes(warc.warc_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2001-01-01T00:00:00Z"), ("WARC-Target-URI", "http://a/")], block) * 2)
    rows = warc.read_warcs(spark, spark.createDataFrame([(f"file://{tmp_path}/w.warc",)], "path string")).collect()
    assert [(bytes(r.payload), r.payload_bytes, r.page_id) for r in rows] == [(b"hello", 5, None)] * 2


def test_many_small_members_are_read_in_linear_time():
    import time

    data = b"".join([warc.arc_version_block(b"1", "f", "2020")] + [b""])
    small = gzip.compress(b"http://x/ 0.0.0.0 20200101000000 text/plain 5\nhello\n")
    start = time.monotonic()
    assert sum(1 for _ in warc.arc_records(io.BytesIO(gzip.compress(data) + small * 40_000))) == 40_000
    assert time.monotonic() - start < 10
