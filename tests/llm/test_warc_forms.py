"""WARC records as other tools write them: header forms, lengths, charsets, gzip members, coded and chunked bodies."""

import email.parser
import gzip
import json
import zlib

import pytest

from passages.llm import warc

PAGE = "<title>Été</title><p>café <a href='/x'>y</a></p>"


def http(fields, body):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(f.encode() + b"\r\n" for f in fields) + b"\r\n" + body


def record(block, *fields, length=None):
    lines = ["WARC/1.0", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def conversion(spark, data):
    rows = spark.createDataFrame([(1, bytearray(data))], "page_id long, record binary")
    got = {r["kind"]: r for r in warc.derivatives(rows).collect()}
    return got.get("conversion"), json.loads(got["metadata"]["text"]) if "metadata" in got else None


@pytest.mark.parametrize(
    ("fields", "body"),
    [
        (["Content-Type:text/html;charset=iso-8859-1"], PAGE.encode("latin-1")),
        (["content-type: text/html; Charset=\"ISO-8859-1\""], PAGE.encode("latin-1")),
        (["CONTENT-TYPE: text/html;", "\tcharset='utf-8'"], PAGE.encode()),
        (["Content-Type: text/html; charset=idna"], PAGE.encode()),
        (["Content-Type: text/html; charset=undefined"], PAGE.encode()),
        (["Content-Type: text/html; charset=no-such"], PAGE.encode()),
        (["Content-Type: text/html; charset=hex"], PAGE.encode()),
        (["Content-Encoding: gzip"], gzip.compress(PAGE.encode())),
        (["content-encoding:X-GZIP"], gzip.compress(PAGE[:20].encode()) + gzip.compress(PAGE[20:].encode())),
        (["Content-Encoding: deflate"], zlib.compress(PAGE.encode())),
        (["Content-Encoding: deflate"], zlib.compress(PAGE.encode())[2:-4]),
        (["Transfer-Encoding: chunked"], b"5\r\n" + PAGE.encode()[:5] + b"\r\n%x;a=b\r\n" % (len(PAGE.encode()) - 5) + PAGE.encode()[5:] + b"\r\n0\r\n\r\n"),
        (["Transfer-Encoding: chunked"], PAGE.encode()),
        (["Transfer-Encoding: chunked", "Content-Encoding: gzip"], b"%x\r\n" % len(gzip.compress(PAGE.encode(), mtime=0)) + gzip.compress(PAGE.encode(), mtime=0) + b"\r\n0\r\n\r\n"),
        (["Content-Encoding: gzip"], PAGE.encode()),
    ],
)
def test_bodies(spark, fields, body):
    text, found = conversion(spark, record(http(fields, body), "WARC-Type:response", "WARC-Record-ID: <urn:uuid:1>"))
    assert text["text"] == "café y" and found["html"]["title"] == "Été" and text["refers_to"] == "<urn:uuid:1>"
    assert found["html"]["links"] == [{"path": "A@/href", "url": "/x", "text": "y"}] and found["payload_length"] == len(body)


def test_headers_are_those_of_another_parser():
    lines = ["A: 1", "b:2", "C :  3 ", "D: a: b", "E: one", "  two", "\tthree", "f:", "X-G:é"]
    first, got = warc.fields("\r\n".join(["HTTP/1.1 200 OK", *lines]))
    other = email.parser.Parser().parsestr("\n".join(x.replace(" :", ":") for x in lines) + "\n\n")
    assert first == "HTTP/1.1 200 OK" and got == {k: " ".join(v.split()) for k, v in other.items()}


@pytest.mark.parametrize("length", ["x", "-1", "", "1e3", "99999", "9" * 40])
def test_bad_lengths_end_the_file(length):
    whole = record(http([], b"<p>a</p>"), "WARC-Type: response")
    assert len(list(warc.records(whole + record(b"b", "WARC-Type: response", length=length) + whole))) == 1


def test_other_line_ends_and_types():
    data = b"WARC/1.1\nWARC-Type: Response\nContent-Length:3\n\nabc\n\n" + record(b"d", "WARC-Type: request")
    assert [(warc.field(h, "warc-type"), b) for h, b in warc.records(data)] == [("Response", b"abc"), ("request", b"d")]


def test_members_and_files(spark, tmp_path):
    parts = [record(http([], f"<p>{i}</p>".encode()), "WARC-Type: response", f"WARC-Record-ID: <{i}>") for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(parts))[:-20])
    rows = warc.derivatives(warc.read_warc(spark, str(tmp_path)), "path").filter("kind = 'conversion'").collect()
    texts = [sorted(r["text"] for r in rows if r["path"].endswith(name)) for name in ("a.warc.gz", "b.warc.gz")]
    assert texts[0] == ["0", "1", "2"] and texts[1] and texts[1] == ["0", "1", "2"][: len(texts[1])]


def test_unknown_coding_and_awkward_rows(spark):
    text, found = conversion(spark, record(http(["Content-Encoding: br"], b"\x01\x02"), "WARC-Type: response"))
    assert text["text"] == "" and found["unknown_coding"] == "br"
    text, _ = conversion(spark, record(b"no head <p>a", "WARC-Type: response"))
    assert text["text"] == "no head\na"
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"WARC/1.0\r\n")), (4, bytearray(gzip.compress(b"x")))], "page_id long, record binary")
    assert warc.derivatives(rows).count() == 0 and warc.derivatives(rows.limit(0)).count() == 0
    assert warc.responses(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
