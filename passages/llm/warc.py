"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a metadata record (JSON: the source's WARC and HTTP headers, title, links) and a conversion record
(the visible text). Both name the response in WARC-Refers-To, carry its target, date and payload digest, and have
digests of their own. Record ids are derived from the response's, so a run repeated after a failure gives the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of URLs in RFC 4122
INSIDE = r"""(?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""  # of a tag: quoted values whole, as a ">" in them does not end it
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(script|style|noscript)\b{INSIDE}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9]*)({INSIDE})>"
    r"|<[/!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BLOCK = frozenset("address article aside blockquote br div dl dt dd fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
LINKS = {"a": "href", "area": "href", "img": "src", "link": "href", "iframe": "src", "source": "src", "form": "action"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def serialised(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


GZIP = b"\x1f\x8b"
HEAD_END = re.compile(rb"\r?\n\r?\n")


def fields(head: str) -> tuple[str, dict[str, str]]:
    """The first line and the fields of a header block. A name ends at the first colon, with or without a space behind it; a
    line that begins with white space goes on with the value before; of fields that differ in case only the last counts."""
    first, *lines = re.split(r"\r?\n", head)
    found: dict[str, tuple[str, str]] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t"):
            if last is not None:
                found[last] = (found[last][0], f"{found[last][1]} {line.strip()}".strip())
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = (name.strip(), value.strip())
    return first.strip(), dict(found.values())


def field(headers: dict[str, str], name: str, default: str = "") -> str:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), default)


def inflated(data: bytes, kind: str = "gzip") -> bytes:
    """All members of gzip data, or deflated data with or without its zlib header; what is broken ends it."""
    out = []
    while data:
        coder = zlib.decompressobj(31 if kind == "gzip" else 15 if data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0 else -15)
        try:
            while data and not coder.eof:
                out.append(coder.decompress(data, 1 << 20))
                data = coder.unconsumed_tail
                if not data and not coder.eof:
                    out.append(coder.flush())
        except zlib.error:
            break
        data = coder.unused_data if kind == "gzip" and coder.unused_data.startswith(GZIP) else b""
    return b"".join(out)


def dechunked(data: bytes) -> bytes:
    """The body of a chunked message; data that are not in chunks come back as they are, a cut-off chunk ends it."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = re.match(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;|$)", data[at:end]) if end >= 0 else None
        if size is None:
            return b"".join(out) if out else data
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record in serialised form, compressed or not; stops at a record that is cut off or whose
    length is no number."""
    if data.startswith(GZIP):
        data = inflated(data)
    at = 0
    while data.startswith(b"WARC/", at):
        end = HEAD_END.search(data, at)
        if end is None:
            return
        _, headers = fields(data[at : end.start()].decode("utf-8", "replace"))
        length = field(headers, "Content-Length", "0")
        if not re.fullmatch(r"[0-9]{1,15}", length) or end.end() + int(length) > len(data):
            return
        yield headers, data[end.end() : end.end() + int(length)]
        at = end.end() + int(length)
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


def body_of(http: dict[str, str], payload: bytes) -> tuple[bytes, str]:
    """The payload without transfer and content codings, and a coding that is not known."""
    if "chunked" in field(http, "Transfer-Encoding").lower():
        payload = dechunked(payload)
    for coding in reversed(re.split(r"\s*,\s*", field(http, "Content-Encoding").strip().lower())):
        if coding in ("gzip", "x-gzip", "deflate"):
            payload = inflated(payload, "deflate" if coding == "deflate" else "gzip") or payload
        elif coding not in ("", "identity"):
            return b"", coding
    return payload, ""


def decoded(http: dict[str, str], body: bytes) -> str:
    """The page as text, in the charset its header names; UTF-8 if that is not known or not a coding of text."""
    charset = re.search(r"""charset\s*=\s*["']?([^\s;"']+)""", field(http, "Content-Type"), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


def visible(page: str) -> tuple[str, str, list[dict[str, str]]]:
    """(title, text, links) of a page: text line by line at block tags, white space runs made one space.

    A "<" that begins no tag is text. A title without an end stops at the next tag of a block, the head or the body."""
    lines, line, title, links, in_title, anchor = [], [], [], [], False, None
    for m in TOKEN.finditer(page):
        name = m[3]
        if name is None:
            if m[1] is None and (m[0] == "<" or not m[0].startswith("<")):
                text = html.unescape(m[0])
                (title if in_title else line).append(text)
                if anchor is not None:
                    anchor.append(text)
            continue
        name = name.lower()
        if name in BLOCK or name in ("head", "body"):
            in_title = name == "title" and not m[2]
        if name in BLOCK and name != "title":
            lines.append("".join(line))
            line = []
        if name == "a" and m[2]:
            if anchor is not None:
                links[-1]["text"] = " ".join("".join(anchor).split())
            anchor = None
        elif not m[2] and name in LINKS:
            found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[4])}
            if LINKS[name] in found:
                links.append({"path": f"{name.upper()}@/{LINKS[name]}", "url": found[LINKS[name]]})
                if name == "a":
                    anchor = []
    lines.append("".join(line))
    text = "\n".join(t for t in (" ".join(x.split()) for x in lines) if t)
    return " ".join("".join(title).split()), text, links


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html): (page_id, record). Null url or html count as empty."""

    def run(batches):
        for batch in batches:
            out = []
            for key, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                payload = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                target = re.sub(r"[\r\n]", "", url or "")
                headers = {
                    "WARC-Type": "response", "WARC-Record-ID": record_id(str(key), target), "WARC-Date": date, "WARC-Target-URI": target,
                    "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(head + payload),
                }
                out.append(serialised(headers, head + payload))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(out, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def read_warc(spark, path: str) -> DataFrame:
    """(path, record) of WARC files, compressed (a member per record or as a whole) or not, one row per record; a file is one task's work."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                for headers, block in records(data.as_py()):
                    kept = {k: v for k, v in headers.items() if k.lower() != "content-length"}
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([serialised(kept, block)], pa.binary())], ["path", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record binary")


def derived(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of one response."""
    cut = HEAD_END.search(block)
    head, payload = (block[: cut.start()], block[cut.end() :]) if cut and block.startswith(b"HTTP/") else (b"", block)
    first, http = fields(head.decode("latin-1"))
    body, unknown = body_of(http, payload)
    page = decoded(http, body)
    title, text, links = visible(page)
    source = field(headers, "WARC-Record-ID")
    found = {
        "source": {k: v for k, v in headers.items() if k.lower() != "content-length"}, "http": {"status": first, "headers": http}, "html": {"title": title, "links": links}, "payload_length": len(payload),
    }
    if unknown:
        found["unknown_coding"] = unknown
    digest_of_source = field(headers, "WARC-Payload-Digest")
    out = []
    for kind, content, body in (
        ("metadata", "application/json", json.dumps(found, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        own = {"WARC-Type": kind, "WARC-Record-ID": record_id(source, kind), "WARC-Refers-To": source, "WARC-Date": field(headers, "WARC-Date"), "WARC-Target-URI": field(headers, "WARC-Target-URI")}
        if digest_of_source:
            own["WARC-Refers-To-Payload-Digest"] = digest_of_source
        own |= {"Content-Type": content, "WARC-Block-Digest": digest(body)}
        out.append((own, body))
    return out


KINDS = "kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, n_links long, text string, record binary"


def derivatives(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for every response in ``rows`` (key, record): its metadata and its conversion.

    Columns: the key, kind, record_id, refers_to, target_uri, source_digest, block_digest, n_links, text (the body) and the
    serialised record. Records of other types, null and cut-off records and those whose length is no number give nothing, an empty
    table an empty result. A page in a coding that is not known has no text and names the coding. Repeated rows give repeated records."""

    def run(batches):
        for batch in batches:
            out = []
            for name, data in zip(batch.column(key).to_pylist(), batch.column("record").to_pylist()):
                for headers, block in records(data or b""):
                    if field(headers, "WARC-Type").lower() != "response":
                        continue
                    made = derived(headers, block)
                    n_links = len(json.loads(made[0][1])["html"]["links"])
                    for own, body in made:
                        out.append((name, own["WARC-Type"], own["WARC-Record-ID"], own["WARC-Refers-To"], own["WARC-Target-URI"], own.get("WARC-Refers-To-Payload-Digest"), own["WARC-Block-Digest"], n_links, body.decode(), serialised(own, body)))
            names = [key, *(k.split()[0] for k in KINDS.split(", "))]
            types = [batch.schema.field(key).type, *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    rows = rows.select(key, "record")
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {KINDS}")
