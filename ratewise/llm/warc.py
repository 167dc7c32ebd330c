"""WARC derivative builder.

Response records become linked metadata and conversion records.  Both refer
to their response by its record id, carry its target, date and payload digest,
and name each other; the metadata keeps the HTTP status and source headers.
Records are rows, a file is only a container: ``read_warc`` parses files (a
gzip member or plain bytes at a time, by Content-Length) and ``warc_text``
renders rows back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
RECORD_SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_type string, block binary"
DERIVED = ("warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, "
           "content_type string, content_length long, block_digest string, payload_digest string, http_status int, "
           "source_headers array<struct<name:string,value:string>>, block string")

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>",
                      re.S | re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.S | re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.S | re.I)
#: Elements that begin a new line.
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|"
                    r"header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^>]*>")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def plain_text(page: str) -> str:
    """The text of an HTML page: comments, scripts and styles dropped, block
    elements as line breaks, entities resolved, white space collapsed."""
    text = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub("", page)))
    lines = (" ".join(x.split()) for x in html.unescape(text).replace("\xa0", " ").split("\n"))
    return "\n".join(x for x in lines if x)


def parse_response(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, headers, payload) of an HTTP response block; a block without a
    status line is payload alone."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    code = first.split(" ")[1:2]
    headers = [(n.strip(), v.strip()) for n, sep, v in (x.partition(":") for x in rest) if sep]
    return (int(code[0]) if code and code[0].isdigit() else None), headers, payload


def derive_record(rid: str | None, uri: str | None, date: str | None, block: bytes | None) -> list[tuple]:
    rid, uri, date, block = rid or "", uri or "", date or DATE, block or b""
    status, headers, payload = parse_response(block)
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    charset = re.search(r"charset=\"?([\w-]+)", kind)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page) if not kind or "html" in kind else page if kind.startswith("text/") else ""
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = [html.unescape(next(g for g in m if g is not None) if any(m) else "") for m in
             (tuple(x if x else None for x in t) for t in _LINK.findall(_DROPPED.sub("", page)))]
    fields = [("http-status", "" if status is None else str(status)), ("source-block-digest", digest(block)),
              ("source-payload-length", str(len(payload))), *((f"source-header-{n.lower()}", v) for n, v in headers),
              ("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("language", lang[1] if lang else ""),
              *(("outlink", x) for x in links)]
    meta = "".join(f"{n}: {v}\r\n" for n, v in ((n, v.replace("\r", " ").replace("\n", " ")) for n, v in fields))
    ids = {t: record_id(rid, uri, t) for t in ("metadata", "conversion")}
    out = []
    for t, other, ctype, body in (("metadata", "conversion", "application/warc-fields", meta),
                                  ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        raw = body.encode("utf-8", "replace")
        out.append((t, ids[t], rid, ids[other], uri, date, ctype, len(raw), digest(raw), digest(payload), status,
                    [{"name": n, "value": v} for n, v in headers], raw.decode()))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages(page_id, url, html)`` as a crawler writes
    them, with ``page_id``.  Null html is an empty payload, null url an empty
    target."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                body = (page or "").encode("utf-8", "replace")
                block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)) + body
                rows.append((i, "response", record_id(str(i), url or "", "response"), url or "", date,
                             "application/http; msgtype=response", block))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64())] + [pa.array(c, pa.string()) for c in cols[1:6]] + [pa.array(cols[6], pa.binary())],
                names=["page_id", "warc_type", "record_id", "target_uri", "warc_date", "content_type", "block"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, " + RECORD_SCHEMA)


_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_DERIVED_TYPES = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.int32(), _HEADERS, pa.string()]


def derive(records: DataFrame, key: str | None = None) -> DataFrame:
    """One metadata and one conversion record for each response record; other
    records are left out (a null type counts as response).  Null block: empty
    payload.  Rows repeated give repeated rows.  ``key`` names an integer
    column to carry.  An empty table gives an empty result."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, *r in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(k, *d) for d in derive_record(*r)]
            cols = list(zip(*rows)) if rows else [()] * 14
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64())] + [pa.array(c, t) for c, t in zip(cols[1:], _DERIVED_TYPES)],
                names=["carried", *[x.split()[0] for x in DERIVED.split(", ")]])

    out = (records.where("warc_type is null or warc_type = 'response'")
           .select((F.col(key) if key else F.lit(None)).cast("long").alias("carried"), "record_id", "target_uri", "warc_date", "block")
           .mapInArrow(run, "carried long, " + DERIVED))
    return out.withColumnRenamed("carried", key) if key else out.drop("carried")


def warc_text(derived: DataFrame) -> DataFrame:
    """``value``: each derived record as WARC/1.1 text, without the two line
    ends that close it.  Write with ``.write.option("lineSep", "\\r\\n\\r\\n").text(path)``."""
    line = lambda name, col: F.concat(F.lit(f"{name}: "), F.col(col), F.lit("\r\n"))
    return derived.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"),
        line("WARC-Block-Digest", "block_digest"), line("WARC-Payload-Digest", "payload_digest"), line("Content-Type", "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n")), F.col("block")).alias("value"))


def parse_warc(stream: io.BufferedIOBase):
    """(headers, block) of the records of a WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue            # the two line ends between records
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length") or 0))


def read_warc(spark, path: str) -> DataFrame:
    """The records of the WARC files (plain or gzip) below ``path``, with all
    headers in a map.  A file is one task's work, as crawls cut them at about
    1 GB; records are handed on one at a time."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                stream = io.BytesIO(raw)
                stream = gzip.open(stream) if raw[:2] == b"\x1f\x8b" else stream
                for h, block in parse_warc(stream):
                    get = lambda n: pa.array([h.get(n)], pa.string())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-date"), get("content-type"),
                         pa.array([block], pa.binary()), pa.array([list(h.items())], pa.map_(pa.string(), pa.string()))],
                        names=["warc_type", "record_id", "target_uri", "warc_date", "content_type", "block", "headers"])

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(run, RECORD_SCHEMA + ", headers map<string,string>"))
