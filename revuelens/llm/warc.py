"""Derivative WARC records: metadata and plain text of responses, linked to them.

Records are written by Spark's text sink: a WARC record ends with two line ends, which is
the sink's line separator, so each file is a series of records, gzipped as a whole.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revuelens.llm.common import text_slices
from revuelens.session import work_dir

# The parts of the format.
VERSION, END, SEPARATOR = "WARC/1.1", "\r\n", "\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 2000
_NAMES = ("record_id", "type", "refers_to", "target_uri", "date", "source_id", "content_type", "block_digest", "payload_digest")
RECORD = ", ".join(f"{n} string" for n in _NAMES) + ", headers string, block string"
_HEADER_OF = {
    "type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "source_id": "X-Source-Id",
    "content_type": "Content-Type",
    "block_digest": "WARC-Block-Digest",
    "payload_digest": "WARC-Payload-Digest",
}
_FIELD_OF = {v.lower(): k for k, v in _HEADER_OF.items()}

_DROPPED = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<head\b.*?</head\s*>|<!doctype[^>]*>")
_BLOCKS = re.compile(
    r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|header|footer|main|aside|blockquote|pre|hr|form|body|html)\b[^>]*>"
)
_TAGS = re.compile(r"</?[A-Za-z][^>]*>")
_BLANKS = re.compile(r"[ \t\f\v\r\xa0]{2,}|[\t\f\v\r\xa0]")
_LINES = re.compile(r"\n[ \n]+")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9_-]+)")
_HREF = re.compile(r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_name(*parts: object) -> str:
    """The same identifier for the same parts, so that a repeated run names records alike."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join('' if p is None else str(p) for p in parts))}>"


def plain_text(markup: str) -> str:
    """Text of a page: no scripts, styles, comments and head; a line for each block, blanks collapsed."""
    text = _TAGS.sub("", _BLOCKS.sub("\n", _DROPPED.sub(" ", markup)))
    text = html.unescape(text) if "&" in text else text
    return _LINES.sub("\n", _BLANKS.sub(" ", text).replace(" \n", "\n")).strip()


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _header_lines(record: dict, extra: str = "") -> str:
    length = len(record["block"].encode())
    lines = [f"{_HEADER_OF[k]}: {record[k]}" for k in _HEADER_OF if record.get(k) is not None]
    return END.join([*lines, *([extra] if extra else []), f"Content-Length: {length}"])


def response_of(page_id, url: str | None, markup: str | None, date: str) -> dict:
    payload = markup or ""
    raw = payload.encode()
    block = SEPARATOR.join(
        [END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}"]), payload]
    )
    inside = digest(raw)
    record = dict.fromkeys(_NAMES) | {
        "record_id": record_name("response", page_id, url, inside),
        "type": "response",
        "target_uri": None if url is None else _one_line(url),
        "date": date,
        "source_id": None if page_id is None else str(page_id),
        "content_type": "application/http;msgtype=response",
        "block_digest": digest(block.encode()),
        "payload_digest": inside,
        "block": block,
    }
    return record | {"headers": _header_lines(record)}


def derived_from(response: dict) -> list[dict]:
    """The conversion and the metadata record of one response."""
    head, found, payload = response["block"].partition(SEPARATOR)
    if not found:
        head, payload = "", response["block"]
    text = plain_text(payload)
    shared = dict.fromkeys(_NAMES) | {
        "refers_to": response["record_id"],
        "target_uri": response["target_uri"],
        "date": response["date"],
        "source_id": response["source_id"],
    }
    conversion = shared | {
        "record_id": record_name("conversion", response["record_id"]),
        "type": "conversion",
        "content_type": "text/plain; charset=utf-8",
        "block_digest": digest(text.encode()),
        "block": text,
    }
    title, lang = _TITLE.search(payload), _LANG.search(payload)
    links = dict.fromkeys(_one_line(html.unescape(a or b or c)) for a, b, c in _HREF.findall(payload))
    fields = [
        ("source-block-digest", response["block_digest"]),
        ("source-payload-digest", response["payload_digest"]),
        ("source-digest-valid", str(response["block_digest"] == digest(response["block"].encode())).lower()),
        ("title", _one_line(html.unescape(title[1])) if title else None),
        ("language", lang[1] if lang else None),
        *[("source-header", line) for line in head.split(END) if line],
        *[("outlink", link) for link in links if link],
    ]
    block = "".join(f"{k}: {v}{END}" for k, v in fields if v is not None)
    metadata = shared | {
        "record_id": record_name("metadata", response["record_id"]),
        "type": "metadata",
        "content_type": "application/warc-fields",
        "block_digest": digest(block.encode()),
        "block": block,
    }
    link = f"WARC-Concurrent-To: {conversion['record_id']}"
    return [
        conversion | {"headers": _header_lines(conversion)},
        metadata | {"headers": _header_lines(metadata, link)},
    ]


def _batch(records: list[dict]) -> pa.RecordBatch:
    names = [*_NAMES, "headers", "block"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], pa.string()) for n in names], names)


def responses(pages: DataFrame, date: str = CAPTURED, id_column: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Response records of a table of pages. A null page has an empty payload, a null address no target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, 2):
                rows = zip(*(c.to_pylist() for c in batch.slice(start, stop - start).columns), strict=True)
                yield _batch([response_of(*row, date) for row in rows])

    return pages.select(F.col(id_column).cast("string"), F.col(url).cast("string"), F.col(markup).cast("string")).mapInArrow(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """Conversion and metadata records of all response records; other types give none.

    Refers-to identifiers, target, date, the HTTP head and both digests are the
    source's; the metadata says whether the block digest holds, and is tied to the
    conversion by Concurrent-To. Repeated responses give repeated records of one name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = len(_NAMES) + 1
        for batch in batches:
            for start, stop in text_slices(batch, place):
                rows = batch.slice(start, stop - start).to_pylist()
                yield _batch([d for r in rows for d in derived_from(r | {"block": r["block"] or ""})])

    return records.filter("type = 'response'").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files of at most ``RECORDS_PER_FILE`` records."""
    line = F.concat(F.lit(VERSION + END), F.col("headers"), F.lit(SEPARATOR), F.coalesce("block", F.lit("")))
    writer = records.select(line.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_warc(raw: bytes) -> Iterator[tuple[dict, str, bytes]]:
    """(fields, header lines, block) of every record, by the lengths that records give."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, _, lines = raw[at:stop].decode().partition(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields: dict = dict.fromkeys(_NAMES)
        length = None
        for line in lines.split(END):
            name, _, value = line.partition(":")
            if name.lower() == "content-length":
                length = int(value)
            elif name.lower() in _FIELD_OF:
                fields[_FIELD_OF[name.lower()]] = value.strip()
        if length is None:
            raise ValueError(f"no length in the record at byte {at}")
        block = raw[stop + 4 : stop + 4 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, lines, block
        at = stop + 8 + length


def _gunzip(raw: bytes) -> bytes:
    """All gzip members of a file; other files as they are."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out) if out else raw


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped by record, as a whole or not at all; blocks decoded as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for fields, lines, block in parse_warc(_gunzip(content.as_py())):
                    held.append(fields | {"headers": lines, "block": block.decode("utf-8", "replace")})
                    size += len(block)
                    if size > 1 << 20:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def build_derivatives(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Derive from ``pages``, write the records as WARC files in the shared folder and read them back."""
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(derive(responses(pages, **options)), path)
    return read_warc(spark, path)
