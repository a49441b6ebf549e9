"""WARC derivatives: every response record gives a metadata and a plain-text conversion record.

Record identifiers are name-based UUIDs of (kind, target, page, payload
digest), so a task that runs again writes the same records. Derived records
name the response they come from in WARC-Refers-To, and repeat its target, date
and payload digest; the metadata record also keeps the source's HTTP headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files

_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:warc")
RECORD = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, block string"
_FIELDS = [f.split()[0] for f in RECORD.split(", ")]
# A tag's body ends at the next tag, but for what is quoted: a tag that is never closed costs no more than the way there.
_BODY = r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b" + _BODY + r">.*?(?:</\1\s*+>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|body|html|head)\b" + _BODY + ">", re.I)
_OTHER = re.compile(r"<[a-z/!?]" + _BODY + ">", re.I)
_TITLE = re.compile(r"<title\b" + _BODY + r">(.*?)(?:</title\s*+>|\Z)", re.I | re.S)
_TOLD = re.compile(r"<(html|meta)\b" + _BODY + ">", re.I)
_ANCHOR = re.compile(r"<a\b" + _BODY + ">", re.I)
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"\bcharset\s*+=\s*+[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    """A labelled digest as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def shown(html: str) -> str:
    """A page without scripts, styles, comments and its title."""
    return _DROPPED.sub(" ", html)


def plain_text(html: str) -> str:
    """Visible text of what shown() leaves: one line per block, white space collapsed, no empty lines."""
    text = unescape(_OTHER.sub("", _BLOCK.sub("\n", html)))
    return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)


def told(html: str) -> list[tuple[str, str]]:
    """(name, value) of the title, language and character set that a page tells, each where it is told first."""
    found = {}
    title = _TITLE.search(html)
    if title:
        found["title"] = title[2]
    for tag in _TOLD.finditer(html):
        name, pattern = ("language", _LANG) if tag[1].lower() == "html" else ("charset", _CHARSET)
        value = None if name in found else pattern.search(tag[2])
        if value:
            found[name] = value[1]
    return [(k, found[k]) for k in ("title", "language", "charset") if k in found]


def outlinks(html: str) -> list[str]:
    """The targets of the anchors in what shown() leaves."""
    hrefs = (_HREF.search(tag[1]) for tag in _ANCHOR.finditer(html))
    return [next(x for x in m.groups() if x is not None) for m in hrefs if m]


def record_id(kind: str, uri: str, page: int | None, payload: str) -> str:
    """The identifier of a record."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {page} {payload} {uri}')}>"


def _record(page, kind, refers_to, uri, date, content_type, payload, block: str) -> tuple:
    data = block.encode("utf-8", "replace")
    return page, kind, record_id(kind, uri, page, payload), refers_to, uri, date, content_type, len(data), digest(data), payload, block


def one_line(value: str) -> str:
    """A header value: line ends would end the header."""
    return " ".join(value.split())


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 3]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A WARC response record (RECORD) per page: page_id, url, html.

    A null url or html counts as empty; repeated rows give repeated records
    with one identifier; other columns are left out; no shuffle.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for page, url, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    body, uri = text.encode("utf-8", "replace"), one_line(url)
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
                    rows.append(_record(page, "response", None, uri, date, "application/http; msgtype=response", digest(body), head + text))
                yield _batches(rows)

    return pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")), html).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record (RECORD) of every response record; other kinds are passed over.

    A block without HTTP headers is all payload. A block that is null counts as
    empty, as does a null target. Repeated records give repeated ones; other
    columns are left out; an empty table gives no rows; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    uri, date, payload = r["target_uri"] or "", r["date"], r["payload_digest"]
                    head, cut, html = (r["block"] or "").partition("\r\n\r\n")
                    if not cut or not head.startswith("HTTP/"):
                        head, html = "", r["block"] or ""
                    seen = shown(html)
                    fields = [(k, one_line(unescape(v))) for k, v in told(html)] + [("outlink", one_line(unescape(x))) for x in outlinks(seen)]
                    fields += [("source-header", h) for h in head.split("\r\n") if h] + [("source-payload-digest", payload or ""), ("source-block-digest", r["block_digest"] or "")]
                    rows.append(_record(r["page_id"], "metadata", r["record_id"], uri, date, "application/warc-fields", payload, "".join(f"{k}: {v}\r\n" for k, v in fields)))
                    rows.append(_record(r["page_id"], "conversion", r["record_id"], uri, date, "text/plain; charset=utf-8", payload, plain_text(seen)))
                yield _batches(rows)

    return records.filter("kind = 'response'").select(*_FIELDS).mapInArrow(run, RECORD)


def serialized(records: DataFrame) -> DataFrame:
    """`record`: each record as WARC/1.1 text, its two trailing line ends included; a page's number is an extension field."""
    def line(name: str, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))).otherwise("")

    refers = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.when(refers, F.col("target_uri"))),
        line("WARC-Refers-To-Date", F.when(refers, F.col("date"))),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("Page-Number", F.col("page_id").cast("string")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n"),
    )
    return records.select(F.concat(head, F.coalesce("block", F.lit("")), F.lit("\r\n\r\n")).alias("record"))


#: The empty gzip member, after a record so long that its own member doesn't end with a zero.
_EMPTY = gzip.compress(b"", 9, mtime=0)


def member(record: bytes, level: int = 1) -> bytes:
    """A record as a gzip member without the zero byte that ends it."""
    out = gzip.compress(record, level, mtime=0)
    return (out if out.endswith(b"\0") else out + _EMPTY)[:-1]


def write_warc(records: DataFrame, path: str, level: int = 1) -> None:
    """Write records as standard WARC files, `part-*.warc.gz`, one per partition: each record is a gzip member of its own, so a reader may begin at any.

    Spark's text writer puts the bytes down in whatever store it reaches. It
    ends a row with a separator; here that is the zero byte which ends every
    member (the top byte of the record's length). Then the files get their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_arrays([pa.array([member(x, level) for x in batch.column(0).slice(at, 256).to_pylist()], pa.binary())], ["member"])

    packed = serialized(records).select(F.col("record").cast("binary")).mapInArrow(run, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)
    spark = records.sparkSession
    for name in files.names(spark, path):
        if name.endswith(".txt"):
            files.rename(spark, f"{path}/{name}", name.removesuffix(".txt") + ".warc.gz")


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """What the gzip members of a file hold, as far as they can be read, in pieces; data that isn't gzip as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        try:
            while not stream.eof and at < len(data):
                given = data[at : at + size]
                yield stream.decompress(given)
                at += len(given) - len(stream.unused_data)
        except zlib.error:
            return


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The records of a file's bytes (in pieces), in the order of RECORD. A record whose header or length is damaged is passed over, as is one that the file's end cuts off.

    What is held is a record and a piece, but for a length that is said to reach further.
    """
    data, pieces, more = bytearray(), iter(pieces), True

    def grow() -> bool:
        nonlocal more
        piece = next(pieces, None)
        more = piece is not None
        data.extend(piece or b"")
        return more

    at = 0
    while True:
        at = data.find(b"WARC/1.", at)
        end = data.find(b"\r\n\r\n", at) if at >= 0 else -1
        if end < 0:
            if not more:
                return
            keep = at if at >= 0 else max(0, len(data) - 6)
            del data[:keep]
            at = 0
            grow()
            continue
        lines = bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, mark, v in (x.partition(":") for x in lines) if mark}
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdecimal()) or "warc-type" not in head:
            at += len(b"WARC/1.")
            continue
        upto = end + 4 + int(size)
        while upto > len(data) and grow():
            pass
        if upto > len(data):
            at += len(b"WARC/1.")
            continue
        number = head.get("page-number", "")
        named = (head.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type"))
        block = bytes(data[end + 4 : upto]).decode("utf-8", "replace")
        yield int(number) if re.fullmatch(r"-?\d{1,18}", number) else None, *named, int(size), head.get("warc-block-digest"), head.get("warc-payload-digest"), block
        del data[:upto]
        at = 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of WARC files, plain or gzip; page_id is null where the files don't tell it.

    Line ends between records are skipped, and so are damaged and cut-off
    records. A file, as it is stored, must fit a cell: archives are written in
    files of about a gigabyte. It is inflated piece by piece, and records are
    handed on in small batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                records = parsed(inflated(data.as_py()))
                while rows := list(islice(records, 256)):
                    yield _batches(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
