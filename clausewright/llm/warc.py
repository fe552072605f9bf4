"""WARC derivatives: for each response a metadata record of its headers and links, and a conversion record of its plain text.

Both carry the response's identifier in WARC-Refers-To, its target, date and digests. Records are written as WARC files by
Spark's text writer: headers and block make the row, and the two line ends that close every record are its row separator.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.0"
#: Files of a derivative folder hold so many records, and so many bytes (or one record) at most, so that each can be read as a whole.
FILE_RECORDS, FILE_BYTES = 20_000, 256 << 20
_NAMESPACE = uuid.UUID("5e0f0b52-6d5c-5ac2-9a0e-6b7a1d1c7f10")
RESPONSES = "page_id long, record_id string, target_uri string, date string, warc_headers map<string,string>, block binary"
DERIVATIVES = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_block_digest string, source_payload_digest string, block_digest string, content_length long, status int, block string"

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*+))")
#: A whole tag, without going back over what it passed; else what opens one.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|" + _OPEN.pattern)
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "template", "noscript", "textarea", "title", "svg")}
_LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "video": "src", "audio": "src", "embed": "src", "form": "action"}
_BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(31).join(map(str, parts)))}>"


def _tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag, comment and declaration (these without a name), in one pass forward.

    A `>` within quotes does not end a tag. Where a page leaves quotes open, so that a tag would never end, this and all later
    tags of the page end at the next `>`. What never ends is text. The caller may send() a place to go on from.
    """
    at, last, quoted = 0, source.rfind(">"), True
    while (m := (_TAG if quoted else _OPEN).search(source, at)) is not None:
        start, at = m.start(), m.end()
        if quoted and m[2]:
            moved = yield start, at, m[2].lower(), bool(m[1]), m[3]
            at = moved or at
            continue
        if m[0] in ("<!--", "<![CDATA["):
            close = "-->" if m[0] == "<!--" else "]]>"
            end = source.find(close, at)
            at = len(source) if end < 0 else end + len(close)
            moved = yield start, at, "", False, ""
            at = moved or at
            continue
        if at > last:
            return
        end = at
        slash, name = m.groups()[-2:]
        if quoted and name:
            while (stop := _STOP.search(source, end)) is not None and stop[0] != ">":
                close = source.find(stop[0], stop.end())
                end = stop.end() if close < 0 else close + 1
            quoted = stop is not None
            end = stop.start() if stop else source.find(">", at)
        else:
            end = source.find(">", at)
        moved = yield start, end + 1, (name or "").lower(), bool(slash), source[at:end] if name else ""
        at = moved or end + 1


def parse_html(source: str, base: str) -> tuple[str, dict]:
    """The plain text (lines of block elements, white space squeezed) and the metadata (Title, Metas, Links) of a page. Broken pages take time in proportion too."""
    out: list[str] = []
    title, metas, links = None, [], []
    at, tags, found = 0, _tags(source), None
    try:
        found = next(tags)
        while True:
            start, end, tag, closing, attributes = found
            out.append(html.unescape(source[at:start]))
            at, moved = end, None
            if tag in _BREAKS:
                out.append("\n")
            if tag and not closing:
                if attributes and (tag in _LINKS or tag == "meta" or tag == "base"):
                    own: dict[str, str] = {}
                    for name, *values in _ATTRIBUTE.findall(attributes):
                        own.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
                    if tag == "meta":
                        metas.append(own)
                    elif tag == "base":
                        base = _join(base, own.get("href", ""))
                    elif own.get(_LINKS[tag]):
                        link = {"path": f"{tag.upper()}@/{_LINKS[tag]}", "url": _join(base, own[_LINKS[tag]])}
                        links.append(link | ({"rel": own["rel"]} if own.get("rel") else {}))
                if tag in _RAW and not attributes.endswith("/"):
                    close = _RAW[tag].search(source, at)
                    inner = source[at : close.start() if close else len(source)]
                    at = moved = close.end() if close else len(source)
                    if tag == "title" and title is None:
                        title = " ".join(html.unescape(inner).split())
                    elif tag in ("textarea", "title"):
                        out.append(html.unescape(inner))
            found = tags.send(moved)
    except StopIteration:
        out.append(html.unescape(source[at:]))
    text = _LINES.sub("\n", _BLANK.sub(" ", "".join(out))).strip()
    return text, {"Title": title, "Metas": metas, "Links": links}


def _join(base: str, link: str) -> str:
    try:
        return urljoin(base, link.strip())
    except ValueError:
        return link


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload of an HTTP response; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    cut = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
    first, *lines = head.decode("utf-8", "replace").splitlines() or [""]
    words = first.split(None, 2)
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() and len(words[1]) == 3 else None
    headers = [(n.strip(), v.strip()) for n, colon, v in (x.partition(":") for x in lines) if colon]
    return status, headers, payload


def charset(headers: list[tuple[str, str]]) -> str:
    import codecs

    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    m = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.IGNORECASE)
    try:
        return codecs.lookup(m[1]).name if m else "utf-8"
    except LookupError:
        return "utf-8"


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Frames stored pages as responses: an HTTP 200 of text/html whose payload is the page (empty for a null one). Equal rows get equal identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, url, source in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                payload = (source or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                headers = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload)}
                for column, value in zip(out, (record_id("response", i, url, digest(payload)), url, date, list(headers.items()), block), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["page_id", "record_id", "target_uri", "date", "warc_headers", "block"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, RESPONSES)


def _derive(row: dict) -> list[dict]:
    block = row["block"] or b""
    warc = dict(row["warc_headers"] or [])
    status, headers, payload = split_http(block)
    uri, refers = row["target_uri"] or "", row["record_id"]
    body, found = parse_html(payload.decode(charset(headers), "replace"), uri)
    own = {"block": digest(block), "payload": digest(payload)}
    given = {"block": warc.get("WARC-Block-Digest"), "payload": warc.get("WARC-Payload-Digest")}
    envelope = {
        "WARC-Header-Metadata": {"WARC-Record-ID": refers, "WARC-Target-URI": uri, "WARC-Date": row["date"], **warc},
        "Payload-Metadata": {
            "HTTP-Response-Metadata": {
                "Status": status,
                "Headers": headers,
                "HTML-Metadata": found,
                "Entity-Length": len(payload),
                "Entity-Digest": own["payload"],
            },
            "Actual-Content-Length": len(block),
            "Block-Digest": own["block"],
            "Digests-Match": all(g is None or g == own[k] for k, g in given.items()),
        },
    }
    blocks = (("metadata", "application/json", json.dumps({"Envelope": envelope}, ensure_ascii=True, separators=(",", ":"))), ("conversion", "text/plain", body))
    out = []
    for kind, content, derived in blocks:
        raw = derived.encode()
        out.append({"page_id": row["page_id"], "warc_type": kind, "record_id": record_id(kind, refers), "refers_to": refers, "target_uri": row["target_uri"], "date": row["date"], "content_type": content, "source_block_digest": given["block"] or own["block"], "source_payload_digest": given["payload"] or own["payload"], "block_digest": digest(raw), "content_length": len(raw), "status": status, "block": derived})
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata record (JSON) and its conversion record (plain text).

    `responses`: record_id, target_uri, date, warc_headers, block, and page_id, an id of the user's. Digests that the response
    carries are preserved, else computed; the metadata says whether they match. Null and empty blocks give an empty text. Null
    targets are left out of the written records. Rows that repeat give records that repeat. Other columns take no part.
    """
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in DERIVATIVES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([d for r in batch.slice(row, 64).to_pylist() for d in _derive(r)], schema=schema)

    columns = ("page_id", "record_id", "target_uri", "date", "warc_headers", "block")
    return responses.select(*columns).mapInArrow(run, DERIVATIVES)


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Writes derived records as WARC files; a reader needs nothing but the WARC standard.

    A first pass over `records` takes the longest record, from which the records of a file follow; stage() them where they are
    costly to make.
    """
    line = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(column).cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    row = F.concat(F.lit(VERSION + "\r\n"), *(line(n, c) for n, c in named), F.lit("\r\n"), F.col("block"))
    rows = records.select(row.alias("value"))
    longest = rows.agg(F.max(F.octet_length("value"))).first()[0] or 1
    rows.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", max(1, min(FILE_RECORDS, FILE_BYTES // longest))).text(folder)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        cut = data.index(b"\r\n\r\n", start)
        headers = {n.strip(): v.strip() for n, _, v in (x.partition(":") for x in data[start:cut].decode().split("\r\n")[1:])}
        at = cut + 4 + int(headers["Content-Length"])
        yield headers, data[cut + 4 : at]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the WARC files in a folder, plain or compressed: headers, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    plain = []
                    while data:  # a file may hold one member for each record
                        one = zlib.decompressobj(31)
                        plain.append(one.decompress(data) + one.flush())
                        data = one.unused_data
                    data = b"".join(plain)
                pairs = list(parse_warc(data))
                yield pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in pairs], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in pairs], pa.binary())], ["headers", "block"])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, "headers map<string,string>, block binary")
