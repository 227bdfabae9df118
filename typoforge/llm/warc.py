"""WARC derivatives: from each response a linked metadata record and a plain-text conversion record.

A response is rendered as an HTTP message in a ``response`` record. The ``metadata`` record holds application/warc-fields
(source headers, link counts, outlinks, title); the ``conversion`` record holds the plain text. Both name the response in
WARC-Refers-To and carry its target, date and source headers; every record has a block digest, the response a payload
digest, which the derivatives repeat as the digest of their source.

A page is read in time proportional to its length whatever it holds: a forward scan cuts out comments and elements whose
content is not shown, then tags go; patterns run up to the last ">" only, so none of them is tried in vain to the end. As
browsers do, a comment, script or style that is not closed hides the rest of the page; other hidden elements that are not
closed are read like any tag.

Ids are version-5 style UUIDs of page id, url and payload digest, so reruns and retries give the same bytes, and pages
that differ in any of them differ in their ids; the date is a parameter.

Cases: a null url gives no WARC-Target-URI, null html an empty payload; nulls and empty values are told apart in ids; repeated
rows give the same ids, as they are the same capture; an empty table gives no records; other columns are ignored. A page is
handled alone, and records go on in batches of ``BATCH`` bytes.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
BATCH = 8 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: The content of these is not even markup.
_RAW = ("script", "style")
_START = re.compile(r"(?i)<!--|<(script|style|template|noscript|head)\b[^>]*+>")
_BLOCK = re.compile(r"(?i)<(?:/?(?:p|div|section|article|header|footer|nav|ul|ol|li|table|tr|h[1-6]|blockquote|pre|main|aside|form|figure|dl|dt|dd)|br|hr)\b[^>]*+>")
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*+>")
_TITLE = re.compile(r"(?i)<title\b[^>]*+>")
_TITLE_END = re.compile(r"(?i)</title")
_ANCHOR = re.compile(r"(?i)<a\b[^>]*+>")
_HREF = re.compile(r"""(?i)\shref\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""")
_ASCII = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_SPACES = re.compile(r"[^\S\n]+")


class _Finder:
    """Finds strings in a text from growing places on; a string that is not found once is not sought again."""

    def __init__(self, text: str):
        self.text, self.at = text, {}

    def __call__(self, what: str, start: int) -> int:
        got = self.at.get(what, -2)
        if got != -1 and got < start:
            got = self.at[what] = self.text.find(what, start)
        return got


def _visible(page: str) -> tuple[str, str]:
    """Markup without comments, scripts and styles; the same without all elements that are not shown."""
    low = page.lower()
    if len(low) != len(page):
        low = page.translate(_ASCII)
    find, after = _Finder(low), _Finder(low)
    n, last = len(page), page.rfind(">") + 1
    markup, shown, at, hidden_to = [], [], 0, 0

    def emit(a: int, b: int) -> None:
        markup.append(page[a:b])
        if b > hidden_to:
            shown.append(page[max(a, hidden_to) : b])

    while m := _START.search(page, at, last):
        start, end = m.span()
        emit(at, start)
        name = m[1].lower() if m[1] else None
        close = find("</" + name if name else "-->", end)
        if name and close >= 0:
            close = after(">", close)
        if start >= hidden_to:
            shown.append(" ")
        if name and name not in _RAW:
            markup.append(m[0])
            at, hidden_to = end, max(hidden_to, close + 1)
        else:
            at = n if close < 0 else close + (1 if name else 3)
    if at < n:
        tail = page.find("<!--", max(at, last))
        emit(at, n if tail < 0 else tail)
    return "".join(markup), "".join(shown)


def scan(page: str) -> tuple[str, str | None, list[str]]:
    """A page -> plain text, title, link targets."""
    markup, shown = _visible(page)
    last = markup.rfind(">") + 1
    links = [html.unescape(h[h.lastindex]) for a in _ANCHOR.finditer(markup, 0, last) if (h := _HREF.search(a[0]))]
    title = _TITLE.search(markup, 0, last)
    end = _TITLE_END.search(markup, title.end()) if title else None
    title = " ".join(html.unescape(markup[title.end() : end.start()]).split()) if end else None
    last = shown.rfind(">") + 1
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", shown[:last])) + shown[last:])
    lines = (x.strip() for x in _SPACES.sub(" ", text).split("\n"))
    return "\n".join(x for x in lines if x), title, links


def plain_text(page: str) -> str:
    return scan(page)[0]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(kind: str, rid: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> list[tuple[dict, bytes]]:
    """Records of a WARC file's bytes -> [(headers, block)]."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        n = int(head["Content-Length"])
        out.append((head, raw[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def derive(page_id, url, page, date: str = DATE) -> list[tuple]:
    """A page's three records: (type, id, refers to, payload digest, block digest, block, raw)."""
    body = (page or "").encode("utf-8", "surrogatepass")
    payload = digest(body)
    name = lambda kind: f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([kind, page_id, url, payload]))}>"
    source = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    http = b"HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in source).encode() + b"\r\n" + body
    target = [("WARC-Target-URI", _uri(url))] if url is not None else []
    rid = name("response")
    shared = [*target, ("WARC-Date", date)]
    shown, title, links = scan(page or "")
    fields = [("source-status", "200"), *((f"source-{k.lower()}", v) for k, v in source), ("source-payload-digest", payload)]
    fields += [("title", title)] if title is not None else []
    fields += [("outlink", " ".join(x.split())) for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    text = shown.encode("utf-8", "surrogatepass")
    back = [*shared, ("WARC-Refers-To", rid), *([("WARC-Refers-To-Target-URI", _uri(url))] if url is not None else []), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload), ("WARC-Source-Content-Type", source[0][1])]
    out = []
    for kind, headers, ctype, block, ref in (
        ("response", [*shared, ("WARC-Payload-Digest", payload)], "application/http; msgtype=response", http, None),
        ("metadata", back, "application/warc-fields", meta, rid),
        ("conversion", [*back, ("WARC-Payload-Digest", digest(text))], "text/plain; charset=utf-8", text, rid),
    ):
        own = name(kind)
        out.append((kind, own, ref, payload if kind != "conversion" else digest(text), digest(block), block, record(kind, own, headers, ctype, block)))
    return out


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) -> one row for each record, with its whole bytes in ``raw``."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("block", pa.binary()), ("raw", pa.binary())])
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            rows, held = [], 0
            for i, u, h in zip(*b.columns, strict=True):
                i, u = i.as_py(), u.as_py()
                for kind, rid, ref, pd, bd, block, raw in derive(i, u, h.as_py(), date):
                    rows.append((i, kind, rid, ref, u, pd, bd, len(block), block, raw))
                    held += len(block) + len(raw)
                if held > BATCH:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, block binary, raw binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Write the records' bytes as WARC files, one for each partition, in their order.

    A record ends with a line feed, which Spark's text writer sets after each row; the bytes before it go out as they are.
    """
    line = F.expr("substring(raw, 1, octet_length(raw) - 1)").cast("string").alias("value")
    records.select(line).write.option("lineSep", "\n").text(path)


def op7(spark, sf_dir) -> DataFrame:
    from .common import read

    return derivatives(read(spark, sf_dir, "pages")).drop("block")
