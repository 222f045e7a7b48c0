"""WARC derivatives: each response record yields a metadata record and a plain-text conversion record.

Both refer to the response (WARC-Refers-To), keep its target address, date, HTTP headers and payload
digest, and have identifiers that follow from the response's own, so running again on the same
responses gives the same records. Digests are SHA-1 in base 32, of the whole block. Records can be read from and written to
WARC files: a file is a sequence of records, so the pieces that tasks write are files of their own.

A null payload counts as empty; a null address, date or header is left out. Malformed markup is
taken as far as it can be read: an unclosed comment, script or tag hides nothing after it but
itself; time grows with the length of a page, whatever it holds. Responses are taken one by one. Only the columns
named are read, so further columns never clash.
"""

import base64
import hashlib
import html
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from . import text as tx

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string"
RECORD = "source_id string, type string, record_id string, refers_to string, target_uri string, date string, content_type string, http_headers string, source_digest string, block_digest string, length long, block string"

_OPENS = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_CLOSES = {kind: re.compile(rf"</{kind}\s*>", re.I) for kind in ("script", "style", "noscript", "template", "title")} | {"": re.compile("-->"), ">": re.compile(">")}
_TITLE = re.compile(r"<title\b", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|ul|ol|li|table|tr|td|th|article|section|nav|header|footer|main|aside|pre|blockquote|form|title|head|body|html|dl|dt|dd|figure|option)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>|<![^<>]*>")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^<>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s<>\"']+))", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class _Ahead:
    """Where the next end of each kind stands; every kind's ends are looked for once from left to right, so time grows with the length only."""

    def __init__(self, markup: str):
        self.markup, self.found = markup, {}

    def __call__(self, kind: str, at: int) -> tuple[int, int] | None:
        start, end = self.found.get(kind, (-1, -1))
        if start < at:
            m = _CLOSES[kind].search(self.markup, at)
            start, end = self.found[kind] = m.span() if m else (len(self.markup) + 1, 0)
        return (start, end) if end else None


def visible(markup: str) -> str:
    """The page with a space for every comment, script, style, noscript and template that is closed."""
    ahead, out, kept, at = _Ahead(markup), [], 0, 0
    while m := _OPENS.search(markup, at):
        at, kind = m.end(), (m[1] or "").lower()
        body = ahead(">", at)[1] if kind and ahead(">", at) else at
        close = ahead(kind, body) if not kind or body > at else None
        if close:
            out += [markup[kept : m.start()], " "]
            kept = at = close[1]
    return "".join(out) + markup[kept:]


def title_of(seen: str) -> str | None:
    """What stands in the first title that is closed."""
    if not (m := _TITLE.search(seen)) or not (opened := _CLOSES[">"].search(seen, m.end())):
        return None
    close = _CLOSES["title"].search(seen, opened.end())
    return seen[opened.end() : close.start()] if close else None


def plain_text(markup: str) -> str:
    """What a reader sees of a page: scripts, styles, comments and tags go, blocks become lines, entities become characters."""
    text = visible(markup)
    text = _TAG.sub("", _BREAK.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _BLANK.sub(" ", text)).strip()


def page_facts(markup: str, size: int) -> dict:
    """Title, language, links and size of a page, with what scripts and comments hold left out."""
    seen = visible(markup)
    title, lang = title_of(seen), _LANG.search(seen)
    links = [{"tag": m[1].lower(), "url": html.unescape(m[2] or m[3] or m[4] or "")} for m in _LINK.finditer(seen)]
    return {"title": None if title is None else plain_text(title), "lang": lang[1] if lang else None, "links": links, "payload_bytes": size}


def derived_id(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source_id}')}>"


def responses(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", date="1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages; the headers say what a page is served as.

    Identifiers follow from id and address. Where several rows share these, as repeated pages do, the
    place of the row in the table tells them apart, as identifiers must be unique: those change with how the table is
    partitioned. Write the responses once where their identifiers must last.
    """
    source = F.concat_ws(" ", F.lit("response"), F.col(id_col).cast("string"), F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.sha1(source).alias("_h"), F.monotonically_increasing_id().alias("_place"))
    repeated = pages.select(F.sha1(source).alias("_h")).groupBy("_h").count().where("count > 1").select("_h", F.lit(True).alias("_again"))
    repeated = materialise(repeated, "repeated")  # written first: mostly so small that pages need not be shuffled for the join
    h = F.when(F.col("_again"), F.sha1(F.concat_ws(" ", "_h", F.col("_place").cast("string")))).otherwise(F.col("_h"))
    part = lambda a, n: F.substring(h, a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    told = named.join(repeated, "_h", "left")
    return told.select(F.col("id").alias(id_col), record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def derive(source: DataFrame, *, keep: str | None = None) -> DataFrame:
    """Two records, metadata and conversion, of every response (columns of RESPONSE); narrow. keep: a column carried along."""
    names = [f.split()[0] for f in RESPONSE.split(", ")]
    carried = [F.col(keep).alias("kept")] if keep else []
    chosen = source.select(*carried, *names)

    def run(batches):
        for batch in tx.chunks(batches, "payload", limit=1 << 20):
            rows = []
            for rid, uri, date, headers, payload in zip(*(batch.column(c).to_pylist() for c in names)):
                payload = payload or ""
                raw = payload.encode("utf-8", "surrogatepass")
                source_digest = digest(raw)
                facts = page_facts(payload, len(raw))
                header = [line.split(":", 1) for line in (headers or "").split("\r\n")[1:] if ":" in line]
                facts |= {"status": (headers or "").split("\r\n")[0] or None, "headers": {k.strip().lower(): v.strip() for k, v in header}, "refers_to": rid, "payload_digest": source_digest}
                for kind, mime, block in (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", plain_text(payload))):
                    data = block.encode("utf-8", "surrogatepass")
                    rows.append([rid, kind, derived_id(rid or "", kind), rid, uri, date, mime, headers, source_digest, digest(data), len(data), block])
            kept = [batch.column("kept").take(pa.array([i // 2 for i in range(len(rows))]))] if keep else []
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(zip(*rows), types)], labels)

    fields = [f.split() for f in RECORD.split(", ")]
    types = [pa.int64() if t == "long" else pa.string() for _, t in fields]
    labels = [n for n, _ in fields]
    schema = RECORD
    if keep:
        labels.insert(0, "kept")
        schema = f"kept {chosen.schema['kept'].dataType.simpleString()}, {RECORD}"
    out = chosen.mapInArrow(run, schema)
    return out.withColumnRenamed("kept", keep) if keep else out


def serialised(records: DataFrame) -> DataFrame:
    """(record): each record of derive() as the text of a WARC record, without the two line ends that close it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(F.col(c), "[\\r\\n]+", " "), F.lit("\r\n"))).otherwise("")
    fields = (("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"))
    # the response's headers travel in one field of their own, their line ends written as a bar
    kept = F.when(F.col("http_headers").isNotNull(), F.concat(F.lit("WARC-Source-Headers: "), F.regexp_replace("http_headers", "\r?\n", " | "), F.lit("\r\n"))).otherwise("")
    return records.select(F.concat(F.lit("WARC/1.0\r\n"), *(line(*f) for f in fields), kept, F.lit("Content-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"), F.col("block")).alias("record"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write records as WARC files, one for each task."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_records(data: bytes):
    """(headers, block) of every record in the bytes of a WARC file; stops at the first that is cut off."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        pairs = [line.split(b":", 1) for line in data[at:end].split(b"\r\n")[1:] if b":" in line]
        headers = {k.strip().decode("utf-8", "replace").lower(): v.strip().decode("utf-8", "replace") for k, v in pairs}
        size = int(headers.get("content-length", "0") or 0)
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        yield headers, block
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, refers_to, target_uri, date, content_type, block_digest, http_headers, payload) of every record of
    WARC files, plain or gzipped. A response's HTTP headers are set apart from its payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ["type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "http_headers", "payload"]

    def run(batches):
        import zlib

        for batch in batches:
            for content in batch.column("content").to_pylist():
                data, rest = b"", content
                while rest[:2] == b"\x1f\x8b":
                    member = zlib.decompressobj(31)
                    data += member.decompress(rest)
                    rest = member.unused_data
                rows = []
                for h, block in parse_records(data or content):
                    http = h.get("warc-source-headers", "").replace(" | ", "\r\n") or None
                    if h.get("warc-type") == "response" and b"\r\n\r\n" in block:
                        head, block = block.split(b"\r\n\r\n", 1)
                        http = head.decode("utf-8", "replace")
                    rows.append([h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), h.get("warc-block-digest"), http, block.decode("utf-8", "replace")])
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names))
