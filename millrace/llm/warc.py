"""WARC records: writing, reading, and derivatives of responses.

``derive`` turns each response into a metadata record (a JSON envelope with the source's WARC headers, HTTP headers,
title, metas and links) and a conversion record (the visible text). Both keep the source's identifier in
WARC-Refers-To, its target and date, and its payload and block digest in WARC-Source-Payload-Digest and WARC-Source-Block-Digest; the
conversion has the source's WARC headers, as JSON pairs in order, in WARC-Source-Headers. Each has its own block digest and length. Responses are made of
pages, or come from WARC files by ``read``. Chunked transfer and the content encodings gzip and deflate are undone before a page is
parsed. Headers that occur more than once keep all their values.

Defined results: a null or empty page gives a response with an empty payload, whose conversion has an empty block; a null
URL gives records without WARC-Target-URI; repeated rows get distinct records only if their keys differ, as identifiers
are named by key, URL and payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext
from .common import CHUNK_BYTES, small_batches, tidied

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs, a fixed value
SCHEMA = (
    "key string, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, "
    "block_digest string, source_payload_digest string, source_block_digest string, source_headers array<struct<name:string,value:string>>, block string"
)
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join('' if x is None else str(x) for x in names))}>"


#: Names and values in order; a name may occur again.
Headers = list[tuple[str, str]]


def record(headers: Headers, block: bytes) -> bytes:
    """A record as bytes; Content-Length is set from the block."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _members(data: bytes) -> Iterator[bytes]:
    """A file's plain bytes, a compressed member at a time; anything else as it is."""
    rest = memoryview(data)
    while len(rest):
        if bytes(rest[:2]) != b"\x1f\x8b":
            yield bytes(rest)
            return
        d = zlib.decompressobj(31)
        plain = d.decompress(rest) + d.flush()
        if plain[:2] == b"\x1f\x8b":  # compressed by record, and again as a whole
            yield from _members(plain)
        else:
            yield plain
        rest = rest[len(rest) - len(d.unused_data) :] if d.eof else rest[:0]


def records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a file, compressed by record, as a whole, or not at all. What a cut-off file lacks is missing."""
    have = b""
    for part in _members(data):
        have = have + part if have else part
        at = 0
        while (start := have.find(b"WARC/", at)) >= 0 and (end := have.find(b"\r\n\r\n", start)) >= 0:
            headers: Headers = []
            for line in have[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and headers:
                    headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
                elif ":" in line:
                    name, _, value = line.partition(":")
                    headers.append((name, value.strip()))
            size = int(header(headers, "Content-Length") or 0)
            if end + 4 + size > len(have):
                break  # the rest is in the next member
            yield headers, have[end + 4 : end + 4 + size]
            at = end + 4 + size
        have = have[at:].lstrip(b"\r\n")
    if have[:5] == b"WARC/" and (end := have.find(b"\r\n\r\n")) >= 0:
        yield [(k, v.strip()) for k, _, v in (x.partition(":") for x in have[:end].decode("utf-8", "replace").split("\r\n")[1:])], have[end + 4 :]


def response(key: object, url: str | None, page: str | None, date: str = DATE) -> tuple[Headers, bytes]:
    """A response record's headers and block for a page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    found = digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, found)), ("WARC-Date", date), *([("WARC-Target-URI", url)] if url is not None else [])]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", found), ("Content-Length", str(len(block)))]
    return headers, block


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def header(headers: Headers, name: str) -> str | None:
    """A header's first value, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def by_name(headers: Headers) -> dict[str, str | list[str]]:
    """Values by name; those of a repeated name as a list."""
    out: dict[str, str | list[str]] = {}
    for k, v in headers:
        out[k] = [*([out[k]] if isinstance(out[k], str) else out[k]), v] if k in out else v
    return out


def unchunked(data: bytes) -> bytes:
    """A body without the marks of its chunks; one that isn't chunked right stays as it is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return data


def decoded(data: bytes, encoding: str) -> bytes:
    """A payload without its content encodings (gzip, deflate); others, and broken ones, stay."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        for window in (47,) if name in ("gzip", "x-gzip") else (15, -15) if name == "deflate" else ():
            try:
                data = zlib.decompressobj(window).decompress(data)
                break
            except zlib.error:
                continue
    return data


def source_fields(kind: str, payload_digest: str, block_digest: str, headers: Headers) -> Headers:
    """The headers of a derivative record that tell of its source."""
    found = [("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Block-Digest", block_digest)]
    return found + ([("WARC-Source-Headers", json.dumps(headers))] if kind == "conversion" else [])


def _about(root: htmltext.Node, base: str | None) -> dict:
    title, metas, links = None, [], []
    stack: list = [root]
    while stack:
        node = stack.pop()
        have = htmltext.attributes(node)
        if node.tag == "title" and title is None:
            title = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
        elif node.tag == "meta" and have:
            metas.append(have)
        elif (target := have.get("href") or have.get("src")) and node.tag in ("a", "area", "link", "img", "script", "iframe", "source"):
            try:
                full = urljoin(base or "", target)
            except ValueError:
                full = target
            links.append({"path": f"{node.tag.upper()}@/{'href' if 'href' in have else 'src'}", "url": full})
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return {"Head": {"Title": title, "Metas": metas}, "Links": links}


def derivatives(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response."""
    status, http, payload = split_http(block)
    if "chunked" in (header(http, "Transfer-Encoding") or "").lower():
        payload = unchunked(payload)
    plain = decoded(payload, header(http, "Content-Encoding") or "")
    charset = (header(http, "Content-Type") or "").partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    try:
        page = plain.decode(charset, "replace")
    except LookupError:
        page = plain.decode("utf-8", "replace")
    root = htmltext.parse(page)
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Length": str(len(record(headers, b"")) - 4),
            "WARC-Header-Metadata": by_name(headers),
            "Block-Digest": digest(block),
            "Payload-Metadata": {
                "Actual-Content-Type": "application/http; msgtype=response",
                "HTTP-Response-Metadata": {"Response-Message": status, "Headers": by_name(http), "Entity-Length": str(len(payload)), "Entity-Digest": digest(payload), "HTML-Metadata": _about(root, header(headers, "WARC-Target-URI"))},
            },
        }
    }
    target = header(headers, "WARC-Target-URI")
    source = header(headers, "WARC-Record-ID") or record_id("response", target, digest(block))
    common = [("WARC-Refers-To", source), ("WARC-Date", header(headers, "WARC-Date") or DATE), *([("WARC-Target-URI", target)] if target is not None else [])]
    digests = header(headers, "WARC-Payload-Digest") or digest(payload), header(headers, "WARC-Block-Digest") or digest(block)
    out = []
    for kind, content, body in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", htmltext.plain_text(root))):
        data = body.encode("utf-8", "replace")
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), *common, *source_fields(kind, *digests, headers)]
        out.append(([*own, ("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("Content-Length", str(len(data)))], data))
    return out


def derive(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """Two rows for each page, of its response's derivative records (columns: SCHEMA). Other columns are left out.

    ``df`` may also be rows of ``read``: then each record of type response gives two rows, and ``key`` is the response's identifier.
    """
    small_batches(df.sparkSession)
    given = page not in df.columns and {"type", "headers", "block"} <= set(df.columns)
    if given:
        rows = df.where(F.lower("type") == "response").select("headers", "block")
    else:
        rows = df.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(13)]
            names, texts = [], []  # of the sources' headers, in one array each
            columns[11].append(0)
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, block = ([(x["name"], x["value"]) for x in values[0] or ()], values[1] or b"") if given else response(*values, date)
                for own, data in derivatives(source, block):
                    h = dict(own)
                    row = (h["WARC-Refers-To"] if given else values[0], h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h["WARC-Date"], h["Content-Type"], len(data), h["WARC-Block-Digest"])
                    for c, v in zip(columns, (*row, h["WARC-Source-Payload-Digest"], h["WARC-Source-Block-Digest"], len(names) + len(source), data.decode()), strict=True):
                        c.append(v)
                    names.extend(k for k, _ in source)
                    texts.extend(v for _, v in source)
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "value"])
            columns[11] = pa.ListArray.from_arrays(pa.array(columns[11], pa.int32()), pairs)
            kinds = [pa.string()] * 7 + [pa.int64()] + [pa.string()] * 3 + [_PAIRS, pa.string()]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(tidied(run), SCHEMA)


def write(derived: DataFrame, path: str) -> None:
    """Write derivative rows as Parquet of compressed records (``member``); a file of joined members is a valid WARC file."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                h = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Date", r["date"])]
                h += [("WARC-Target-URI", r["target_uri"])] if r["target_uri"] is not None else []
                h += source_fields(r["record_type"], r["source_payload_digest"], r["source_block_digest"], [(x["name"], x["value"]) for x in r["source_headers"]])
                h += [("Content-Type", r["content_type"]), ("WARC-Block-Digest", r["block_digest"])]
                out.append(gzip.compress(record(h, r["block"].encode()), mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    derived.mapInArrow(tidied(pack), "member binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (type, headers, block) of WARC files. A task reads a whole file, but holds some megabytes of its records at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), _PAIRS, pa.binary())
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for headers, block in records(data):
                    rows.append((header(headers, "WARC-Type"), [{"name": k, "value": v} for k, v in headers], block))
                    size += len(block)
                    if size > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["type", "headers", "block"])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["type", "headers", "block"])

    schema = "type string, headers array<struct<name:string,value:string>>, block binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidied(run), schema)
