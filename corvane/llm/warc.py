"""WARC derivatives: responses become metadata and plain-text conversion records that refer to them.

A record is its WARC/1.1 bytes, two line ends behind it included, so that records written one after the other make a WARC
file; ``compressed`` makes each a gzip member. Derived records carry the response's identifier in WARC-Refers-To, its
target and date, and the digest of the payload that they were made from; the metadata also lists the source's WARC and
HTTP headers. Identifiers are name-based UUIDs of what a record is made from, so reruns agree.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import with_arrow

VERSION = b"WARC/1.1"
#: Date of a capture whose time is not known.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:corvane:warc")

#: Tags that begin a new line of text, elements that show nothing, and those of them whose content is no markup.
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section nav header footer blockquote pre main aside".split())
HIDDEN, RAW = frozenset(("noscript", "template", "head")), frozenset(("script", "style"))
_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)([^>]*)>|[!/][^>]*>)")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_LINE = re.compile(r"[^\S\n]+")
_CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([^\s"';,/>]+)""", re.I)
#: Where a page may name its character set, as HTML has it.
PRESCAN = 1024

Pairs = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(x or '' for x in parts))}>"


def build(kind: str, identifier: str, headers: list[tuple[str, str | None]], content_type: str, block: bytes, compressed: bool = False, sha: str | None = None) -> bytes:
    """The bytes of one record; headers without a value are left out, and line breaks in a value become spaces. ``sha``: the
    block's digest, where it is known."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", identifier), *headers, ("WARC-Block-Digest", sha or digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = [VERSION, *[f"{k}: {' '.join(v.splitlines())}".encode() for k, v in fields if v is not None]]
    data = b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compressed else data


def pairs(head: bytes, charset: str = "utf-8") -> Pairs:
    """Header lines as (name, value), in order, repeated names kept; a line that begins with a blank continues the one before."""
    out: Pairs = []
    for line in head.decode(charset, "replace").splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def first(headers: Pairs, name: str) -> str | None:
    """The first value of a header, whatever the case of its name."""
    return next((v for k, v in headers if k.lower() == name), None)


def _members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The gzip members of ``data`` decompressed, the good part of a bad one with what is wrong."""
    while data:
        if data[:2] != b"\x1f\x8b":
            if data.strip(b"\0"):
                yield b"", f"{len(data)} bytes behind the last gzip member"
            return
        d = zlib.decompressobj(31)
        out = []
        try:
            for i in range(0, len(data), 1 << 16):
                out.append(d.decompress(data[i : i + (1 << 16)]))
                if d.eof:
                    rest = d.unused_data + data[i + (1 << 16) :]
                    break
            else:
                yield b"".join(out), "gzip member cut short"
                return
        except zlib.error as e:
            yield b"".join(out), f"gzip member broken: {e}"
            return
        yield b"".join(out), None
        data = rest


def records(data: bytes) -> Iterator[tuple[Pairs, bytes, str | None]]:
    """Headers, block and None for each record in ``data``, plain or in gzip members; ([], b"", what is wrong) for bytes that
    are no record. Reading goes on at the next line that begins like a record; stray line ends between records don't matter.
    """
    if data[:2] == b"\x1f\x8b":
        whole, faults = [], []
        for part, fault in _members(data):
            whole.append(part)
            faults += [fault] if fault else []
        data = b"".join(whole)
    else:
        faults = []
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            break
        fault, end = None, data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/":
            fault = f"no record at byte {at}"
        elif end < 0:
            fault = f"headers without an end at byte {at}"
        else:
            headers = pairs(data[at:end].partition(b"\r\n")[2])
            size = first(headers, "content-length") or ""
            if not (size.isascii() and size.isdigit()):
                fault = f"no length of the record at byte {at}"
            elif end + 4 + int(size) > len(data):
                yield [], b"", f"record at byte {at} cut short"
                break
            else:
                yield headers, data[end + 4 : end + 4 + int(size)], None
                at = end + 4 + int(size)
        if fault:
            yield [], b"", fault
            at = data.find(b"\nWARC/", at) + 1
            if not at:
                break
    for fault in faults:
        yield [], b"", fault


def parse(data: bytes) -> list[tuple[Pairs, bytes]]:
    """Headers and block of each record in ``data``; ValueError if anything in it is no record."""
    out = []
    for headers, block, fault in records(data):
        if fault:
            raise ValueError(fault)
        out.append((headers, block))
    return out


def response(url: str | None, body: str | None, key: str, date: str = DATE, compressed: bool = False) -> bytes:
    payload = (body or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    headers = [("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload))]
    return build("response", record_id("response", key, url, headers[2][1]), headers, "application/http; msgtype=response", http + payload, compressed)


def _unchunked(body: bytes) -> bytes:
    """The data of a chunked body; what is no chunk ends it."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body if not out else b"".join(out)
        if size <= 0:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def _unpacked(body: bytes, coding: str) -> bytes:
    """``body`` without one content coding; ValueError for a coding that is not known here."""
    if coding in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if coding == "deflate":
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -15)
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    raise ValueError(f"content coding {coding}")


def page_of(payload: bytes, headers: Pairs) -> tuple[str, str, str | None]:
    """The text of a payload, the character set that it was read by, and what was wrong: an unknown or broken coding gives an
    empty text. The set is that of Content-Type, else one that the page's beginning names, else UTF-8."""
    try:
        if "chunked" in (first(headers, "transfer-encoding") or "").lower():
            payload = _unchunked(payload)
        for coding in reversed((first(headers, "content-encoding") or "").lower().split(",")):
            if coding.strip() not in ("", "identity"):
                payload = _unpacked(payload, coding.strip())
    except (ValueError, OSError, EOFError, zlib.error, zstandard.ZstdError) as e:
        return "", "", f"{type(e).__name__}: {e}"
    found = _CHARSET.search(first(headers, "content-type") or "") or _CHARSET.search(payload[:PRESCAN].decode("latin-1"))
    try:
        charset = codecs.lookup(found[1]).name if found else "utf-8"
        return payload.decode(charset, "replace"), charset, None
    except (LookupError, ValueError, UnicodeError):  # a set that is none, or one that is not of text
        return payload.decode("utf-8", "replace"), "utf-8", None


def read_page(page: str, base: str | None = None) -> tuple[str, str | None, list[str]]:
    """What a page shows, its first title that has an end, and the targets of its anchors in order.

    The text has no scripts, styles, comments, heads, templates and fallbacks for scripts, a line for each block, and its
    character references are resolved. A tag ends at the next ">". A comment, script or hidden element without an end is a tag
    like others; a "<" without a ">" is text. Targets are resolved against ``base`` where one is known; one that is no URL
    stays as it is. The page is read once, in time proportional to its length.
    """
    parts: list[str] = []
    found: list[str] = []
    endless: set[str] = set()
    depth = dict.fromkeys(HIDDEN, 0)
    opened: list[tuple[str, int]] = []  # hidden elements that are open, and how many parts stood before them
    named = begun = None
    at, last = 0, page.rfind(">") + 1
    while tag := _TAG.search(page, at, last):
        start, end = tag.span()
        if start > at:
            parts.append(page[at:start])
        at = end
        comment, closing, name, rest = tag.groups()
        if comment:
            close = -1 if "!--" in endless else page.find("-->", end)
            if close >= 0:
                at = close + 3
                parts.append(" ")
            else:
                endless.add("!--")
                at = page.find(">", end) + 1
            continue
        name = name.lower() if name else ""
        if name in BREAKS:
            parts.append("\n")
        elif name == "a":
            if not closing and (ref := _HREF.search(rest)):
                found.append(ref[1] or ref[2] or ref[3] or "")
        elif name == "title":
            if not closing:
                begun = len(parts) if begun is None else begun
            elif named is None and begun is not None:
                named = " ".join(html.unescape("".join(parts[begun:])).split())
        elif name in RAW and not closing:
            close = None if name in endless else _CLOSE[name].search(page, end)
            if close:
                at = close.end()
                parts.append(" ")
            else:
                endless.add(name)
        elif name in HIDDEN:
            if not closing:
                opened.append((name, len(parts)))
                depth[name] += 1
            elif depth[name]:
                while opened:
                    was, before = opened.pop()
                    depth[was] -= 1
                    if was == name:
                        del parts[before:]
                        parts.append(" ")
                        begun = None if begun is not None and begun >= before else begun
                        break
    parts.append(page[at:])
    lines = [_LINE.sub(" ", x).strip() for x in html.unescape("".join(parts)).split("\n")]
    return "\n".join(x for x in lines if x), named, [_target(html.unescape(x).strip(), base) for x in found]


def plain_text(page: str) -> str:
    return read_page(page)[0]


def title(page: str) -> str | None:
    return read_page(page)[1]


def links(page: str, base: str | None) -> list[str]:
    return read_page(page, base)[2]


def _target(ref: str, base: str | None) -> str:
    try:
        return urljoin(base, ref) if base else ref
    except ValueError:
        return ref


def derive(record: bytes, compressed: bool = False) -> tuple[list[dict], list[str]]:
    """For each response in ``record``: a metadata and a conversion record, as dicts of fields and bytes, others give none;
    and what was wrong, in order. Good records count, whatever stands around them."""
    out, faults = [], []
    for source, block, fault in records(record):
        if fault:
            faults.append(fault)
        if first(source, "warc-type") != "response":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        status, _, fields = head.partition(b"\r\n")
        headers = pairs(fields, "latin-1")
        page, charset, fault = page_of(payload, headers)
        identifier, target, stored = (first(source, f"warc-{x}") for x in ("record-id", "target-uri", "payload-digest"))
        if fault:
            faults.append(f"{identifier}: {fault}")
        text, name, found = read_page(page, target)
        about = {
            "source": source, "http": {"status": status.decode("latin-1"), "headers": headers}, "charset": charset, "error": fault,
            "title": name, "links": found, "payload_intact": stored is None or digest(payload) == stored,
        }
        shared = [("WARC-Refers-To", identifier), ("WARC-Target-URI", target), ("WARC-Date", first(source, "warc-date")), ("WARC-Source-Payload-Digest", stored)]
        for kind, content_type, made in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
            sha = digest(made)
            own = record_id(kind, identifier, sha)
            out.append({"record_type": kind, "record_id": own, "refers_to": identifier, "target_uri": target, "payload_digest": stored, "block_digest": sha, "block_bytes": len(made), "record": build(kind, own, shared, content_type, made, compressed, sha)})
    return out, faults


def derive_one(record: bytes, compressed: bool = False) -> list[dict]:
    return derive(record, compressed)[0]


def responses(pages: DataFrame, url: str = "url", body: str = "html", key: str = "page_id", compressed: bool = False) -> DataFrame:
    """``pages`` with ``record``, a response record of each page. A null URL leaves WARC-Target-URI out, a null body is
    empty; pages that are equal in key, URL and body get equal records. Rows and other columns stay, an input column named
    ``record`` gives way. No shuffle."""

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = zip(part.column(url).to_pylist(), part.column(body).to_pylist(), part.column(key).to_pylist(), strict=True)
        return {"record": pa.array([response(u, b, "" if k is None else str(k), compressed=compressed) for u, b, k in rows], pa.binary())}

    return with_arrow(pages, kernel, "record binary", body)


DERIVED = "array<struct<record_type:string,record_id:string,refers_to:string,target_uri:string,payload_digest:string,block_digest:string,block_bytes:bigint,record:binary>>"


def derivatives(records: DataFrame, record: str = "record", keep: list[str] | None = None, compressed: bool = False) -> DataFrame:
    """``keep`` (all other columns by default), ``derived``, the records made from each response in ``record`` (first the
    metadata, then the conversion), and ``error``.

    Null bytes and records of other types give an empty list. ``error`` says what in the bytes is no record, broken, cut short
    or in an unknown coding, and where (null elsewhere); the good records around it are derived. Headers are lists of names and
    values, repeated ones included. Input columns named like an added one give way. No shuffle."""
    kind = pa.list_(pa.struct([(n, pa.int64() if n == "block_bytes" else pa.binary() if n == "record" else pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "block_bytes", "record")]))

    def one(data: bytes | None) -> tuple[list[dict], str | None]:
        derived, faults = derive(data, compressed) if data else ([], [])
        return derived, "; ".join(faults) or None

    def kernel(part: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = [one(x) for x in part.column(record).to_pylist()]
        return {"derived": pa.array([d for d, _ in rows], kind), "error": pa.array([e for _, e in rows], pa.string())}

    return with_arrow(records, kernel, f"derived {DERIVED}, error string", record, [c for c in records.columns if c != record] if keep is None else keep)


def flat(derived: DataFrame) -> DataFrame:
    """One row for each derived record, with the other columns of ``derived`` but ``error``; files without records have none."""
    return derived.select(*[F.col(f"`{c}`") for c in derived.columns if c not in ("derived", "error")], F.inline("derived"))
