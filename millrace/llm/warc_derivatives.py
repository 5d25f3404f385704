"""WARC derivative builder.

Every response record becomes two records that refer to it: a ``metadata`` record with the source's
record headers, the HTTP status and headers, title, character set and links as JSON, and a
``conversion`` record with the page's visible text. Both keep the target address and date of the
source, carry its identifier in ``WARC-Refers-To`` and digests of their own block; the source's
digests are kept in the metadata and compared with its payload. The conversion names its metadata
record in ``WARC-Concurrent-To``. Identifiers are derived from the source's, so reruns agree.

Records are rows; the work is one projection without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.html_tree import Page
from millrace.llm.wrapper_induction import NO_TEXT

END = b"\r\n\r\n"
CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_.:\-]+)""", re.I)
HEXADECIMAL = re.compile(rb"[0-9A-Fa-f]+")
SITE = re.compile(r"https?://[A-Za-z0-9.\-]+(?::\d+)?(?=/|$)")
PLAIN_PATH = re.compile(r"/(?:[^/.?#;\s\\][^/?#;\s\\]*(?:/(?=[^/.?#;\s\\])|$))*")
GZIP_MAGIC = b"\x1f\x8b"
#: Compressed content beyond so many bytes is not unpacked.
CONTENT_BYTES = 1 << 28
LINK_ATTRIBUTES = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}

FIELDS = ("type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "block_digest", "source_payload_digest")
DERIVATIVE = T.StructType(
    [T.StructField(n, T.StringType()) for n in FIELDS]
    + [T.StructField("digest_ok", T.BooleanType()), T.StructField("content_length", T.LongType())]
    + [T.StructField("record", T.BinaryType()), T.StructField("problem", T.StringType())]
)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def headers_of(block: bytes) -> list[tuple[str, str]]:
    """Header lines after the first; a folded line continues the one before."""
    out: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def make_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """Header lines and block of a record, without the two line ends that follow a record."""
    lines = ["WARC/1.0", *(f"{n}: {v}" for n, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def joined_chunks(body: bytes) -> bytes:
    """The data of a chunked body, as far as its chunk sizes are hexadecimal numbers; a body that
    does not begin with one is taken as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not HEXADECIMAL.fullmatch(size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) or body


class TooLarge(ValueError):
    pass


def inflated(data: bytes, wbits: int, limit: int) -> bytes:
    """Decompressed members one after the other, never more than ``limit`` bytes."""
    out, room, first = [], limit, True
    while data and (first or data[:2] == GZIP_MAGIC):
        stream = zlib.decompressobj(wbits)
        out.append(stream.decompress(data, room + 1))
        room -= len(out[-1])
        if room < 0:
            raise TooLarge
        if not stream.eof:
            raise EOFError
        data, first = stream.unused_data, False
    return b"".join(out)


def unpacked(body: bytes, http: list[tuple[str, str]], limit: int) -> tuple[bytes, bytes]:
    """The payload as sent (chunks joined) and as decoded content, which is empty if it is broken.
    :class:`TooLarge` if the content has more than ``limit`` bytes."""
    if "chunked" in (get(http, "transfer-encoding") or "").lower():
        body = joined_chunks(body)
    coding = (get(http, "content-encoding") or "").lower()
    wbits = 31 if "gzip" in coding else 15 if "deflate" in coding else None
    if wbits is None:
        return body, body
    try:
        return body, inflated(body, wbits, limit)
    except (EOFError, zlib.error):
        return body, b""


def decoded(content: bytes, content_type: str) -> tuple[str, str]:
    found = CHARSET.search(content_type) or CHARSET.search(content[:2048].decode("ascii", "replace"))
    name = found[1] if found else "utf-8"
    try:
        return content.decode(name, "replace"), name.lower()
    except LookupError:
        return content.decode("utf-8", "replace"), "utf-8"


def joined(site: str | None, base: str, value: str) -> str:
    """A link's address; plain paths from the root of a ``site`` need no parsing."""
    value = value.strip()
    if site and PLAIN_PATH.fullmatch(value):
        return site + value
    try:
        return urljoin(base, value)
    except ValueError:
        return value


def page_facts(source: str, target: str | None) -> tuple[str, str | None, list[dict]]:
    """Visible text with one line a block, title and links of a page."""
    page = Page(source)
    hidden = [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        hidden[e] = hidden[page.parent[e]] or page.tag[e] in NO_TEXT
    parts = [("\n" if starts else "") + " ".join(f"|{text}|".split())[1:-1] for e, text, starts in page.segments if not hidden[e]]
    lines = [line.strip() for line in "".join(parts).split("\n")]
    title = " ".join("".join(text for e, text, _ in page.segments if page.tag[e] == "title").split())
    links, found = [], SITE.match(target or "")
    site = found[0] if found else None
    for e, tag in enumerate(page.tag):
        name = LINK_ATTRIBUTES.get(tag)
        value = page.attributes(e).get(name) if name and page.attrs[e] else None
        if value:
            links.append({"path": f"{tag}@/{name}", "url": joined(site, target or "", value)})
    return "\n".join(line for line in lines if line), title or None, links


def derivatives_of(record: bytes | None, content_bytes: int = CONTENT_BYTES) -> list[dict]:
    """Metadata and conversion record of one response; nothing for other record types; one row with
    the ``problem`` for bytes that are no record."""
    problem = dict.fromkeys(DERIVATIVE.names)
    if not record:
        return [problem | {"problem": "empty"}]
    head, end, block = record.partition(END)
    if not end or not head.startswith(b"WARC/"):
        return [problem | {"problem": "no header"}]
    source = headers_of(head)
    kind, source_id, target, date = (get(source, n) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    if kind is None or source_id is None:
        return [problem | {"problem": "no type or identifier", "target_uri": target}]
    if kind.lower() != "response":
        return []
    length = get(source, "Content-Length")
    if length is None or not length.isdigit() or int(length) > len(block):
        return [problem | {"problem": "truncated", "refers_to": source_id, "target_uri": target}]
    http_head, _, body = block[: int(length)].partition(END)
    http, status = headers_of(http_head), http_head.split(b"\r\n")[0].decode("latin-1")
    try:
        sent, content = unpacked(body, http, content_bytes)
    except TooLarge:
        return [problem | {"problem": "content too large", "refers_to": source_id, "target_uri": target}]
    content_type = get(http, "content-type") or ""
    digest = get(source, "WARC-Payload-Digest")
    computed = sha1_label(sent)
    # Digests of other algorithms or spellings cannot be compared.
    digest_ok = None
    if digest and digest.lower().startswith("sha1:"):
        digest_ok = digest.upper() == computed.upper() or (sent is not body and digest.upper() == sha1_label(body).upper())
    text, charset = decoded(content, content_type)
    title, links = None, []
    if not content_type or "html" in content_type.lower():
        text, title, links = page_facts(text, target)
    elif not content_type.lower().startswith("text/"):
        text = ""
    envelope = {
        "source": {"headers": [list(h) for h in source]}, "http": {"status": status, "headers": [list(h) for h in http]},
        "payload": {"digest": digest, "computed": computed, "length": len(sent), "charset": charset},
        "html": {"title": title, "links": links},
    }
    common = {"refers_to": source_id, "target_uri": target, "date": date, "source_payload_digest": digest, "digest_ok": digest_ok, "problem": None}
    out = []
    metadata_id = derived_id(source_id, "metadata")
    for kind, own_id, beside, media, data in (
        ("metadata", metadata_id, None, "application/json", json.dumps(envelope, ensure_ascii=False).encode()),
        ("conversion", derived_id(source_id, "conversion"), metadata_id, "text/plain; charset=utf-8", text.encode()),
    ):
        block_digest = sha1_label(data)
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Refers-To", source_id), ("WARC-Concurrent-To", beside),
            ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Block-Digest", block_digest), ("Content-Type", media),
        ]
        out.append(common | {
            "type": kind, "record_id": own_id, "concurrent_to": beside, "content_type": media, "block_digest": block_digest,
            "content_length": len(data), "record": make_record(fields, data),
        })
    return out


ARROW = pa.list_(pa.struct(
    [(n, pa.string()) for n in FIELDS] + [("digest_ok", pa.bool_()), ("content_length", pa.int64()), ("record", pa.binary()), ("problem", pa.string())]
))


def derivatives(record: Column, content_bytes: int = CONTENT_BYTES) -> Column:
    """``array<struct>`` of the records derived from one record (see ``DERIVATIVE``)."""

    @F.arrow_udf(T.ArrayType(DERIVATIVE))
    def built(column: pa.Array) -> pa.Array:
        return pa.array([derivatives_of(x.as_py(), content_bytes) for x in column], ARROW)

    return built(record)


def build_derivatives(records: DataFrame, record_col: str = "record", content_bytes: int = CONTENT_BYTES) -> DataFrame:
    """One row per derived record of a frame of WARC records. Null and unreadable records, and those
    whose compressed content has more than ``content_bytes`` bytes, give a row with a ``problem`` and
    no type; records that are no responses give none. Chunks count up to the first size that is no
    hexadecimal number. Equal records give
    equal derivatives; an empty frame gives an empty one; other columns are not read."""
    return records.select(F.explode(derivatives(F.col(f"`{record_col}`"), content_bytes)).alias("d")).select("d.*")


def responses(key: Column, url: Column, page: Column, seconds: Column) -> Column:
    """Response records of stored pages; ``seconds`` since 1970 is their date."""

    @F.arrow_udf(T.BinaryType())
    def made(keys: pa.Array, urls: pa.Array, pages: pa.Array, times: pa.Array) -> pa.Array:
        from datetime import UTC, datetime

        out = []
        for k, u, p, t in zip(keys, urls, pages, times):
            body = (p.as_py() or "").encode()
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(body) + END + body
            date = datetime.fromtimestamp(t.as_py() or 0, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            fields = [
                ("WARC-Type", "response"), ("WARC-Record-ID", derived_id(f"{k.as_py()} {u.as_py()}", "response")), ("WARC-Target-URI", u.as_py()),
                ("WARC-Date", date), ("WARC-Payload-Digest", sha1_label(body)), ("WARC-Block-Digest", sha1_label(block)),
                ("Content-Type", "application/http; msgtype=response"),
            ]
            out.append(make_record(fields, block))
        return pa.array(out, pa.binary())

    return made(key, url, page, seconds)


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` as response records. A null page is an empty body, a null address is left out."""
    key = F.col(f"`{id_col}`").cast("string")
    stamp = F.coalesce(F.pmod(F.col(f"`{id_col}`").cast("long"), F.lit(1 << 31)), F.lit(0))
    return pages.select(responses(key, F.col(f"`{url_col}`"), F.col(f"`{html_col}`"), stamp).alias("record"))


def write_warc(records: DataFrame, path: str, record_col: str = "record") -> None:
    """Records as WARC files, one per partition: the text writer copies their bytes and ends each
    with the two line ends that the format asks for."""
    records.select(F.col(f"`{record_col}`").cast("string").alias("value")).filter("value IS NOT NULL").write.option("lineSep", "\r\n\r\n").text(path)
