"""Web pages as Markdown text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.language import choose_language

PAGES_AT_ONCE = 64
HIDDEN = {"head", "script", "style", "noscript", "template", "svg", "iframe"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "ul", "ol", "table", "form", "figure", "aside", "dl", "body"}
MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "del": "~~", "s": "~~"}


class _Markdown(HTMLParser):
    """Collects Markdown while one page is parsed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            self.out.append("\n" if tag in ("ul", "ol") and len(self.lists) > 1 else "\n\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag in MARKS and not self.pre:
            self.out.append(MARKS[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "img":
            values = dict(attrs)
            self.out.append(f"![{values.get('alt') or ''}]({values.get('src') or ''})")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in MARKS and not self.pre:
            self.out.append(MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in BLOCKS or tag == "blockquote":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data if self.pre else _squeeze(data))


def _squeeze(data: str) -> str:
    words = " ".join(data.split())
    if not words:
        return " " if data else ""
    return (" " if data[0].isspace() else "") + words + (" " if data[-1].isspace() else "")


def page_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    lines, blank, fenced = [], True, False
    for line in (x.rstrip() for x in "".join(parser.out).split("\n")):
        if line == "```":
            fenced = not fenced
        if line or not blank or fenced:
            lines.append(line if fenced or line.startswith("  ") else line.lstrip())
        blank = not line
    return "\n".join(lines).strip()


@F.arrow_udf(StringType())
def html_to_markdown(html: pa.Array) -> pa.Array:
    """Pages are opened a few at a time; beside these a task holds Arrow batches only."""
    parts = [pa.array([], pa.string())]
    for at in range(0, len(html), PAGES_AT_ONCE):
        pages = html.slice(at, PAGES_AT_ONCE).to_pylist()
        parts.append(pa.array([None if page is None else page_markdown(page) for page in pages], pa.string()))
    return pa.concat_arrays(parts)


def markdown_pages(pages: DataFrame, langs: list[str], html_col: str = "html") -> DataFrame:
    """All pages with Markdown ``text`` and the ``_lang`` of the whole text. A page without html has a
    null text; it and pages too short for the detector fall back to the first language."""
    texts = pages.withColumn("text", html_to_markdown(html_col)).drop(html_col)
    return texts.withColumn("_lang", choose_language(F.col("text"), langs))


def gzip_members(content: bytes) -> Iterator[bytes]:
    """The parts of a gzip file one by one; uncompressed content is one part."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(wbits=31)
        yield member.decompress(content)
        content = member.unused_data


def warc_responses(content: bytes) -> Iterator[tuple[str, str]]:
    """``(url, body)`` of the response records of one WARC file, compressed or not."""
    for data in gzip_members(content):
        at = data.find(b"WARC/")
        while at >= 0:
            head_end = data.find(b"\r\n\r\n", at)
            if head_end < 0:
                break
            lines = data[at:head_end].split(b"\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
            end = head_end + 4 + int(fields.get(b"content-length", b"0"))
            if fields.get(b"warc-type") == b"response":
                _, _, body = data[head_end + 4 : end].partition(b"\r\n\r\n")
                yield fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), body.decode("utf-8", "replace")
            at = data.find(b"WARC/", end)
