"""A small HTML reader: element tree and text segments of one page.

Raw-text elements, implied end tags, comments and broken ends are handled the way browsers do, as
far as it matters for text. The work is linear in the page; depth needs no recursion.
"""

from __future__ import annotations

import html
import re
from collections import Counter

TOKEN = re.compile(
    r"<(?:!--(?:.*?(?:-->|$))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*>|.*$)|[!?/][^>]*(?:>|$))", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript noframes iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
SILENT = frozenset("script style template link meta base".split())  # no text and no break in it
# A start tag of the first set ends an open element of the second, unless one of the third is between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "tr"}, {"table"}),
}
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
MAY_END_OTHERS = CLOSES_PARAGRAPH | IMPLIED_ENDS.keys()


class Page:
    """``tag``, ``parent``, ``attrs`` of the elements in page order, element 0 being the root;
    ``segments`` are ``(element, text, starts a block)`` in page order, references decoded."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.segments: list[tuple[int, str, bool]] = []
        self.read(source)

    def read(self, source: str) -> None:
        stack, at, broken, length = [0], 0, True, len(source)
        self.open: Counter[str] = Counter()
        tags, parents, attributes, segments, opened = self.tag, self.parent, self.attrs, self.segments, self.open
        search, unescape = TOKEN.search, html.unescape
        while at < length:
            found = search(source, at)
            upto = found.start() if found else length
            if upto > at:
                text = source[at:upto]
                segments.append((stack[-1], unescape(text) if "&" in text else text, broken))
                broken = False
            if not found:
                break
            at = found.end()
            end, tag, attrs = found.groups()
            if tag is None or attrs[-1:] != ">":
                continue  # a comment or declaration, or a tag that the page's end cuts off
            tag = tag.lower()
            if tag not in INLINE and tag not in SILENT:
                broken = True
            if end:
                if tags[stack[-1]] == tag and len(stack) > 1:
                    stack.pop()
                    opened[tag] -= 1
                else:
                    self.close(stack, tag)
                continue
            if tag in MAY_END_OTHERS:
                self.imply_ends(stack, tag)
            tags.append(tag)
            parents.append(stack[-1])
            attributes.append(attrs[:-1])
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(source, at)
                inner = source[at : end.start() if end else length]
                if inner and tag in ("title", "textarea"):
                    inner = unescape(inner)
                if inner:
                    segments.append((len(tags) - 1, inner, broken))
                    broken = tag not in SILENT
                at = end.end() if end else length
                continue
            stack.append(len(tags) - 1)
            opened[tag] += 1

    def cut(self, stack: list[int], at: int) -> None:
        for e in stack[at:]:
            self.open[self.tag[e]] -= 1
        del stack[at:]

    def imply_ends(self, stack: list[int], tag: str) -> None:
        if tag in CLOSES_PARAGRAPH:
            self.close(stack, "p", limits=("table", "button", "td", "th", "caption", "body", "html"))
        if tag in IMPLIED_ENDS:
            ended, limits = IMPLIED_ENDS[tag]
            if not any(self.open[t] for t in ended):
                return
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in limits:
                    break
                if self.tag[stack[i]] in ended:
                    self.cut(stack, i)
                    break

    def close(self, stack: list[int], tag: str, limits: tuple[str, ...] = ()) -> None:
        """End the nearest open element of a name; an end tag without one is ignored. An inline end
        tag does not reach beyond the block it stands in. Without an open element of the name the
        stack is not searched."""
        if not self.open[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            own = self.tag[stack[i]]
            if own == tag:
                self.cut(stack, i)
                return
            if own in limits or (tag in INLINE and own not in INLINE):
                return

    def attributes(self, element: int) -> dict[str, str]:
        out = {}
        for name, value in ATTRIBUTE.findall(self.attrs[element]):
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            out.setdefault(name.lower(), html.unescape(value))
        return out


def join_blocks(segments: list[tuple[int, str, bool]], wanted: list[bool]) -> str:
    """Text of the wanted elements: white space inside a block is one space, blocks are trimmed
    and joined by one space."""
    out, broken = [], False
    for element, text, starts in segments:
        broken = broken or starts
        if wanted[element]:
            out.append(" " + text if broken else text)
            broken = False
    return " ".join("".join(out).split())
