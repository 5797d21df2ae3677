"""A small tolerant HTML reader: elements with subtree hashes, and the page's text in order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s>/]*+)[^>]*+(?:>|\Z)"
    r"""|<([a-zA-Z][^\s>/]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<([a-zA-Z][^\s>/]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption".split())
_LIST_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass
class Page:
    """Elements by number (0 is the page itself) and the events that rebuild the page in order.

    events: (element, text) for text; (element, None) for an element's start and (-element - 1, None) for its end.
    """

    tags: list[str] = field(default_factory=lambda: [""])
    attrs: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    hashes: list[int] = field(default_factory=lambda: [0])
    events: list[tuple[int, str | None]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def parse(source: str | None) -> Page:
    """Read a page. Anything is a page: end tags may be missing, extra or crossed, and null is an empty page."""
    page, stack, parts, open_tags = Page(), [0], [[]], {}
    tags, attrs, parents, hashes, events = page.tags, page.attrs, page.parents, page.hashes, page.events

    def close() -> None:
        i, own = stack.pop(), parts.pop()
        h = xxhash.xxh64_intdigest(f"{tags[i]}\x00".encode() + b"".join(own), 1)
        hashes[i] = h
        open_tags[tags[i]] -= 1
        parts[-1].append(h.to_bytes(8, "little"))
        events.append((-i - 1, None))

    def text(s: str) -> None:
        if not s:
            return
        if "&" in s:
            s = html.unescape(s)
        events.append((stack[-1], s))
        if flat := " ".join(s.split()):
            parts[-1].append(flat.encode("utf-8", "replace"))

    source, at = source or "", 0
    while m := _TOKEN.search(source, at):
        text(source[at : m.start()])
        at = m.end()
        if end := m[1]:
            end = end.lower()
            if open_tags.get(end):
                while tags[stack[-1]] != end:
                    close()
                close()
            continue
        if not (tag := m[2] or m[4]):
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, attr = tag.lower(), (m[3] if m[2] else m[5]) or ""
        if tag in _CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in _CLOSES[tag]:
                    while len(stack) > i:
                        close()
                    break
                if tags[stack[i]] in _LIST_ENDS[tag]:
                    break
        elif tag not in INLINE and tag not in VOID and tag not in RAW and open_tags.get("p"):
            while tags[stack[-1]] != "p":
                close()
            close()
        i = len(tags)
        tags.append(tag)
        attrs.append(attr)
        parents.append(stack[-1])
        hashes.append(0)
        events.append((i, None))
        if tag in VOID or attr.endswith("/") and tag in ("svg", "path", "use"):
            events.append((-i - 1, None))
            continue
        stack.append(i)
        parts.append([])
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s>/]|\Z)", re.I).search(source, at)
            at = stop.start() if stop else len(source)
            if not stop:
                break
    text(source[at:])
    while len(stack) > 1:
        close()
    return page
