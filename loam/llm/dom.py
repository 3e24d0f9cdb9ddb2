"""Block structure of HTML pages, good markup or bad."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: How HTML treats its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title noscript template svg select option object audio video canvas iframe datalist".split())
#: What a head can hold; anything else ends it.
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())
BLOCK = frozenset(
    "html body article section main div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption details summary address hgroup dialog menu search center hr button label legend".split()
)
CLOSED_BY = {
    "p": BLOCK - {"button", "label", "legend"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<annotation(?:-xml)?\b[^>]*>.*?</annotation(?:-xml)?\s*>"  # what math says again for programs
    r"|<(script|style|textarea|title|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:\s|^)(class|id|role|src|alt|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Node:
    """An element that makes a block, or with the tag #text a run of text inside one."""

    tag: str
    parent: int
    depth: int
    names: frozenset[str] = frozenset()
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)
    media: list[tuple[int, str, str]] = field(default_factory=list)  # place in text, source, alternative text


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def blocks(page: str, media: bool = False) -> list[Node]:
    """The nodes of a page, parents before children and in page order. Texts are decoded, and
    white space in them is one space. ``media``: also keep where images stand."""
    nodes = [Node("#page", -1, 0)]
    stack, unseen, links = [0], 0, 0
    parts: list[str] = []
    linked = 0
    found: list[tuple[int, str, str]] = []

    def flush() -> None:
        nonlocal parts, linked, found
        text = " ".join("".join(parts).split())
        if (text or found) and not unseen:
            up = stack[-1]
            nodes[up].children.append(len(nodes))
            nodes.append(Node("#text", up, nodes[up].depth + 1, text=text, linked=min(linked, len(text)), media=found))
        parts, linked, found = [], 0, []

    def say(text: str) -> None:
        nonlocal linked
        if nodes[stack[-1]].tag == "head" and text.strip():
            close()
        if text and not unseen:
            if "&" in text:
                text = unescape(text)
            parts.append(text)
            if links:
                linked += len(text)

    def close() -> None:
        nonlocal unseen
        flush()
        unseen -= nodes[stack.pop()].tag in UNSEEN

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if nodes[stack[-1]].tag == "head" and not m[2] and tag not in HEAD:
            close()
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            elif tag == "img" and media and not unseen:
                has = attributes(m[4])
                found.append((len(" ".join("".join(parts).split())), has.get("src", ""), has.get("alt", "")))
            continue
        if tag == "a":
            links = 0 if m[2] else 1
            continue
        if tag not in BLOCK and tag not in UNSEEN:
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    while len(stack) > i:
                        close()
                    break
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(nodes[stack[-1]].tag, ()):
            close()
        flush()
        if m[4].endswith("/") and tag in UNSEEN:
            continue
        has = attributes(m[4])
        names = frozenset(x.lower() for a in ("class", "id", "role", "itemprop") if a in has for x in PIECES.findall(has[a]))
        up = stack[-1]
        nodes[up].children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(Node(tag, up, nodes[up].depth + 1, names))
        unseen += tag in UNSEEN
    say(page[at:])
    while len(stack) > 1:
        close()
    flush()
    return nodes
