"""Leaf text blocks of an HTML page, with the ancestors that a block classifier looks at."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Elements whose text is no page text.
RAW = frozenset("script style noscript template textarea svg iframe object math canvas audio video select datalist".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; every other element starts a new block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rt rp nobr".split())
#: Start tags that leave the head open; any other one, or text, begins the body.
HEAD = frozenset("html head title meta link base basefont bgsound style script noscript template".split())
#: A start tag that ends an open element of these names.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Elements that such an end stops at.
SCOPE = frozenset("ul ol dl table article section div body html aside nav header footer main form td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Block(NamedTuple):
    text: str
    path: tuple  # (tag, class and id tokens) of each open block element, outermost first
    linked: int  # characters inside links
    link_count: int


def _tokens(attrs: str) -> tuple[str, ...]:
    out = []
    for name, a, b, c in _ATTR.findall(attrs):
        value = unescape(a or b or c).lower()
        name = name.lower()
        if name in ("class", "id", "itemprop"):
            out += [t for t in re.split(r"[^a-z]+", value) if t]
        elif name == "role":
            out += ["role", *value.split()]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.append("hidden")
    return tuple(out)


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. A block is the text between two borders of block
    elements, character references decoded, white space runs as one space, trimmed; blocks
    without text are left out. Comments, declarations and RAW elements hold no text, nor
    does the head, which ends with its end tag, a start tag that can't be in it, or text. Unclosed, wrongly nested and stray tags are taken as browsers do: a
    paragraph ends where a block element starts, an end tag closes what is open inside its
    element, and one without an element is ignored."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    text: list[str] = []
    state = [0, 0, 0]  # characters in links, links, open links
    at, size, head = 0, len(html), None  # head: None before it, True inside, False after

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, tuple(stack), state[0], state[1]))
            text.clear()
        state[0] = state[1] = 0

    def add(raw: str):
        nonlocal head
        if head is not False and raw.strip():
            head = False
        if raw and not head:
            piece = unescape(raw) if "&" in raw else raw
            text.append(piece)
            if state[2]:
                state[0] += len(piece.strip())

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                state[2] = 0
            elif tag == "head":
                head = False
            elif tag == "br":
                text.append(" ")
            elif tag not in INLINE:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag not in HEAD:
            head = False
        if tag in RAW or tag == "title":
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not m[0].endswith("/>"):
                at = end.end() if end else size
            if tag not in INLINE:
                flush()
            continue
        if tag == "br" or tag == "img" or tag == "wbr":
            if tag == "br":
                text.append(" ")
            continue
        if tag == "a":
            state[1] += 1
            state[2] = 1
            continue
        if tag == "head":
            head = True if head is None else head
            continue
        if tag in INLINE:
            continue
        flush()
        if stack and stack[-1][0] == "p":
            stack.pop()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in CLOSES.get(tag, ()):
                del stack[i:]
                break
            if stack[i][0] in SCOPE and stack[i][0] not in ("td", "th"):
                break
        if tag not in VOID and not m[0].endswith("/>"):
            stack.append((tag, _tokens(m[3]) if m[3] else ()))
    flush()
    return out
