"""A small tolerant HTML tree of block elements, enough to tell content from boilerplate."""

from __future__ import annotations

import re
from html import unescape

#: A comment, a declaration or a tag. A tag ends at ">", or before the next "<"; only after "=" does a quote begin a value.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
#: Elements whose text is never rendered and holds no elements: they run to their end tag.
RAW = frozenset("script style title textarea iframe template".split())
#: Elements whose text is no prose. One that isn't closed ends where a block begins or ends.
SKIP = frozenset("svg select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset figure figcaption "
    "blockquote pre address details summary dialog menu hgroup search center".split()
)
#: A start tag of the key closes open elements of the value, up to the nearest element of _SCOPE.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("html body ul ol dl table main article section nav aside header footer div form td th blockquote".split())


class Tree:
    """Block elements in document order: ``parent``, ``tag``, ``attrs`` by element; ``runs`` of text by element."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.attrs: list[str] = [""]
        self.keep: list[str] = [""]
        #: (element, text, length of link text) in document order; a run ends where a block begins or ends.
        self.runs: list[tuple[int, str, int]] = []


def _close(stack: list[tuple[str, int]], names: frozenset | set, stop: frozenset) -> bool:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            del stack[i:]
            return True
        if stack[i][0] in stop:
            return False
    return False


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)


def parse(html: str) -> Tree:
    """The tree of a page, in one pass. Unknown elements, math, object and noscript are part of what they stand in."""
    t = Tree()
    stack: list[tuple[str, int]] = [("html", 0)]  # (name, nearest block element)
    buf: list[str] = []
    unclosed: set[str] = set()
    links, in_link, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal links
        if buf:
            text = "".join(buf)
            text = _SPACE.sub(" ", unescape(text) if "&" in text else text).strip()
            if text:
                t.runs.append((stack[-1][1], text, links))
            buf.clear()
        links = 0

    def add(s: str) -> None:
        nonlocal links
        buf.append(s)
        links += len(s) if in_link else 0

    def end_of(name: str, start: int) -> int | None:
        """Behind the end tag; a name without one further on isn't looked for again."""
        if name in unclosed:
            return None
        end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, start)
        if end is None:
            unclosed.add(name)
        return end and end.end()

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                in_link = 0
            elif name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            elif name in BLOCK:
                flush()
                _close(stack, {name}, frozenset() if name != "p" else _SCOPE)
            elif name == "br":
                add(" ")
            continue
        if name in RAW:
            add(" " if name in ("iframe", "textarea") else "")
            end = end_of(name, at)
            # the text of an unclosed script or style runs to the end; of the others only the tag is ignored
            at = end if end is not None else n if name in ("script", "style") else at
        elif name in SKIP:
            add(" ")
            block = _BLOCK_TAG.search(html, at)
            end = None if m.group(3).rstrip().endswith("/") else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at, block.start() if block else n)
            if end is not None:
                at = end.end()
            elif not m.group(3).rstrip().endswith("/"):
                at = block.start() if block else n
        elif name in BLOCK:
            flush()
            if name in ("html", "body") and (name == "html" or any(x[0] == "body" for x in stack)):
                continue
            _close(stack, {"p"}, _SCOPE - {"p"})
            if name in _CLOSES:
                _close(stack, _CLOSES[name], _SCOPE - _CLOSES[name])
            elif name[0] == "h" and name[1:].isdigit():
                _close(stack, {"h1", "h2", "h3", "h4", "h5", "h6"}, _SCOPE)
            in_link = 0
            attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m.group(3))} if m.group(3) else {}
            t.parent.append(stack[-1][1])
            t.tag.append(name)
            t.attrs.append(" ".join(attrs.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop", "hidden")).lower())
            t.keep.append(attrs.get("data-label", ""))
            stack.append((name, len(t.tag) - 1))
        elif name in ("br", "hr", "img", "input", "button", "label", "embed", "option"):
            add(" ")
        elif name == "a":
            in_link = 1
    flush()
    return t
