"""XML by spans of the source: tags are found, everything that stays is copied verbatim."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .errors import FormatError

_PIECE = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[[^\]]*\])*>|<(/?)([^\s<>/!?][^\s<>/]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTR = re.compile(r"(\s+)([^\s=<>\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


@dataclass
class Node:
    """kind: text, open, close, empty, or misc (comment, PI, CDATA, doctype)."""

    kind: str
    raw: str
    name: str = ""

    @property
    def local(self) -> str:
        return self.name.split(":", 1)[-1]

    def attrs(self) -> list[tuple[str, str]]:
        return [(m[2], m[3][1:-1]) for m in _ATTR.finditer(self.raw)]


def nodes(src: str, strict: bool = True) -> Iterator[Node]:
    """Nodes whose ``raw`` parts add up to the source; ``strict`` raises at broken markup and unbalanced tags."""
    at, stack = 0, []
    for m in _PIECE.finditer(src):
        if m.start() > at:
            text = src[at : m.start()]
            if "<" in text:
                if strict:
                    raise FormatError("malformed XML")
                return
            yield Node("text", text)
        at = m.end()
        if m[2] is None:
            yield Node("misc", m[0])
        elif m[1]:
            if not stack or stack.pop() != m[2]:
                if strict:
                    raise FormatError(f"unexpected </{m[2]}>")
                return
            yield Node("close", m[0], m[2])
        else:
            if not m[4]:
                stack.append(m[2])
            yield Node("empty" if m[4] else "open", m[0], m[2])
    if at < len(src):
        if "<" in src[at:]:
            if strict:
                raise FormatError("malformed XML")
            return
        yield Node("text", src[at:])
    if stack and strict:
        raise FormatError(f"<{stack[-1]}> is not closed")


def rewrite(src: str, drop: Callable[[Node], bool] = lambda n: False, unwrap: Callable[[Node], bool] = lambda n: False, change: Callable[[Node], str] | None = None, comments: bool = True) -> str:
    """Source without the subtrees that ``drop`` names, without the tags of ``unwrap``, start and empty tags changed."""
    out: list[str] = []
    depth = 0
    for n in nodes(src):
        if depth:
            depth += (n.kind == "open") - (n.kind == "close")
            continue
        if n.kind in ("open", "empty") and drop(n):
            depth = int(n.kind == "open")
            continue
        if n.name and unwrap(n) or not comments and n.raw.startswith("<!--") and n.kind == "misc":
            continue
        out.append(change(n) if change and n.kind in ("open", "empty") else n.raw)
    return "".join(out)


def edit_attrs(tag: str, keep: Callable[[str, str], bool]) -> str:
    return _ATTR.sub(lambda m: m[0] if keep(m[2], m[3][1:-1]) else "", tag)


def sort_attributes(src: str) -> str:
    """Attributes of every start and empty tag in the order of their raw keys."""

    def change(n: Node) -> str:
        found = list(_ATTR.finditer(n.raw))
        if len(found) < 2:
            return n.raw
        body = "".join(f" {m[2]}={m[3]}" for m in sorted(found, key=lambda m: m[2].encode()))
        return f"<{n.name}{body}{'/' if n.kind == 'empty' else ''}>"

    return rewrite(src, change=change)


def tag_texts(src: str, wanted: frozenset[str]) -> list[tuple[str, str]]:
    """(local name, trimmed text) of wanted elements, in order; empty ones don't count, a broken rest is left out."""
    out = []
    current = None
    for n in nodes(src, strict=False):
        if n.kind == "open":
            current = n.local if n.local in wanted else None
        elif n.kind == "close":
            current = None
        elif n.kind == "text" and current and (text := decode(n.raw).strip()):
            out.append((current, text))
    return out


def decode(text: str) -> str:
    from html import unescape

    return unescape(text) if "&" in text else text
