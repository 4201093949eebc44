"""HTML and CSS: metadata items and scrubbed copies."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import utf8
from .fixed import HTML_DROP, HTML_META_NAMES, HTML_RAW_TEXT, HTML_VOID

Items = list[tuple[str, str]]

_WS = " \t\r\n\x0c"


@dataclass
class Token:
    """kind: text, comment, decl, open or close."""

    kind: str
    raw: str
    name: str = ""
    closed: bool = False


_TAG_NAME = re.compile(r"<([^ \t\r\n>/]*)")
_TAG_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_RAW_END = {n: re.compile(rf"</{n}(?=[>/ \t\r\n\x0c]|$)", re.I) for n in HTML_RAW_TEXT}


def tokens(src: str):
    """Tokens whose ``raw`` parts add up to the source. A tag without an end is text, as is everything after it."""
    at, n = 0, len(src)
    while at < n:
        if src[at] != "<":
            end = src.find("<", at)
            end = n if end < 0 else end
            yield Token("text", src[at:end])
        elif src.startswith("<!--", at):
            end = src.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield Token("comment", src[at:end])
        elif src[at + 1 : at + 2] in ("!", "?"):
            end = src.find(">", at)
            end = n if end < 0 else end + 1
            yield Token("decl", src[at:end])
        elif src.startswith("</", at):
            end = src.find(">", at)
            if end < 0:
                yield Token("text", src[at:])
                return
            end += 1
            yield Token("close", src[at:end], (re.split(r"[\s/]", src[at + 2 : end - 1].strip() + " ", maxsplit=1)[0]).lower())
        else:
            name = _TAG_NAME.match(src, at)
            m = _TAG_REST.match(src, name.end())
            if m is None:
                yield Token("text", src[at:])
                return
            end = m.end()
            tag = Token("open", src[at:end], name[1].lower() if name[1].isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), name[1]))
            tag.closed = src[at : end - 1].rstrip(_WS + ">").endswith("/")
            yield tag
            if tag.name in HTML_RAW_TEXT and not tag.closed:
                stop = _RAW_END[tag.name].search(src, end)
                stop = stop.start() if stop else n
                if stop > end:
                    yield Token("text", src[end:stop])
                end = stop
        at = end


_ATTRIBUTE = re.compile(r"([ \t\r\n\x0c]*)([^=\s>/]*)(?:[ \t\r\n\x0c]*(=)[ \t\r\n\x0c]*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>/]*)))?")


def attributes(tag: str, strict: bool = True) -> list[tuple[str, str]]:
    """(lower-cased key, value) in order. ``strict``: an unquoted value, and the scan, end at a slash."""
    at = _TAG_NAME.match(tag).end()
    out = []
    while at < len(tag):
        m = _ATTRIBUTE.match(tag, at)
        if not m[2]:
            stop = m.start() + len(m[1])
            if m[3]:  # a value without a key
                out.append(("", next((v for v in m.group(4, 5, 6) if v is not None), "")))
                at = m.end()
                continue
            if not strict and stop < len(tag) and tag[stop] == "/":
                at = stop + 1
                continue
            break
        out.append((m[2].lower(), next((v for v in m.group(4, 5, 6) if v is not None), "")))
        at = m.end()
    return out


def _first(attrs: list[tuple[str, str]], *keys: str) -> str | None:
    return next((v for k, v in attrs if k in keys), None)


def html_items(src: str) -> Items:
    out: Items = []
    title: list[str] | None = None
    inline = None
    pointer = {"base": "href", "iframe": "src", "embed": "src", "object": "data"}
    for t in tokens(src):
        if t.kind == "open":
            if t.name == "title":
                title = []
            elif t.name == "meta":
                a = attributes(t.raw)
                label = _first(a, *HTML_META_NAMES)
                out.append(("(meta)" if label is None else label, _first(a, "content") or ""))
            elif t.name == "link":
                a = attributes(t.raw)
                out.append(("<link>", " ".join(f"{k}={v}" for k in ("rel", "href") if (v := _first(a, k)) is not None)))
            elif t.name in pointer:
                out.append((f"<{t.name}>", f"{pointer[t.name]}={_first(attributes(t.raw), pointer[t.name]) or ''}"))
            elif t.name in ("script", "style", "noscript"):
                source = _first(attributes(t.raw), "src")
                if source is not None:
                    out.append((f"<{t.name}>", f"src={source}"))
                elif not t.closed:
                    out.append((f"<{t.name}>", "inline (0 bytes)"))
                    inline = t.name
        elif t.kind == "close":
            if t.name == "title" and title is not None:
                if text := "".join(title).strip():
                    out.append(("title", text))
                title = None
            if t.name == inline:
                inline = None
        elif t.kind == "text":
            if title is not None:
                title.append(t.raw)
            if inline and out and out[-1][0] == f"<{inline}>":
                out[-1] = (out[-1][0], f"inline ({len(t.raw.encode())} bytes)")
    return out


_HANDLER = re.compile(r"[\s/\"'][oO][nN][A-Za-z]")
_ATTR_SPAN = re.compile(r"([ \t\r\n\x0c/]*)([^=\s>/]+|=)([ \t\r\n\x0c]*=[ \t\r\n\x0c]*(?:\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")


def strip_handlers(tag: str) -> str:
    """A tag without its on* attributes. Unquoted values may hold slashes, so no handler hides behind one."""
    if not _HANDLER.search(tag):
        return tag
    head = _TAG_NAME.match(tag).end()
    body, tail = tag[head:-1], tag[-1:]
    end = re.search(r"[ \t\r\n\x0c]*/?[ \t\r\n\x0c]*$", body).start()
    kept = _ATTR_SPAN.sub(lambda m: "" if re.match(r"[oO][nN][A-Za-z]", m[2]) else m[0], body[:end])
    return tag[:head] + kept + body[end:] + tail


def clean_html_text(src: str) -> str:
    out: list[str] = []
    titles = 0
    dropped: list[str] = []
    for t in tokens(src):
        if dropped:
            if t.name == dropped[-1]:
                if t.kind == "open" and not t.closed:
                    dropped.append(t.name)
                elif t.kind == "close":
                    dropped.pop()
            continue
        if t.kind == "open":
            if t.name in HTML_DROP:
                if not t.closed and t.name not in HTML_VOID:
                    dropped.append(t.name)
                continue
            out.append(strip_handlers(t.raw))
            titles += t.name == "title" and not t.closed
        elif t.kind == "close":
            if t.name not in HTML_DROP:
                titles -= t.name == "title" and titles > 0
                out.append(t.raw)
        elif t.kind == "decl" or t.kind == "text" and not titles:
            out.append(t.raw)
    return "".join(out)


def read_html(body: bytes, **_: object) -> Items:
    return html_items(utf8(body))


def clean_html(body: bytes, **_: object) -> bytes:
    return clean_html_text(utf8(body)).encode()


_CSS = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)|/\*(.*?)(?:(\*/)|$)", re.S)


def read_css(body: bytes, **_: object) -> Items:
    out: Items = []
    n = 0
    for m in _CSS.finditer(utf8(body)):
        if m[1] is None or not m[2]:
            continue
        n += 1
        pairs = []
        for line in m[1].splitlines():
            key, colon, value = re.sub(r"^[\s*]+|[\s*]+$", "", line).partition(":")
            if colon and key.strip() and value.strip():
                pairs.append((key.strip(), value.strip()))
        text = m[1].strip()
        out += pairs or ([(f"comment #{n}", text)] if text else [])
    return out


def clean_css(body: bytes, **_: object) -> bytes:
    return _CSS.sub(lambda m: m[0] if m[1] is None else "", utf8(body)).encode()
