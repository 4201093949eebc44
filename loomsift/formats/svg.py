"""SVG: leaking attributes, described elements, active content."""

from __future__ import annotations

import re

from .errors import utf8
from .fixed import SVG_DROP, SVG_EVENTS, SVG_PREFIXES
from .xmltext import Node, decode, edit_attrs, nodes, rewrite

_EVENTS = frozenset(SVG_EVENTS)
_PREFIXES = tuple(SVG_PREFIXES)


def is_event(name: str) -> bool:
    return name.lower() in _EVENTS


def is_script_uri(value: str) -> bool:
    """Character references are decoded and control characters dropped first, as browsers do."""
    return re.sub(r"[\x00-\x20]+", "", decode(value)).lower().startswith("javascript:")


def _leak(name: str, value: str) -> str | None:
    if name.startswith(_PREFIXES):
        return ""
    if is_event(name):
        return " (event handler)"
    if name.split(":", 1)[-1] == "href" and is_script_uri(value):
        return " (javascript: uri)"
    return None


def read_svg(body: bytes, **_: object) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    inside = None
    for n in nodes(body.decode("utf-8", "replace"), strict=False):
        if n.kind in ("open", "empty"):
            out += [(f"<{n.name}> {k}{kind}", v) for k, v in n.attrs() if (kind := _leak(k, v)) is not None]
            if n.kind == "open" and n.local in SVG_DROP:
                inside = n.local
        elif n.kind == "close":
            inside = None
        elif inside and n.kind == "text" and (text := n.raw.strip()):
            out.append((f"<{inside}>", text))
    return out


def clean_svg(body: bytes, **_: object) -> bytes:
    def change(n: Node) -> str:
        return edit_attrs(n.raw, lambda k, v: _leak(k, v) is None and not (k.startswith("xmlns:") and k[6:] + ":" in _PREFIXES))

    return rewrite(utf8(body), drop=lambda n: n.local in SVG_DROP, change=change, comments=False).encode()
