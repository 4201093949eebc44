"""Torrent files: bencode."""

from __future__ import annotations

import re

from .errors import FormatError
from .fixed import TORRENT_KEEP

DEPTH = 256
_INT = re.compile(rb"i(0|-?[1-9][0-9]*)e")
_LEN = re.compile(rb"(0|[1-9][0-9]*):")


def decode(body: bytes) -> object:
    """int, bytes, list or dict; an iterative parser, nesting is limited to DEPTH."""
    at, stack, root, done = 0, [], None, False

    def put(v: object) -> None:
        nonlocal root, done
        if not stack:
            root, done = v, True
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(v)
        elif stack[-1][1] is None:
            if not isinstance(v, bytes):
                raise FormatError("invalid dictionary key")
            stack[-1][1] = v
        else:
            stack[-1][0][stack[-1][1]] = v
            stack[-1][1] = None

    while not done:
        if at >= len(body):
            raise FormatError("unexpected end")
        c = body[at : at + 1]
        if c == b"e" and stack:
            value, key = stack.pop()
            if key is not None:
                raise FormatError("dictionary key without a value")
            at += 1
            put(value)
        elif stack and isinstance(stack[-1][0], dict) and stack[-1][1] is None and not c.isdigit():
            raise FormatError("invalid dictionary key")
        elif c in (b"l", b"d"):
            if len(stack) >= DEPTH:
                raise FormatError("nested too deeply")
            stack.append([[] if c == b"l" else {}, None])
            at += 1
        elif c == b"i":
            m = _INT.match(body, at)
            if not m or not -(1 << 63) <= int(m[1]) < 1 << 63:
                raise FormatError("invalid integer")
            put(int(m[1]))
            at = m.end()
        else:
            m = _LEN.match(body, at)
            if not m:
                raise FormatError("invalid string" if c.isdigit() else "bad prefix")
            if len(m[1]) > 18 or m.end() + int(m[1]) > len(body):
                raise FormatError("unexpected end")
            at = m.end() + int(m[1])
            put(body[m.end() : at])
    if at != len(body):
        raise FormatError("trailing bytes")
    return root


def encode(v: object) -> bytes:
    if isinstance(v, bool) or not isinstance(v, (int, bytes, list, dict)):
        raise TypeError(type(v))
    if isinstance(v, int):
        return b"i%de" % v
    if isinstance(v, bytes):
        return b"%d:%s" % (len(v), v)
    if isinstance(v, list):
        return b"l" + b"".join(map(encode, v)) + b"e"
    return b"d" + b"".join(encode(k) + encode(v[k]) for k in sorted(v)) + b"e"


def display(v: object) -> str:
    if isinstance(v, bytes):
        try:
            return v.decode()
        except UnicodeDecodeError:
            return f"<{len(v)} bytes of binary data>"
    return str(v) if isinstance(v, int) else f"[{len(v)} items]" if isinstance(v, list) else f"{{{len(v)} keys}}"


def _root(body: bytes) -> dict:
    v = decode(body)
    if not isinstance(v, dict):
        raise FormatError("the root is no dictionary")
    return v


def read_torrent(body: bytes, **_: object) -> list[tuple[str, str]]:
    v = _root(body)
    return [(k.decode("utf-8", "replace"), display(v[k])) for k in sorted(v) if k not in TORRENT_KEEP]


def clean_torrent(body: bytes, **_: object) -> bytes:
    v = _root(body)
    return encode({k: v[k] for k in TORRENT_KEEP if k in v})
