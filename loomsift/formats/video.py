"""Video: tags by ffprobe where it is installed, else by our own box, chunk and element readers."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile

from ..options import Options
from .audio import blank_mp4, mp4_items
from .errors import CleanError, FormatError, ToolMissing

Items = list[tuple[str, str]]


def tag_lines(text: str) -> Items:
    """Tags of a probe's JSON report, of the format and of every stream, in order."""
    try:
        report = json.loads(text)
    except ValueError:
        return []
    parts = [*report.get("streams", []), report.get("format", {})] if isinstance(report, dict) else []
    return [(k, str(v)) for p in parts if isinstance(p, dict) for k, v in (p.get("tags") or {}).items() if k and str(v)]


def tool(name: str) -> str:
    path = shutil.which(name)
    if not path:
        raise ToolMissing(f"{name} is not installed")
    return path


def _run(args: list[str], timeout: float | None) -> str:
    try:
        done = subprocess.run(args, capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        raise CleanError(f"{args[0]} took more than {timeout:g} s") from None
    if done.returncode:
        raise CleanError(done.stderr.decode("utf-8", "replace")[-300:] or f"{args[0]} failed")
    return done.stdout.decode("utf-8", "replace")


_SIMPLE = {0x7BA9: "title", 0x4D80: "muxing_app", 0x5741: "writing_app"}


def _vint(b: bytes, at: int, keep: bool) -> tuple[int, int]:
    if at >= len(b) or not b[at]:
        raise FormatError("bad EBML number")
    n = 9 - b[at].bit_length()
    v = int.from_bytes(b[at : at + n], "big")
    return (v if keep else v & (1 << 7 * n) - 1), at + n


def ebml(b: bytes, at: int, end: int):
    """(id, id offset, data offset, end) of the elements of a level; one of unknown size reaches the end."""
    while at < end:
        try:
            ident, p = _vint(b, at, True)
            size, q = _vint(b, p, False)
        except FormatError:
            return
        stop = end if size == (1 << 7 * (q - p)) - 1 else q + size
        if stop > end:
            return
        yield ident, at, q, stop
        at = stop


_SEGMENT, _INFO, _TAGS, _TAG, _SIMPLETAG = 0x18538067, 0x1549A966, 0x1254C367, 0x7373, 0x67C8


def _mkv_items(b: bytes) -> Items:
    out: Items = []
    for ident, _, s, e in ebml(b, 0, len(b)):
        if ident != _SEGMENT:
            continue
        for kind, _, a, z in ebml(b, s, e):
            if kind == _INFO:
                out += [(_SIMPLE[k], b[x:y].rstrip(b"\0").decode("utf-8", "replace")) for k, _, x, y in ebml(b, a, z) if k in _SIMPLE]
            elif kind == _TAGS:
                for t, _, x, y in ebml(b, a, z):
                    for st, _, p, q in ebml(b, x, y) if t == _TAG else ():
                        if st == _SIMPLETAG:
                            part = {k: b[m:n].rstrip(b"\0").decode("utf-8", "replace") for k, _, m, n in ebml(b, p, q)}
                            out.append((part.get(0x45A3, ""), part.get(0x4487, "(binary data)")))
    return out


def _clean_mkv(b: bytes) -> bytes:
    """Tags become Void elements and the texts of Info spaces of the same size, so that no offset moves."""
    out = bytearray(b)
    for ident, _, s, e in ebml(b, 0, len(b)):
        if ident != _SEGMENT:
            continue
        for kind, at, a, z in ebml(b, s, e):
            if kind == _TAGS or kind == 0x1941A469:
                n = z - at
                out[at:z] = (b"\xec" + ((1 << 56) | n - 9).to_bytes(8, "big") + b"\0" * (n - 9)) if n >= 9 else b"\xec" + bytes([0x80 | n - 2]) + b"\0" * (n - 2)
            elif kind == _INFO:
                for k, _, x, y in ebml(b, a, z):
                    if k in (*_SIMPLE, 0x73A4, 0x4461):
                        out[x:y] = (b" " if k in _SIMPLE else b"\0") * (y - x)
    return bytes(out)


_INFO_LIST = re.compile(rb"LIST(....)INFO", re.S)


def _avi_items(b: bytes) -> Items:
    out: Items = []
    for m in _INFO_LIST.finditer(b):
        at, end = m.end(), min(len(b), m.start() + 8 + int.from_bytes(m[1], "little"))
        while at + 8 <= end:
            n = int.from_bytes(b[at + 4 : at + 8], "little")
            out.append((b[at : at + 4].decode("latin-1"), b[at + 8 : at + 8 + n].split(b"\0")[0].decode("utf-8", "replace")))
            at += 8 + n + (n & 1)
    return out


def _clean_avi(b: bytes) -> bytes:
    out = bytearray(b)
    for m in _INFO_LIST.finditer(b):
        n = int.from_bytes(m[1], "little")
        if m.start() + 8 + n <= len(b):
            out[m.start() : m.start() + 4] = b"JUNK"
            out[m.start() + 8 : m.start() + 8 + n] = b"\0" * n
    return bytes(out)


def _own(body: bytes) -> str | None:
    if body[4:8] == b"ftyp":
        return "mp4"
    return "mkv" if body[:4] == b"\x1aE\xdf\xa3" else "avi" if body[:4] == b"RIFF" and body[8:12] == b"AVI " else None


def read_video(body: bytes, name: str = "", options: Options = Options(), **_: object) -> Items:
    if shutil.which("ffprobe"):
        with tempfile.TemporaryDirectory() as d:
            path = os.path.join(d, "in" + os.path.splitext(name)[1])
            with open(path, "wb") as f:
                f.write(body)
            return tag_lines(_run(["ffprobe", "-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path], options.timeout_s))
    kind = _own(body)
    if kind is None:
        tool("ffprobe")
    return {"mp4": lambda b: mp4_items(b, ""), "mkv": _mkv_items, "avi": _avi_items}[kind](body)


def clean_video(body: bytes, name: str = "", options: Options = Options(), **_: object) -> bytes:
    if shutil.which("ffmpeg"):
        with tempfile.TemporaryDirectory() as d:
            src, dst = (os.path.join(d, x + os.path.splitext(name)[1]) for x in ("in", "out"))
            with open(src, "wb") as f:
                f.write(body)
            exact = [x for s in ("", ":v", ":a") for x in (f"-{'f' if not s else ''}flags{s}", "+bitexact")]
            _run(["ffmpeg", "-y", "-v", "error", "-i", src, "-map", "0", "-c", "copy", "-map_metadata", "-1", "-map_chapters", "-1", "-disposition", "0", *exact, dst], options.timeout_s)
            with open(dst, "rb") as f:
                return f.read()
    kind = _own(body)
    if kind is None:
        tool("ffmpeg")
    return {"mp4": blank_mp4, "mkv": _clean_mkv, "avi": _clean_avi}[kind](body)
