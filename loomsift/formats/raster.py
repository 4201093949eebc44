"""Images: GIF, JPEG, PNG, WebP, TIFF, and EXIF boxes of HEIF and JPEG XL."""

from __future__ import annotations

import struct
import zlib

from .errors import CleanError, FormatError
from .fixed import PNG_DROP
from .packets import _SIZES, _STRUCTURE, exif_items, iptc_items, tiff_entries, xmp_items

Items = list[tuple[str, str]]


# ---- GIF ----
def _color_table(flags: int) -> int:
    return 3 << (flags & 7) + 1 if flags & 0x80 else 0


def _sub_blocks(body: bytes, at: int) -> tuple[list[bytes], int]:
    """Sub-blocks from ``at`` and where they end, or -1 if they are cut off."""
    out = []
    while at < len(body):
        n = body[at]
        if not n:
            return out, at + 1
        if at + 1 + n > len(body):
            break
        out.append(body[at + 1 : at + 1 + n])
        at += 1 + n
    return out, -1


def gif_blocks(body: bytes):
    """(start, end, kind, identifier, sub-blocks); a block that is cut off has end -1 and is the last."""
    if body[:6] not in (b"GIF89a", b"GIF87a"):
        raise FormatError("no GIF signature")
    if len(body) < 13:
        yield 0, -1, "header", b"", []
        return
    at = 13 + _color_table(body[10])
    while at < len(body):
        start, mark = at, body[at]
        if mark == 0x3B:
            yield start, start + 1, "end", b"", []
            return
        if mark == 0x2C:
            if at + 10 > len(body):
                break
            subs, at = _sub_blocks(body, at + 11 + _color_table(body[at + 9]))
            yield start, at, "image", b"", subs
        elif mark == 0x21 and at + 2 <= len(body):
            kind, ident = body[at + 1], b""
            at += 2
            if kind == 0xFF and at < len(body):
                n = body[at]
                ident, at = body[at + 1 : at + 1 + n], at + 1 + n
            subs, at = _sub_blocks(body, at)
            yield start, at, {0xFE: "comment", 0xFF: "application"}.get(kind, "extension"), ident, subs
        else:
            break
        if at < 0:
            return
    yield at, -1, "cut", b"", []


def read_gif(body: bytes, **_: object) -> Items:
    out: Items = []
    for _, end, kind, ident, subs in gif_blocks(body):
        if end < 0 and not subs:
            continue
        if kind == "comment":
            out.append(("Comment", b"".join(subs).decode("utf-8", "replace")))
        elif kind == "application" and ident != b"NETSCAPE2.0":
            out.append((f"Application: {ident.decode('utf-8', 'replace')}", f"{len(subs)} sub-block(s), {sum(map(len, subs))} bytes total"))
    return out


def clean_gif(body: bytes, **_: object) -> bytes:
    out, ended = [], False
    head = None
    for start, end, kind, ident, _ in gif_blocks(body):
        if head is None:
            head = start
            out.append(body[:start])
        if end < 0:
            raise CleanError("the GIF is cut off")
        ended = kind == "end"
        if kind == "comment" or kind == "application" and ident != b"NETSCAPE2.0":
            continue
        out.append(body[start:end])
    if not ended:
        raise CleanError("the GIF is cut off")
    return b"".join(out)


# ---- JPEG ----
def jpeg_segments(body: bytes):
    """(marker, start, end) up to the scan; the rest comes as marker 0xDA. Raises at a segment that is cut off."""
    if body[:2] != b"\xff\xd8":
        raise FormatError("no JPEG signature")
    at = 2
    while at < len(body):
        if body[at] != 0xFF:
            raise FormatError("no JPEG marker where one should be")
        m = at
        while m < len(body) and body[m] == 0xFF:
            m += 1
        if m >= len(body):
            raise FormatError("the JPEG is cut off")
        kind = body[m]
        if kind in (0xDA, 0xD9):
            yield 0xDA if kind == 0xDA else kind, at, len(body)
            return
        if 0xD0 <= kind <= 0xD8 or kind == 1:
            yield kind, at, m + 1
            at = m + 1
            continue
        if m + 3 > len(body):
            raise FormatError("the JPEG is cut off")
        end = m + 1 + int.from_bytes(body[m + 1 : m + 3], "big")
        if end > len(body):
            raise FormatError("the JPEG is cut off")
        yield kind, at, end
        at = end


_XMP = b"http://ns.adobe.com/xap/1.0/\0"
_PHOTOSHOP = b"Photoshop 3.0\0"
_UNREAD = ("EXIF data", "present (could not parse individual tags)")


def _jpeg_items(body: bytes) -> Items:
    """EXIF tags first, then what the other segments hold, in file order."""
    exif, rest, icc = [], [], False
    try:
        for kind, start, end in jpeg_segments(body):
            data = body[start + 4 : end]
            if kind == 0xE1 and data.startswith(b"Exif\0\0"):
                exif += exif_items(data[6:])
            elif kind == 0xE1 and data.startswith(_XMP):
                rest += xmp_items(data[len(_XMP) :]) or [("XMP data", "present")]
            elif kind == 0xED and data.startswith(_PHOTOSHOP):
                rest += iptc_items(data[len(_PHOTOSHOP) :]) or [("IPTC/Photoshop data", "present")]
            elif kind == 0xE2 and data.startswith(b"ICC_PROFILE\0") and not icc:
                rest.append(("ICC Profile", "present"))
                icc = True
    except FormatError:
        pass  # what was found before the damage counts
    return exif + rest


def _clean_jpeg(body: bytes) -> bytes:
    out = [b"\xff\xd8"]
    for kind, start, end in jpeg_segments(body):
        if not (0xE1 <= kind <= 0xEF or kind == 0xFE):
            out.append(body[start:end])
    return b"".join(out)


# ---- PNG ----
def png_chunks(body: bytes):
    if body[:8] != b"\x89PNG\r\n\x1a\n":
        raise FormatError("no PNG signature")
    at = 8
    while at + 12 <= len(body):
        n = int.from_bytes(body[at : at + 4], "big")
        end = at + 12 + n
        if end > len(body):
            raise FormatError("the PNG is cut off")
        yield body[at + 4 : at + 8], body[at + 8 : end - 4], body[at:end]
        if body[at + 4 : at + 8] == b"IEND":
            return
        at = end
    raise FormatError("the PNG is cut off")


def _png_text(kind: bytes, data: bytes) -> tuple[str, str] | None:
    key, _, rest = data.partition(b"\0")
    try:
        if kind == b"zTXt":
            rest = zlib.decompressobj().decompress(rest[1:], 1 << 20)
        elif kind == b"iTXt":
            packed, rest = rest[0], rest[2:].split(b"\0", 2)[2]
            return key.decode("latin-1"), (zlib.decompressobj().decompress(rest, 1 << 20) if packed else rest).decode("utf-8", "replace")
        return key.decode("latin-1"), rest.decode("latin-1")
    except (zlib.error, IndexError):
        return None


def _png_items(body: bytes, extended: bool) -> Items:
    out: Items = []
    icc: Items = []
    unread: Items = []
    try:
        for kind, data, _ in png_chunks(body):
            if kind == b"eXIf":
                found = exif_items(data)
                out += found
                unread = [] if found else [_UNREAD]
            elif kind == b"iCCP":
                icc.append(("ICC Profile", "present"))
            elif extended and kind in (b"tEXt", b"zTXt", b"iTXt") and (t := _png_text(kind, data)):
                out.append(t)
            elif extended and kind == b"tIME" and len(data) == 7:
                y, mo, d, h, mi, s = struct.unpack(">HBBBBB", data)
                out.append(("Modified", f"{y:04}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}"))
    except FormatError:
        pass
    return out + icc + unread


def _clean_png(body: bytes) -> bytes:
    return body[:8] + b"".join(raw for kind, _, raw in png_chunks(body) if kind not in PNG_DROP)


# ---- WebP ----
def riff_chunks(body: bytes, form: bytes):
    if body[:4] not in (b"RIFF", b"FORM") or body[8:12] != form:
        raise FormatError(f"no {form.decode().strip()} container")
    order = "little" if body[:4] == b"RIFF" else "big"
    at = 12
    while at + 8 <= len(body):
        n = int.from_bytes(body[at + 4 : at + 8], order)
        end = at + 8 + n
        if end > len(body):
            raise FormatError("the container is cut off")
        yield body[at : at + 4], body[at + 8 : end], body[at : min(end + (n & 1), len(body))] + b"\0" * (n & 1 and end == len(body))
        at = end + (n & 1)


def build_riff(head: bytes, form: bytes, chunks: list[bytes]) -> bytes:
    data = form + b"".join(chunks)
    return head + len(data).to_bytes(4, "little" if head == b"RIFF" else "big") + data


def _webp_items(body: bytes) -> Items:
    exif, icc, unread, xmp = [], [], [], []
    try:
        for kind, data, _ in riff_chunks(body, b"WEBP"):
            if kind == b"EXIF":
                exif += exif_items(data.removeprefix(b"Exif\0\0"))
                unread = [] if exif else [_UNREAD]
            elif kind == b"ICCP":
                icc.append(("ICC Profile", "present"))
            elif kind == b"XMP ":
                xmp += xmp_items(data) or [("XMP data", "present")]
    except FormatError:
        pass
    return exif + icc + unread + xmp


def _clean_webp(body: bytes) -> bytes:
    out = []
    for kind, data, raw in riff_chunks(body, b"WEBP"):
        if kind in (b"EXIF", b"XMP ", b"ICCP"):
            continue
        if kind == b"VP8X" and data:  # the flags of what is gone
            raw = raw[:8] + bytes([raw[8] & ~0x2C]) + raw[9:]
        out.append(raw)
    return build_riff(b"RIFF", b"WEBP", out)


# ---- TIFF and boxes ----
def _clean_tiff(body: bytes) -> bytes:
    """In place: blanks every value that isn't structural and takes its entry out of the directory."""
    if body[:4] not in (b"II*\0", b"MM\0*"):
        raise CleanError("no TIFF signature")
    out = bytearray(body)
    directories: list[tuple[int, int, str]] = []
    keep = _STRUCTURE | {0x14A}  # pictures in directories of their own
    for _, tag, kind, count, where, _, _ in tiff_entries(body, directories):
        if tag not in keep:
            n = _SIZES[kind] * count
            out[where : where + n] = b"\0" * n
    for at, n, order in directories:
        entries = [bytes(out[e : e + 12]) for e in range(at + 2, at + 2 + 12 * n, 12)]
        left = [e for e in entries if struct.unpack_from(order + "H", e)[0] in keep]
        rest = bytes(body[at + 2 + 12 * n : at + 6 + 12 * n])  # where the next directory is
        out[at : at + 2 + 12 * n + len(rest)] = (struct.pack(order + "H", len(left)) + b"".join(left) + rest).ljust(2 + 12 * n + len(rest), b"\0")
    return bytes(out)


def _exif_spans(body: bytes) -> list[tuple[int, int]]:
    """TIFF blocks that follow an Exif mark in a HEIF or JPEG XL file, up to the end of the file."""
    out, at = [], 0
    while (at := body.find(b"Exif\0\0", at)) >= 0:
        at += 6
        if body[at : at + 4] in (b"II*\0", b"MM\0*"):
            out.append((at, len(body)))
    return out


def _box_items(body: bytes) -> Items:
    out: Items = []
    for a, b in _exif_spans(body):
        out += exif_items(body[a:b])
    if not out and b"Exif" in body:
        out.append(_UNREAD)
    x = body.find(b"<x:xmpmeta")
    if x >= 0:
        out += xmp_items(body[x : body.find(b"</x:xmpmeta>", x) + 12])
    return out


def _clean_boxes(body: bytes) -> bytes:
    if body[4:8] not in (b"ftyp", b"JXL ") and body[:2] != b"\xff\x0a":
        raise CleanError("no HEIF or JPEG XL signature")
    out = bytearray(body)
    for a, b in _exif_spans(body):
        out[a:b] = _clean_tiff(bytes(out[a:b]))
    x = body.find(b"<x:xmpmeta")
    end = body.find(b"</x:xmpmeta>", x)
    if 0 <= x < end:
        out[x : end + 12] = b" " * (end + 12 - x)
    return bytes(out)


def _sniff(body: bytes) -> str:
    if body[:2] == b"\xff\xd8":
        return "jpeg"
    if body[:4] == b"\x89PNG":
        return "png"
    if body[:4] == b"RIFF" and body[8:12] == b"WEBP":
        return "webp"
    return "tiff" if body[:4] in (b"II*\0", b"MM\0*") else "boxes" if body[4:8] in (b"ftyp", b"JXL ") or body[:2] == b"\xff\x0a" else ""


def read_image(body: bytes, extended: bool = False, **_: object) -> Items:
    kind = _sniff(body)
    return {"jpeg": _jpeg_items, "webp": _webp_items, "tiff": exif_items, "boxes": _box_items}.get(kind, lambda b: _png_items(b, extended) if kind == "png" else [])(body)


def clean_image(body: bytes, **_: object) -> bytes:
    kind = _sniff(body)
    if not kind:
        raise CleanError("no known image signature")
    return {"jpeg": _clean_jpeg, "png": _clean_png, "webp": _clean_webp, "tiff": _clean_tiff, "boxes": _clean_boxes}[kind](body)


# ---- Harmless ----
def read_harmless(body: bytes, mime: str = "", name: str = "", **_: object) -> Items:
    if not is_netpbm(mime, name):
        return []
    lines = body[:8192].decode("utf-8", "replace").splitlines()
    found = [x.lstrip() for x in lines if x.lstrip().startswith("#")]
    return [(f"comment line {i}", x) for i, x in enumerate(found, 1)]


def is_netpbm(mime: str, name: str) -> bool:
    return mime.startswith("image/x-portable-") or name.lower().endswith((".pnm", ".pbm", ".pgm", ".ppm"))


def clean_harmless(body: bytes, mime: str = "", name: str = "", **_: object) -> bytes:
    if not is_netpbm(mime, name):
        return body
    out, at, tokens = bytearray(), 0, 0
    need = 3 if body[:2] in (b"P1", b"P4") else 4
    inside = False
    while at < len(body) and tokens < need:
        c = body[at]
        if c == 0x23 and not inside:
            end = body.find(b"\n", at)
            at = len(body) if end < 0 else end
            continue
        space = c in b" \t\r\n"
        if space and inside:
            tokens += 1
            inside = False
            if tokens == need:
                break
        inside = inside or not space
        out.append(c)
        at += 1
    return bytes(out) + body[at:]
