"""Metadata packets inside other files: XMP, IPTC, EXIF."""

from __future__ import annotations

import re
import struct

from .fixed import IPTC_NAMES, XMP_PREFIXES

Items = list[tuple[str, str]]

_TAG = re.compile(r"<!--.*?-->|<\?.*?\?>|</[^>]*>|<([^ \t\r\n>/]+)[^>]*?(/?)>", re.S)


def xmp_items(body: bytes, nested: bool = False) -> Items:
    """Simple elements of the known prefixes. ``nested`` also lists the items of RDF containers and attribute forms."""
    try:
        src = body.decode("utf-8")
    except UnicodeDecodeError:
        return []
    out: Items = []
    at = 0
    while m := _TAG.search(src, at):
        at = m.end()
        if m[1] is None:
            continue
        if nested:
            out += [(f"XMP {k}", v.strip()) for k, v in re.findall(r"\s([\w.-]+:[\w.-]+)\s*=\s*[\"']([^\"']*)", m[0]) if k.split(":")[0] in XMP_PREFIXES and v.strip()]
        if m[2] or m[1].split(":")[0] not in XMP_PREFIXES:
            continue
        end = src.find(f"</{m[1]}>", at)
        if end < 0:
            break
        value = src[at:end].strip()
        at = end + len(m[1]) + 3
        if value and "<" not in value:
            out.append((f"XMP {m[1]}", value))
        elif nested:
            out += [(f"XMP {m[1]}", v.strip()) for v in re.findall(r"<rdf:li[^>]*>([^<]*)</rdf:li>", value) if v.strip()]
    return out


def iim_items(body: bytes) -> Items:
    out: Items = []
    at = body.find(b"\x1c")
    while 0 <= at <= len(body) - 5:
        record, dataset, n = struct.unpack_from(">BBH", body, at + 1)
        if at + 5 + n > len(body):
            break
        if record == 2 and dataset in IPTC_NAMES:
            out.append((f"IPTC {IPTC_NAMES[dataset]}", body[at + 5 : at + 5 + n].decode("utf-8", "replace")))
        at = body.find(b"\x1c", at + 5 + n)
    return out


def iptc_items(body: bytes) -> Items:
    """Resource 0x0404 of an 8BIM block sequence; stops at the first one that is cut off."""
    out: Items = []
    at = body.find(b"8BIM")
    while 0 <= at <= len(body) - 12:
        name = 1 + body[at + 6]
        size_at = at + 6 + name + (name & 1)
        if size_at + 4 > len(body):
            break
        n = int.from_bytes(body[size_at : size_at + 4], "big")
        start = size_at + 4
        if start + n > len(body):
            break
        if body[at + 4 : at + 6] == b"\x04\x04":
            out += iim_items(body[start : start + n])
        at = body.find(b"8BIM", start + n + (n & 1))
    return out


_EXIF = {
    0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit",
    0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist", 0x013C: "HostComputer", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9010: "OffsetTime", 0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment",
    0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA420: "ImageUniqueID", 0xA430: "OwnerName", 0xA431: "SerialNumber", 0xA432: "LensInfo", 0xA433: "LensMake", 0xA434: "LensModel",
}
_GPS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 16: "GPSImgDirectionRef", 17: "GPSImgDirection", 29: "GPSDateStamp"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_POINTERS = {0x8769: _EXIF, 0x8825: _GPS, 0xA005: {}}
_STRUCTURE = frozenset({0x100, 0x101, 0x102, 0x103, 0x106, 0x111, 0x115, 0x116, 0x117, 0x11C, 0x140, 0x142, 0x143, 0x144, 0x145, 0x152, 0x153, 0x15B, 0x211, 0x212, 0x213, 0x214, 0x201, 0x202, 0xA001})


def _value(body: bytes, order: str, kind: int, n: int, raw: bytes) -> str:
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        got = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
        return ", ".join(f"{a}/{b}" for a, b in zip(got[::2], got[1::2]))
    if kind == 7 or kind == 1 and n > 16:
        return f"<{n} bytes>"
    code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}[kind]
    return ", ".join(map(str, struct.unpack(f"{order}{n}{code}", raw)))


def tiff_entries(body: bytes, directories: list[tuple[int, int, str]] | None = None):
    """(entry offset, tag, kind, count, value offset, order, names) over all directories, each once.

    ``directories`` gets (offset, entries, order) of each whole directory.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(body[:4])
    if order is None:
        return
    queue = [(struct.unpack_from(order + "I", body, 4)[0], _EXIF)] if len(body) >= 8 else []
    seen: set[int] = set()
    while queue:
        at, names = queue.pop(0)
        if at in seen or not 8 <= at <= len(body) - 2:
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", body, at)[0]
        if directories is not None and at + 2 + 12 * n <= len(body):
            directories.append((at, n, order))
        for i in range(n):
            e = at + 2 + 12 * i
            if e + 12 > len(body):
                return
            tag, kind, count = struct.unpack_from(order + "HHI", body, e)
            size = _SIZES.get(kind, 0) * count
            where = e + 8 if size <= 4 else struct.unpack_from(order + "I", body, e + 8)[0]
            if not size or where + size > len(body):
                continue
            yield e, tag, kind, count, where, order, names
            if tag in _POINTERS and kind == 4 and count == 1:
                queue.append((struct.unpack_from(order + "I", body, where)[0], _POINTERS[tag]))
        if at + 2 + 12 * n + 4 <= len(body):
            queue.append((struct.unpack_from(order + "I", body, at + 2 + 12 * n)[0], names))


def exif_items(body: bytes) -> Items:
    out: Items = []
    for _, tag, kind, count, where, order, names in tiff_entries(body):
        if tag not in _POINTERS and (names is not _EXIF or tag not in _STRUCTURE):
            out.append((names.get(tag, f"Tag0x{tag:04X}"), _value(body, order, kind, count, body[where : where + _SIZES[kind] * count])))
    return out
