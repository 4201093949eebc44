"""Audio tags: ID3, FLAC and Ogg comments, RIFF and AIFF chunks, MP4 items."""

from __future__ import annotations

import base64
import struct

from ..options import Options
from .errors import CleanError, FormatError
from .fixed import AUDIO_NAMES, PICTURE_KINDS
from .raster import build_riff, read_gif, read_image, riff_chunks

Items = list[tuple[str, str]]


def _picture(tag: str, n: int, kind: int, data: bytes) -> Items:
    label = f"[{tag}] Picture #{n}"
    named = PICTURE_KINDS[kind] if kind < len(PICTURE_KINDS) else f"Undefined({kind})"
    out = [(label, f"{named}, {len(data)} bytes")]
    try:
        inner = read_gif(data) if data[:3] == b"GIF" else read_image(data)
    except Exception:
        inner = []
    return out + [(f"{label} \N{RIGHTWARDS ARROW} {k}", v) for k, v in inner]


# ---- ID3 ----
def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_span(body: bytes, at: int = 0) -> int:
    """End of an ID3v2 tag at ``at``, or ``at``."""
    if body[at : at + 3] != b"ID3" or len(body) < at + 10:
        return at
    return min(len(body), at + 10 + _syncsafe(body[at + 6 : at + 10]) + (10 if body[at + 5] & 0x10 else 0))


def _id3_text(data: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0] if data else 0, "latin-1")
    return data[1:].decode(code, "replace").strip("\0").replace("\0", "; ")


def id3_items(body: bytes) -> Items:
    end, out, n = id3_span(body), [], 0
    at, major = 10, body[3]
    while at + 10 <= end and body[at : at + 1].isalnum():
        key = body[at : at + 4].decode("latin-1")
        raw = body[at + 4 : at + 8]
        size = _syncsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        data = body[at + 10 : min(at + 10 + size, end)]
        at += 10 + size
        name = AUDIO_NAMES.get(key, key)
        if key == "APIC":
            code = data[0] if data else 0
            mime_end = data.find(b"\0", 1)
            rest = data[mime_end + 2 :]
            stop = b"\0\0" if code in (1, 2) else b"\0"
            cut = rest.find(stop)
            n += 1
            out += _picture("Id3v2", n, data[mime_end + 1] if 0 < mime_end < len(data) - 1 else 0, rest[cut + len(stop) :])
        elif key == "TXXX":
            desc, _, value = _id3_text(data).partition("; ")
            out.append((f"[Id3v2] {desc}", value))
        elif key in ("COMM", "USLT"):
            out.append((f"[Id3v2] {name}", _id3_text(data[:1] + data[4:]).split("; ", 1)[-1]))
        elif key[0] == "T":
            out.append((f"[Id3v2] {name}", _id3_text(data)))
        elif key[0] == "W":
            out.append((f"[Id3v2] {name}", data.decode("latin-1")))
        else:
            out.append((f"[Id3v2] {name}", "(binary data)"))
    return out


def id3v1_items(body: bytes) -> Items:
    if len(body) < 128 or body[-128:-125] != b"TAG":
        return []
    t = body[-128:]
    out = [(k, t[a:b].split(b"\0")[0].decode("latin-1").strip()) for k, a, b in (("Title", 3, 33), ("Artist", 33, 63), ("Album", 63, 93), ("Year", 93, 97), ("Comment", 97, 125))]
    return [(f"[Id3v1] {k}", v) for k, v in out if v]


def _strip_mpeg(body: bytes) -> bytes:
    at = 0
    while (end := id3_span(body, at)) > at:
        at = end
    end = len(body)
    if end - at >= 128 and body[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end - at >= 32 and body[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack_from("<I4xI", body, end - 20)
        end = max(at, end - size - (32 if flags & 0x80000000 else 0))
    return body[at:end]


# ---- FLAC and Ogg ----
def comment_items(data: bytes, tag: str) -> Items:
    try:
        n = struct.unpack_from("<I", data, 0)[0]
        at = 4 + n
        count = struct.unpack_from("<I", data, at)[0]
        at += 4
        out: Items = []
        pictures = 0
        for _ in range(min(count, len(data) // 4)):
            n = struct.unpack_from("<I", data, at)[0]
            key, _, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
            at += 4 + n
            if key.upper() == "METADATA_BLOCK_PICTURE":
                pictures += 1
                out += _flac_picture(tag, pictures, base64.b64decode(value))
            elif key.upper() != "ENCODER":
                out.append((f"[{tag}] {AUDIO_NAMES.get(key.upper(), key)}", value))
        return out
    except (struct.error, ValueError):
        return []


def _flac_picture(tag: str, n: int, data: bytes) -> Items:
    try:
        kind, a = struct.unpack_from(">II", data, 0)
        b = struct.unpack_from(">I", data, 8 + a)[0]
        at = 12 + a + b + 16
        size = struct.unpack_from(">I", data, at)[0]
        return _picture(tag, n, kind, data[at + 4 : at + 4 + size])
    except struct.error:
        return []


def flac_blocks(body: bytes, at: int = 4):
    """(type, data) of the metadata blocks; returns where the frames begin."""
    last = False
    while not last:
        if at + 4 > len(body):
            raise FormatError("the FLAC is cut off")
        head, n = body[at], int.from_bytes(body[at + 1 : at + 4], "big")
        if at + 4 + n > len(body):
            raise FormatError("the FLAC is cut off")
        yield head & 0x7F, body[at + 4 : at + 4 + n]
        at, last = at + 4 + n, bool(head & 0x80)
    return at


def _flac(body: bytes) -> tuple[list[tuple[int, bytes]], int]:
    start = id3_span(body)
    if body[start : start + 4] != b"fLaC":
        raise FormatError("no FLAC signature")
    out = []
    gen = flac_blocks(body, start + 4)
    while True:
        try:
            out.append(next(gen))
        except StopIteration as e:
            return out, e.value


def _clean_flac(body: bytes) -> bytes:
    blocks, frames = _flac(body)
    kept = [(k, b"\0" * 8 if k == 4 else d) for k, d in blocks if k not in (2, 6)]
    head = b"".join(bytes([k | (0x80 if i == len(kept) - 1 else 0)]) + len(d).to_bytes(3, "big") + d for i, (k, d) in enumerate(kept))
    return b"fLaC" + head + body[frames:]


_CRC = []


def _ogg_crc(data: bytes) -> int:
    if not _CRC:
        for i in range(256):
            r = i << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
            _CRC.append(r)
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def ogg_pages(body: bytes):
    """(header without segments, packet pieces as (bytes, complete)) of each page."""
    at = 0
    while at < len(body):
        if body[at : at + 4] != b"OggS" or at + 27 > len(body):
            raise FormatError("the Ogg stream is cut off")
        table = body[at + 27 : at + 27 + body[at + 26]]
        data = at + 27 + len(table)
        if data + sum(table) > len(body) or len(table) < body[at + 26]:
            raise FormatError("the Ogg stream is cut off")
        pieces, start, size = [], data, 0
        for s in table:
            size += s
            if s < 255:
                pieces.append((body[start : start + size], True))
                start, size = start + size, 0
        if size:
            pieces.append((body[start : start + size], False))
        yield body[at : at + 26], pieces, body[at : data + sum(table)]
        at = data + sum(table)


_OGG = {b"\x03vorbis": b"\x01vorbis", b"OpusTags": b"OpusHead"}


def _ogg_comment(body: bytes) -> tuple[bytes, bytes, int, int] | None:
    """(mark, comment data, first page, last page) of the second packet."""
    packet, first, done = b"", None, 0
    for i, (_, pieces, _) in enumerate(ogg_pages(body)):
        for data, complete in pieces:
            if done == 1:
                first = i if first is None else first
                packet += data
            if complete:
                done += 1
                if done == 2:
                    mark = next((m for m in _OGG if packet.startswith(m)), None)
                    return (mark, packet, first, i) if mark else None
    return None


def _clean_ogg(body: bytes) -> bytes:
    found = _ogg_comment(body)
    if not found:
        raise CleanError("no Vorbis or Opus comment header")
    mark, packet, first, last = found
    fresh = mark + b"\0" * 8 + (b"\x01" if mark == b"\x03vorbis" else b"")
    pages = list(ogg_pages(body))
    later = [p for _, pieces, _ in pages[first : last + 1] for p in pieces]
    skipped = 0
    rest: list[tuple[bytes, bool]] = []
    for data, complete in later:  # what follows the comment packet on its last page
        if skipped:
            rest.append((data, complete))
        elif complete:
            skipped = 1
    out = [raw for _, _, raw in pages[:first]]
    head = bytearray(pages[first][0])
    table, payload = b"", b""
    for data, complete in [(fresh, True), *rest]:
        n, r = divmod(len(data), 255)
        table += b"\xff" * n + (bytes([r]) if complete else b"")
        payload += data
    if len(table) > 255:
        raise CleanError("the comment page can't be rebuilt")
    head[6:14] = pages[last][0][6:14]
    shift = last - first
    for i, raw in enumerate([bytes(head) + bytes([len(table)]) + table + payload, *(p[2] for p in pages[last + 1 :])]):
        page = bytearray(raw)
        number = int.from_bytes(page[18:22], "little") - (shift if i else 0)
        page[18:22] = number.to_bytes(4, "little")
        page[22:26] = b"\0\0\0\0"
        page[22:26] = _ogg_crc(bytes(page)).to_bytes(4, "little")
        out.append(bytes(page))
    return b"".join(out)


# ---- RIFF and AIFF ----
def _wav_items(body: bytes) -> Items:
    out: Items = []
    for kind, data, _ in riff_chunks(body, b"WAVE"):
        if kind == b"LIST" and data[:4] == b"INFO":
            at = 4
            while at + 8 <= len(data):
                n = int.from_bytes(data[at + 4 : at + 8], "little")
                key = data[at : at + 4].decode("latin-1")
                out.append((f"[RiffInfo] {AUDIO_NAMES.get(key, key)}", data[at + 8 : at + 8 + n].split(b"\0")[0].decode("utf-8", "replace")))
                at += 8 + n + (n & 1)
        elif kind in (b"id3 ", b"ID3 ") and data[:3] == b"ID3":
            out += id3_items(data)
    return out


def _aiff_form(body: bytes) -> bytes:
    return body[8:12] if body[8:12] in (b"AIFF", b"AIFC") else b"AIFF"


def _aiff_items(body: bytes) -> Items:
    out: Items = []
    for kind, data, _ in riff_chunks(body, _aiff_form(body)):
        if kind in (b"NAME", b"AUTH", b"(c) ", b"ANNO"):
            out.append((f"[AiffText] {AUDIO_NAMES[kind.decode()]}", data.rstrip(b"\0").decode("utf-8", "replace")))
        elif kind == b"ID3 " and data[:3] == b"ID3":
            out += id3_items(data)
    return out


# ---- MP4 ----
def boxes(body: bytes, at: int, end: int):
    while at + 8 <= end:
        n, head = int.from_bytes(body[at : at + 4], "big"), 8
        if n == 1 and at + 16 <= end:
            n, head = int.from_bytes(body[at + 8 : at + 16], "big"), 16
        n = n or end - at
        if n < head or at + n > end:
            return
        yield body[at + 4 : at + 8], at, at + head, at + n
        at += n


def mp4_items(body: bytes, prefix: str = "[Mp4Ilst] ") -> Items:
    out: Items = []
    pictures = 0

    def walk(at: int, end: int, path: tuple) -> None:
        nonlocal pictures
        for kind, _, start, stop in boxes(body, at, end):
            if kind in (b"moov", b"udta", b"trak"):
                walk(start, stop, (*path, kind))
            elif kind == b"meta":
                walk(start + (0 if body[start + 4 : start + 8] in (b"hdlr", b"ilst") else 4), stop, (*path, kind))
            elif kind == b"ilst":
                for key, _, s, e in boxes(body, start, stop):
                    name = key.decode("latin-1")
                    for sub, _, a, b in boxes(body, s, e):
                        if sub == b"data":
                            flag, data = int.from_bytes(body[a : a + 4], "big"), body[a + 8 : b]
                            if key == b"covr":
                                pictures += 1
                                out.extend(_picture(prefix.strip("[] "), pictures, 3, data))
                            else:
                                out.append((prefix + AUDIO_NAMES.get(name, name), data.decode("utf-8", "replace") if flag == 1 else "(binary data)"))
            elif path[-1:] == (b"udta",) and kind[:1] == b"\xa9" and stop - start > 4:
                n = int.from_bytes(body[start : start + 2], "big")
                out.append((prefix + AUDIO_NAMES.get(kind.decode("latin-1"), kind.decode("latin-1")), body[start + 4 : start + 4 + n].decode("utf-8", "replace")))

    walk(0, len(body), ())
    return out


def blank_mp4(body: bytes) -> bytes:
    """User data boxes become free space of the same size, so that no offset moves; times in headers become 0."""
    out = bytearray(body)

    def walk(at: int, end: int) -> None:
        for kind, head, start, stop in boxes(body, at, end):
            if kind in (b"udta", b"uuid") or kind == b"meta":
                out[head + 4 : head + 8] = b"free"
                out[start:stop] = b"\0" * (stop - start)
            elif kind in (b"moov", b"trak", b"mdia", b"moof"):
                walk(start, stop)
            elif kind in (b"mvhd", b"tkhd", b"mdhd") and stop - start >= 20:
                n = 16 if body[start] else 8
                out[start + 4 : start + 4 + n] = b"\0" * n

    walk(0, len(body))
    return bytes(out)


def _kind(body: bytes, mime: str) -> str:
    start = id3_span(body)
    if body[start : start + 4] == b"fLaC":
        return "flac"
    for mark, kind in ((b"OggS", "ogg"), (b"RIFF", "wav"), (b"FORM", "aiff")):
        if body[:4] == mark:
            return kind
    if body[4:8] == b"ftyp":
        return "mp4"
    if start or len(body) > 2 and body[0] == 0xFF and body[1] & 0xE0 == 0xE0:
        return "mpeg"
    raise FormatError(f"no known audio signature ({mime})")


def read_audio(body: bytes, mime: str = "", **_: object) -> Items:
    kind = _kind(body, mime)
    if kind == "flac":
        out: Items = id3_items(body) if body[:3] == b"ID3" else []
        pictures = 0
        for k, data in _flac(body)[0]:
            if k == 4:
                out += comment_items(data, "VorbisComments")
            elif k == 6:
                pictures += 1
                out += _flac_picture("VorbisComments", pictures, data)
        return out
    if kind == "ogg":
        found = _ogg_comment(body)
        return comment_items(found[1][len(found[0]) :], "VorbisComments") if found else []
    if kind == "mpeg":
        return (id3_items(body) if body[:3] == b"ID3" else []) + id3v1_items(body)
    return {"wav": _wav_items, "aiff": _aiff_items, "mp4": mp4_items}[kind](body)


def clean_audio(body: bytes, mime: str = "", options: Options = Options(), **_: object) -> bytes:
    kind = _kind(body, mime)
    if kind == "wav":
        return build_riff(b"RIFF", b"WAVE", [raw for k, d, raw in riff_chunks(body, b"WAVE") if k not in (b"id3 ", b"ID3 ", b"bext", b"iXML", b"_PMX") and not (k == b"LIST" and d[:4] == b"INFO")])
    if kind == "aiff":
        form = _aiff_form(body)
        return build_riff(b"FORM", form, [raw for k, _, raw in riff_chunks(body, form) if k not in (b"NAME", b"AUTH", b"(c) ", b"ANNO", b"ID3 ", b"COMT", b"APPL")])
    return {"flac": _clean_flac, "ogg": _clean_ogg, "mpeg": _strip_mpeg, "mp4": blank_mp4}[kind](body)
