"""Small container files, built when asked for."""

from __future__ import annotations

import io
import tarfile
import zipfile

from ..formats.registry import mime_of


def zip_bytes(parts: list[tuple[str, bytes]], date: tuple = (2024, 5, 6, 7, 8, 10)) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name, date), data)
    return buf.getvalue()


def tar_bytes(parts: list[tuple[str, bytes]], mode: str = "w") -> bytes:
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode=mode) as t:
        for name, data in parts:
            info = tarfile.TarInfo(name)
            info.size, info.uid, info.mtime, info.uname = len(data), 1000, 1_700_000_000, "al"
            t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def docx() -> bytes:
    types = b'<Types xmlns="t"><Override PartName="/word/document.xml"/><Override PartName="/word/comments.xml"/></Types>'
    doc = b'<w:document xmlns:w="w"><w:p w:rsidR="00A1"><w:ins w:author="Al"><w:t>kept</w:t></w:ins><w:del w:author="Al"><w:t>gone</w:t></w:del></w:p></w:document>'
    core = b'<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Al</dc:creator><cp:lastModifiedBy>Bo</cp:lastModifiedBy></cp:coreProperties>'
    rels = b'<Relationships xmlns="r"><Relationship Id="r1" Target="comments.xml"/><Relationship Id="r2" Target="document.xml"/></Relationships>'
    return zip_bytes([("[Content_Types].xml", types), ("word/document.xml", doc), ("word/comments.xml", b"<c/>"), ("word/_rels/document.xml.rels", rels), ("docProps/core.xml", core)])


def odt() -> bytes:
    kind = b"application/vnd.oasis.opendocument.text"
    meta = b"<office:document-meta xmlns:office='o' xmlns:meta='m' xmlns:dc='d'><office:meta><meta:initial-creator>Al</meta:initial-creator></office:meta></office:document-meta>"
    content = b"<office:document-content xmlns:office='o' xmlns:text='t'><text:tracked-changes><text:x/></text:tracked-changes><text:p>hi</text:p></office:document-content>"
    return zip_bytes([("mimetype", kind), ("meta.xml", meta), ("content.xml", content), ("Thumbnails/thumbnail.png", b"x")])


def epub() -> bytes:
    opf = b'<package xmlns="p" unique-identifier="uid"><metadata xmlns:dc="d"><dc:creator>Al</dc:creator></metadata><manifest/></package>'
    return zip_bytes([("mimetype", b"application/epub+zip"), ("OEBPS/content.opf", opf), ("OEBPS/a.xhtml", b"<html><head><meta name='x'/></head><body>hi</body></html>"), ("iTunesMetadata.plist", b"x")])


def pdf() -> bytes:
    return (
        b"%PDF-1.4\n1 0 obj\n<</Type /Catalog /Pages 2 0 R /Lang (en)>>\nendobj\n2 0 obj\n<</Type /Pages /Kids [3 0 R] /Count 1>>\nendobj\n3 0 obj\n<</Type /Page /Parent 2 0 R /Annots [] /MediaBox [0 0 9 9]>>\nendobj\n"
        b"4 0 obj\n<</Author (Al) /Title <FEFF0041>>>\nendobj\ntrailer\n<</Root 1 0 R /Info 4 0 R>>\n%%EOF\n"
    )


def flac() -> bytes:
    comment = (3).to_bytes(4, "little") + b"ven" + (1).to_bytes(4, "little") + (8).to_bytes(4, "little") + b"TITLE=ab"
    return b"fLaC\x00\x00\x00\x04abcd\x84" + len(comment).to_bytes(3, "big") + comment + b"frames"


def mp3() -> bytes:
    return b"ID3\x03\x00\x00\x00\x00\x00\x0eTIT2\x00\x00\x00\x04\x00\x00\x00abc" + b"\xff\xfb" + b"x" * 40


def CONTAINERS() -> list[tuple[str, str, bytes]]:
    note = ("note.txt", b"hello")
    page = ("p/page.html", b"<title>T</title><p onclick=x()>hi</p>")
    files = [
        ("a.zip", zip_bytes([page, note, ("blob.bin", b"\x00")])), ("a.tar", tar_bytes([page, note])), ("a.tar.gz", tar_bytes([note], "w:gz")), ("a.tar.bz2", tar_bytes([note], "w:bz2")),
        ("a.tar.xz", tar_bytes([note], "w:xz")), ("up.tar", tar_bytes([("../up", b"x")])), ("up.zip", zip_bytes([("a/../b", b"x")])), ("bad.zip", b"no zip"), ("nest.zip", zip_bytes([("in.tar", tar_bytes([note]))])),
        ("a.docx", docx()), ("a.odt", odt()), ("a.epub", epub()), ("a.pdf", pdf()), ("a.flac", flac()), ("a.mp3", mp3()), ("plain.gz", b"x"), ("a.bin", b"x"),
    ]
    return [(n, mime_of(n), b) for n, b in files]


def exif(order: str = "<") -> bytes:
    """A TIFF directory with an artist, a description and an orientation."""
    import struct

    said = b"sunset at the pier\0"
    mark = b"II*\0" if order == "<" else b"MM\0*"
    rows = [(0x010E, 2, len(said), None), (0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x013B, 2, 3, b"Al\0\0")]
    end = 8 + 2 + 12 * len(rows) + 4
    body = mark + struct.pack(order + "IH", 8, len(rows))
    for tag, kind, n, value in rows:
        body += struct.pack(order + "HHI", tag, kind, n) + (value if value is not None else struct.pack(order + "I", end))
    return body + b"\0\0\0\0" + said


def _riff(kind: bytes, chunks: list[tuple[bytes, bytes]]) -> bytes:
    inner = kind + b"".join(k + len(d).to_bytes(4, "little") + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + len(inner).to_bytes(4, "little") + inner


def _segment(kind: int, data: bytes) -> bytes:
    return b"\xff" + bytes([kind]) + (len(data) + 2).to_bytes(2, "big") + data


XMP = b"<x:xmpmeta><dc:creator>Al</dc:creator></x:xmpmeta>"


def IMAGES() -> list[tuple[str, bytes]]:
    jpeg = b"\xff\xd8" + _segment(0xE0, b"JFIF\0") + _segment(0xE1, b"Exif\0\0" + exif()) + _segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP) + _segment(0xFE, b"hey") + b"\xff\xda\x00\x02xx\xff\xd9"
    webp = _riff(b"WEBP", [(b"VP8X", b"\x2c\0\0\0" + b"\0" * 6), (b"VP8 ", b"pixels"), (b"EXIF", exif(">")), (b"XMP ", XMP)])
    return [("a.jpg", jpeg), ("a.tiff", exif()), ("b.tiff", exif(">")), ("a.webp", webp), ("broken.webp", b"RIFF\x04\0\0\0WEBX")]


def _id3(frames: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join(k + len(d).to_bytes(4, "big") + b"\0\0" + d for k, d in frames)
    return b"ID3\x03\0\0" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body


def SOUNDS() -> list[tuple[str, bytes]]:
    frames = b"\xff\xfb" + b"x" * 40
    wav = _riff(b"WAVE", [(b"fmt ", b"\x01\0" + b"\0" * 14), (b"LIST", b"INFO" + b"IART" + (2).to_bytes(4, "little") + b"Al"), (b"data", b"pcm!")])
    return [("a.mp3", _id3([(b"TPE1", b"\0Al"), (b"TIT2", b"\0Song")]) + frames), ("a.flac", flac()), ("a.wav", wav), ("none.mp3", frames)]


def _box(kind: bytes, *inner: bytes) -> bytes:
    body = b"".join(inner)
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def _element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + bytes([0x80 | len(data)]) + data


def VIDEOS() -> list[tuple[str, bytes]]:
    said = _box(b"ilst", _box(b"\xa9nam", _box(b"data", b"\0\0\0\x01\0\0\0\0", b"Pier")))
    header = b"\0\0\0\0" + b"\x11" * 8 + b"\0" * 8
    mp4 = _box(b"ftyp", b"isom") + _box(b"moov", _box(b"mvhd", header), _box(b"udta", _box(b"meta", b"\0\0\0\0", said))) + _box(b"mdat", b"frames")
    tag = _element(0x67C8, _element(0x45A3, b"ARTIST") + _element(0x4487, b"Al"))
    mkv = _element(0x1A45DFA3, b"") + _element(0x18538067, _element(0x1549A966, _element(0x7BA9, b"Pier")) + _element(0x1254C367, _element(0x7373, tag)) + _element(0x1F43B675, b"frames"))
    info = b"INFO" + b"INAM" + (4).to_bytes(4, "little") + b"Pier"
    avi = _riff(b"AVI ", [(b"LIST", info), (b"movi", b"frames")])
    return [("a.mp4", mp4), ("a.mkv", mkv), ("a.avi", avi)]


def PLAIN() -> list[tuple[str, bytes]]:
    return [("a.txt", b"# kept"), ("a.bmp", b"BMxx"), ("a.ppm", b"P6\n# by Al\n1 1\n255\n#ab"), ("b.pbm", b"P1 # one\n1 1\n1")]
