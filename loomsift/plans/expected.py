"""What the sample files hold and what cleaning leaves of them, written down as literal rows."""

from __future__ import annotations

_TAR = "mtime=1700000000, uid=1000, uname=al"
CONTAINER_ITEMS = [
    ("a.zip", "p/page.html/p_page.html", 0, "title", "T"),
    ("a.zip", "a.zip", 0, "zip member: p/page.html", "mtime 2024-05-06"), ("a.zip", "a.zip", 1, "zip member: note.txt", "mtime 2024-05-06"), ("a.zip", "a.zip", 2, "zip member: blob.bin", "mtime 2024-05-06"),
    ("a.tar", "a.tar", 0, "tar member: p/page.html", _TAR), ("a.tar", "a.tar", 1, "tar member: note.txt", _TAR),
    ("a.tar.gz", "a.tar.gz", 0, "tar member: note.txt", _TAR), ("a.tar.bz2", "a.tar.bz2", 0, "tar member: note.txt", _TAR), ("a.tar.xz", "a.tar.xz", 0, "tar member: note.txt", _TAR),
    ("nest.zip", "nest.zip", 0, "zip member: in.tar", "mtime 2024-05-06"),
    ("a.docx", "a.docx/docProps/core.xml", 0, "creator", "Al"), ("a.docx", "a.docx/docProps/core.xml", 1, "lastModifiedBy", "Bo"), ("a.docx", "a.docx/[archive]", 0, "Revision fingerprints", "rsid / tracked changes present"),
    ("a.odt", "a.odt/meta.xml", 0, "initial-creator", "Al"), ("a.odt", "a.odt/[archive]", 0, "Embedded images", "1 file(s) may contain EXIF/GPS"),
    ("a.epub", "a.epub/OEBPS/content.opf", 0, "creator", "Al"),
]
PDF_ITEMS = [("a.pdf", "a.pdf", 0, "Author", "Al"), ("a.pdf", "a.pdf", 1, "Title", "A"), ("a.pdf", "a.pdf", 2, "Annotations", "1 of 1 pages")]
PDF_OBJECTS = [(0, "<</Type /Catalog /Pages 2 0 R>>"), (1, "<</Type /Pages /Kids [3 0 R] /Count 1>>"), (2, "<</Type /Page /Parent 2 0 R /MediaBox [0 0 9 9]>>")]
AUDIO_ITEMS = [
    ("a.mp3", "a.mp3", 0, "[Id3v2] Artist", "Al"), ("a.mp3", "a.mp3", 1, "[Id3v2] Title", "Song"), ("a.flac", "a.flac", 0, "[VorbisComments] Title", "ab"), ("a.wav", "a.wav", 0, "[RiffInfo] Artist", "Al"),
]
_MP3 = (b"\xff\xfb" + b"x" * 40).hex()
AUDIO_CLEAN = [
    ("a.mp3", _MP3, False), ("none.mp3", _MP3, False),
    # the comment block stays, with an empty vendor and no comments
    ("a.flac", (b"fLaC\x00\x00\x00\x04abcd" + b"\x84\x00\x00\x08" + b"\x00" * 8 + b"frames").hex(), False),
    ("a.wav", (b"RIFF\x28\x00\x00\x00WAVE" + b"fmt \x10\x00\x00\x00\x01\x00" + b"\x00" * 14 + b"data\x04\x00\x00\x00pcm!").hex(), False),
]
_EXIF = [("ImageDescription", "sunset at the pier"), ("Orientation", "6"), ("Artist", "Al")]
IMAGE_ITEMS = [(f, f, i, k, v) for f in ("a.jpg", "a.tiff", "b.tiff", "a.webp") for i, (k, v) in enumerate(_EXIF)] + [(f, f, 3, "XMP dc:creator", "Al") for f in ("a.jpg", "a.webp")]
IMAGE_CLEAN = [
    ("a.jpg", (b"\xff\xd8\xff\xe0\x00\x07JFIF\x00\xff\xda\x00\x02xx\xff\xd9").hex(), False),
    # a directory without entries, and zeros where the three entries and the description were
    ("a.tiff", (b"II*\x00\x08\x00\x00\x00" + b"\x00" * (2 + 36 + 4 + 19)).hex(), False), ("b.tiff", (b"MM\x00*\x00\x00\x00\x08" + b"\x00" * (2 + 36 + 4 + 19)).hex(), False),
    ("a.webp", (b"RIFF\x24\x00\x00\x00WEBP" + b"VP8X\x0a\x00\x00\x00" + b"\x00" * 10 + b"VP8 \x06\x00\x00\x00pixels").hex(), False),
    ("broken.webp", None, True),
]
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_DC = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
OFFICE_PARTS = [
    ("a.docx", 0, "[Content_Types].xml", "1980 0", '<Types xmlns="t"><Override PartName="/word/document.xml"/></Types>'),
    ("a.docx", 1, "docProps/core.xml", "1980 0", _XML + '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"/>'),
    ("a.docx", 2, "word/_rels/document.xml.rels", "1980 0", '<Relationships xmlns="r"><Relationship Id="r2" Target="document.xml"/></Relationships>'),
    ("a.docx", 3, "word/document.xml", "1980 0", '<w:document xmlns:w="w"><w:p><w:t>kept</w:t></w:p></w:document>'),
    ("a.odt", 0, "mimetype", "1980 0", "application/vnd.oasis.opendocument.text"),
    ("a.odt", 1, "content.xml", "1980 0", "<office:document-content xmlns:office='o' xmlns:text='t'><text:p>hi</text:p></office:document-content>"),
    ("a.epub", 0, "mimetype", "1980 0", "application/epub+zip"),
    ("a.epub", 1, "OEBPS/a.xhtml", "1980 0", "<html><head><title/></head><body>hi</body></html>"),
    ("a.epub", 2, "OEBPS/content.opf", "1980 0", f'<package xmlns="p" unique-identifier="uid"><metadata xmlns:dc="d"><dc:identifier {_DC} id="uid">urn:uuid:UUID</dc:identifier><dc:language {_DC}/><dc:title {_DC}/></metadata><manifest/></package>'),
]
_PAGE = "<title></title><p>hi</p>"
ARCHIVE_PARTS = [
    ("a.zip", 0, "blob.bin", "1980 0", "\0"), ("a.zip", 1, "note.txt", "1980 0", "hello"), ("a.zip", 2, "p/page.html", "1980 0", _PAGE), ("a.tar", 0, "note.txt", "0 0  644", "hello"), ("a.tar", 1, "p/page.html", "0 0  644", _PAGE),
    *[(f, 0, "note.txt", "0 0  644", "hello") for f in ("a.tar.gz", "a.tar.bz2", "a.tar.xz")],
]
REFUSED = [("up.tar", "ParseError"), ("up.zip", "CleanError"), ("bad.zip", "ParseError"), ("plain.gz", "UnsupportedFormat"), ("a.bin", "UnsupportedFormat")]
MEMBERS = [
    ("a.zip", 0, "p/page.html", "regular", 0, 37, None), ("a.zip", 1, "note.txt", "regular", 0, 5, None), ("a.zip", 2, "blob.bin", "regular", 0, 1, None),
    ("a.tar", 0, "p/page.html", "regular", 1700000000, 37, None), ("a.tar", 1, "note.txt", "regular", 1700000000, 5, None),
    *[(f, 0, "note.txt", "regular", 1700000000, 5, None) for f in ("a.tar.gz", "a.tar.bz2", "a.tar.xz")],
    ("up.tar", None, None, None, None, None, "ParseError"), ("up.zip", None, None, None, None, None, "ParseError"), ("bad.zip", None, None, None, None, None, "ParseError"),
    ("nest.zip", 0, "in.tar", "regular", 0, 10240, None), ("plain.gz", None, None, None, None, None, "UnsupportedFormat"),
]
VIDEO_ITEMS = [("a.mp4", "a.mp4", 0, "Title", "Pier"), ("a.mkv", "a.mkv", 0, "title", "Pier"), ("a.mkv", "a.mkv", 1, "ARTIST", "Al"), ("a.avi", "a.avi", 0, "INAM", "Pier")]
_MP4_TAGS = 8 + 4 + 8 + 8 + 16 + 4  # meta, its flags, ilst, name, data and its flags, text
VIDEO_CLEAN = [
    # sizes stay: the user data is free space, the times in the header are zero
    ("a.mp4", (b"\0\0\0\x0cftypisom" + (8 + 28 + 8 + _MP4_TAGS).to_bytes(4, "big") + b"moov\0\0\0\x1cmvhd" + b"\0" * 20 + (8 + _MP4_TAGS).to_bytes(4, "big") + b"free" + b"\0" * _MP4_TAGS + b"\0\0\0\x0emdatframes").hex(), False),
    # the tags, 25 bytes, are a void element of 16 behind its header; the title is blank
    ("a.mkv", (b"\x1aE\xdf\xa3\x80\x18S\x80g\xb0\x15I\xa9f\x87{\xa9\x84    \xec\x01\0\0\0\0\0\0\x10" + b"\0" * 16 + b"\x1fC\xb6u\x86frames").hex(), False),
    ("a.avi", (b"RIFF\x2a\0\0\0AVI JUNK\x10\0\0\0" + b"\0" * 16 + b"movi\x06\0\0\0frames").hex(), False),
]
PLAIN_CLEAN = [("a.txt", b"# kept".hex(), False), ("a.bmp", b"BMxx".hex(), False), ("a.ppm", b"P6\n\n1 1\n255\n#ab".hex(), False), ("b.pbm", b"P1 \n1 1\n1".hex(), False)]
PLAIN_ITEMS = [("a.ppm", "a.ppm", 0, "comment line 1", "# by Al"), ("a.ppm", "a.ppm", 1, "comment line 2", "#ab")]
