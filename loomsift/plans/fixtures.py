"""Literal rows for queries whose inputs no table holds; Spark and SQL get the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, bytes):
        return f"from_hex('{v.hex()}')"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


class Literal:
    """A small table: ``schema`` as DDL, usable from Spark and as a SQL common table expression."""

    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def cte(self) -> str:
        cols = [c.strip().split(" ") for c in self.schema.split(",")]
        kinds = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "binary": "BLOB", "boolean": "BOOLEAN"}
        rows = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in self.rows)
        picks = ", ".join(f"CAST({c} AS {kinds[t]}) AS {c}" for c, t in cols)
        return f"{self.name} AS (SELECT {picks} FROM (VALUES {rows}) v({', '.join(c for c, _ in cols)}))"


NAMES = Literal("lit_names", "name string", [(x,) for x in [
    "a.tar.gz", "a.tgz", "A.TBZ2", "a.tbz", "a.txz", "a.tar.zst", "a.tzst", "a.tar", "a.zip", "a.gz", "a.bz2", "a.xz", "a.zst", "a.txt", "photo.JPG", "x.jpeg", "deck.pptx", "song.opus", "song.m4a",
    "clip.mkv", "noext", ".hidden", "dir.d/file", "v.svg", "p.ppm", "m.torrent", "b.epub", "page.XHTML", "..file", "a/../b", "a\\..\\b", "/abs", "w.wmv",
]])
BYTES = Literal("lit_bytes", "n long", [(x,) for x in (0, 1, 999, 1023, 1024, 2047, 1048575, 1048576, 1572864, 1073741823, 1073741824, 10737418240, 11811160064)])
PATHS = Literal("lit_paths", "path string, home string", [
    ("/home/al/docs/a.txt", "/home/al"), ("/home/al/a.txt", "/home/al"), ("/home/alice/a.txt", "/home/al"), ("/srv/x/y.png", "/home/al"), ("plain.txt", "/home/al"),
])
RELS = Literal("lit_rels", "file_id long, rels_path string, target string, mode string", [
    (1, "word/_rels/document.xml.rels", "media/a.png", None), (1, "word/_rels/document.xml.rels", "comments.xml", None), (1, "word/_rels/document.xml.rels", "/docProps/core.xml", None),
    (1, "word/_rels/document.xml.rels", "../customXml/item1.xml", None), (1, "word/_rels/document.xml.rels", "http://x.example/", "External"), (1, "_rels/.rels", "word/./x/../document.xml", "Internal"),
    (1, "_rels/.rels", None, None), (2, "_rels/.rels", "word/document.xml", None),
])
PARTS = Literal("lit_parts", "file_id long, name string", [(1, "word/media/a.png"), (1, "docProps/core.xml"), (1, "word/document.xml")])
TAR = Literal("lit_tar", "file_id long, ord long, name string, type string, mode int, uid long, gid long, mtime long, uname string, gname string, link_target string", [
    (1, 0, "ok.txt", "regular", 0o644, 0, 0, 0, "", "", None), (1, 1, "/etc/x", "regular", 0o644, 0, 0, 5, "", "", None), (1, 2, "a/../b", "regular", 0o644, 7, 8, 0, "al", "", None),
    (1, 3, "ok.txt", "regular", 0o644, 0, 0, 0, "", "staff", None), (1, 4, "su", "regular", 0o4755, 0, 0, 0, "", "", None), (1, 5, "sg", "regular", 0o2755, 0, 0, 0, "", "", None),
    (1, 6, "tty", "char", 0o644, 0, 0, 0, "", "", None), (1, 7, "disk", "block", 0o644, 0, 0, 0, "", "", None), (1, 8, "pipe", "fifo", 0o644, 0, 0, 0, "", "", None),
    (1, 9, "hard", "hardlink", 0o644, 0, 0, 0, "", "", "ok.txt"), (1, 10, "s1", "symlink", 0o777, 0, 0, 0, "", "", "/etc/passwd"), (1, 11, "s2", "symlink", 0o777, 0, 0, 0, "", "", "../up"),
    (1, 12, "s3", "symlink", 0o777, 0, 0, 0, "", "", "ok.txt"), (1, 13, "dir/", "dir", 0o755, 1000, 1000, 1700000000, "al", "al", None), (2, 0, "ok.txt", "regular", 0o644, 0, 0, 0, "", "", None),
])
ZIP = Literal("lit_zip", "file_id long, ord long, name string, unix_mode int, year int, month int, day int, comment string", [
    (1, 0, "clean.txt", 0o100644, 1980, 1, 1, ""), (1, 1, "new.txt", 0o100644, 2024, 3, 9, ""), (1, 2, "dos.txt", None, 1980, 1, 1, ""), (1, 3, "su", 0o104755, 1980, 1, 1, ""),
    (1, 4, "said", 0o100644, 1980, 1, 1, "by \"Al\" \\ me"), (1, 5, "all", 0o106755, 2020, 12, 31, "x"),
])
MEMBERS = Literal("lit_members", "file_id long, ord long, name string, size long", [
    (1, 0, "b.txt", 400), (1, 1, "mimetype", 20), (1, 2, "a.txt", 300), (1, 3, "b.txt", 9), (1, 4, "Z.txt", 500), (1, 5, "\u00e9.txt", 1), (2, 0, "only", 2000), (3, 0, "x", 999), (3, 1, "y", 1),
])
POLICY = Literal("lit_policy", "name string, policy string", [(n, p) for n in ("a.jpg", "b.weird", "c.zip", "d.tar.zst", "e.txt", "noext") for p in ("keep", "omit", "abort")])
EVENTS = Literal("lit_events", "seq long, file_id long, type string, state string, items long, message string", [
    (1, 1, "state", "CheckingMetadata", None, None), (2, 1, "ready", None, 3, None), (3, 2, "ready", None, 0, None), (4, 3, "error", "ErrorWhileCheckingMetadata", None, "bad file"),
    (5, 3, "ready", None, 2, None), (6, 9, "state", "Cleaned", None, None), (7, 1, "state", "RemovingMetadata", None, None), (8, 1, "state", "Cleaned", None, None), (9, 4, "error", "Unsupported", None, "no handler"),
])
KEYS = Literal("lit_keys", "key string", [(k,) for k in ("Author", "Image Width", "ICC Profile", "creator", "dc:title", "Encoder", "GPSLatitude", "Page Count", "vendor_id", "Comment", "Embedded images")])
PPM = Literal("lit_ppm", "id long, body string", [(1, "P6\n# made by me\n  # twice\n1 1\n255\n"), (2, "P4\n1 1\n"), (3, "# first\nP5 1 1 255\n")])
TAGS = Literal("lit_tags", "id long, line string", [(1, '  "title": "My: film",'), (2, '"a": ""'), (3, "nothing"), (4, '"encoder": "Lavf58"'), (5, '"": "x"')])

#: (id, source, expected items, expected cleaned source)
HTML = [
    (1, '<a href=/x onclick=e()>k</a>', [], "<a href=/x>k</a>"),
    (2, "<title>A < B</title>", [("title", "A < B")], "<title></title>"),
    (3, "x<script>var a;", [("<script>", "inline (6 bytes)")], "x"),
    (4, "<noscript><meta name=q content=1></noscript>y", [("<noscript>", "inline (0 bytes)"), ("q", "1")], "y"),
    (5, "<textarea><meta name=q></textarea>", [], "<textarea><meta name=q></textarea>"),
    (6, "<iframe src=a><iframe></iframe></iframe>z", [("<iframe>", "src=a"), ("<iframe>", "src=")], "z"),
    (7, "a</script>b", [], "ab"),
    (8, "a<!-- open", [], "a"),
    (9, "<SCRIPT>x</SCRIPT >b", [("<script>", "inline (1 bytes)")], "b"),
    (10, '<p title="a>b" ONCLICK="x()">t</p>', [], '<p title="a>b">t</p>'),
    (11, "<link rel=next href='n'><base href=b><embed src=e><object data=d></object>", [("<link>", "rel=next href=n"), ("<base>", "href=b"), ("<embed>", "src=e"), ("<object>", "data=d")], ""),
    (12, '<meta property="og:t" name="n" content="\u00e9"><style>\u00e9</style>', [("og:t", "\u00e9"), ("<style>", "inline (2 bytes)")], ""),
]
CSS = [
    (1, "/* author: Bob\n * version: 1.0\n */a{}", [("author", "Bob"), ("version", "1.0")], "a{}"),
    (2, "/* free form */b{}/**/", [("comment #1", "free form")], "b{}"),
    (3, 'a{content:"/* no */"}', [], 'a{content:"/* no */"}'),
    (4, "a{content:'\\'/*'}/* x */", [("comment #1", "x")], "a{content:'\\'/*'}"),
    (5, "a{}/* open", [], "a{}"),
]
SVG = [
    (1, '<svg xmlns:dc="d"><metadata><dc:x>me</dc:x></metadata><title>T</title><rect width="1"/></svg>', [("<metadata>", "me"), ("<title>", "T")], '<svg><rect width="1"/></svg>'),
    (2, '<svg inkscape:v="1" onload="x()"><a href=" JavaScript:x"/></svg>', [("<svg> inkscape:v", "1"), ("<svg> onload (event handler)", "x()"), ("<a> href (javascript: uri)", " JavaScript:x")], "<svg><a/></svg>"),
    (3, '<svg><!-- c --><g onion="k"><script>e()</script></g></svg>', [("<script>", "e()")], '<svg><g onion="k"></g></svg>'),
]
BENCODE = [
    (1, b"d8:announce1:u7:comment2:hi4:infod4:name1:nee", [("comment", "hi")], b"d8:announce1:u4:infod4:name1:nee"),
    (2, b"d1:ai5e1:bli1ei2ee1:cde1:d2:\xff\xfee", [("a", "5"), ("b", "[2 items]"), ("c", "{0 keys}"), ("d", "<2 bytes of binary data>")], b"de"),
    (3, b"i-0e", None, None), (4, b"di01ee", None, None), (5, b"d1:a1:bex", None, None), (6, b"li1ee", None, None), (7, b"", None, None), (8, b"l" * 257 + b"e" * 257, None, None),
]
XMP = [
    (1, b"<x:xmpmeta><dc:title>Hi</dc:title><foo:bar>no</foo:bar><pdf:Producer> P </pdf:Producer></x:xmpmeta>", [("XMP dc:title", "Hi"), ("XMP pdf:Producer", "P")]),
    (2, b"<dc:creator><rdf:Seq><rdf:li>Al</rdf:li></rdf:Seq></dc:creator>", []), (3, b"<!-- <dc:a>x</dc:a> --><dc:b>y</dc:b>", [("XMP dc:b", "y")]), (4, b"<dc:b>\xff</dc:b>", []), (5, b"<dc:b>y", []),
]
_IIM = b"\x1c\x02\x50\x00\x02Al\x1c\x02\x69\x00\x04Head\x1c\x01\x5a\x00\x03\x1b%G"
IPTC = [
    (1, b"Photoshop 3.0\x008BIM\x04\x04\x00\x00" + len(_IIM).to_bytes(4, "big") + _IIM, [("IPTC By-line", "Al"), ("IPTC Headline", "Head")]),
    (2, b"8BIM\x04\x04\x00\x00\x00\x00\xff\xff" + _IIM, []),
]
_GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\x00" * 6
_GIF_END = b"!\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
GIF = [
    (1, _GIF + b"!\xfe\x06secret\x00!\xff\x0bXMP DataXMP\x02ab\x01c\x00" + _GIF_END, [("Comment", "secret"), ("Application: XMP DataXMP", "2 sub-block(s), 3 bytes total")], _GIF + _GIF_END),
    (2, _GIF + b"!\xfe\x02hi\x00!\xfe\x09cut", [("Comment", "hi")], None),
]
_J = b"\xff\xd8\xff\xe0\x00\x04ab"
_JEND = b"\xff\xda\x00\x02xx\xff\xd9"
JPEG = [(1, _J + b"\xff\xe1\x00\x06Exif\xff\xfe\x00\x05hey" + _JEND, _J + _JEND), (2, _J + b"\xff\xed\x00\x03a" + b"\xff\xdb\x00\x03q" + _JEND, _J + b"\xff\xdb\x00\x03q" + _JEND), (3, b"\xff\xd8\xff\xe1\xff\xff", None)]


def _chunk(kind: bytes, data: bytes) -> bytes:
    import zlib

    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


_P = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", b"\x00\x00\x00\x01\x00\x00\x00\x01\x08\x00\x00\x00\x00")
_PEND = _chunk(b"IDAT", b"x\x9cc`\x00\x00\x00\x02\x00\x01") + _chunk(b"IEND", b"")
PNG = [(1, _P + _chunk(b"tEXt", b"Author\x00me") + _chunk(b"tIME", b"\x07\xe8\x01\x01\x00\x00\x00") + _PEND, _P + _PEND), (2, _P + _PEND, _P + _PEND), (3, _P, None)]
