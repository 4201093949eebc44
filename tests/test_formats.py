"""Readers and cleaners without Spark: fixtures, invariants, garbage, properties."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsift.formats import office, pdf, raster, svg, torrent, web
from loomsift.formats.archive import probe, traverses, unsafe
from loomsift.formats.errors import FormatError
from loomsift.formats.registry import HANDLERS, SUPPORTED, clean_body, handler_of, mime_of, read_groups, safely
from loomsift.options import Options
from loomsift.plans import fixtures as X
from loomsift.plans.samples import CONTAINERS, docx, epub, odt, pdf as sample_pdf, tar_bytes, zip_bytes

O = Options()


@pytest.mark.parametrize("rows,read,clean", [(X.HTML, web.read_html, web.clean_html), (X.CSS, web.read_css, web.clean_css), (X.SVG, svg.read_svg, svg.clean_svg)])
def test_text_fixtures(rows, read, clean):
    for _, src, items, cleaned in rows:
        assert read(src.encode()) == items
        assert clean(src.encode()).decode() == cleaned
        assert clean(cleaned.encode()).decode() == cleaned


def test_every_extension_routes():
    for e in SUPPORTED:
        assert handler_of(mime_of(f"a.{e}")), e
    assert mime_of("noext") == mime_of(".hidden") == "application/octet-stream"
    assert sum(map(len, HANDLERS.values())) == 63


@pytest.mark.parametrize("body", [b"", b"x", b"garbage " * 20, b"\0" * 1024, b"\xff" * 1024])
def test_no_handler_panics(body):
    for h, mimes in HANDLERS.items():
        name = "a.zip" if h == "archive" else f"a.{h}"
        for f in (read_groups, clean_body):
            assert safely(f, body, name, mimes[0], O)[1] != "HandlerPanicked", h


def test_containers_are_deterministic_and_idempotent():
    for name, mime, body in CONTAINERS():
        once, bad, _ = safely(clean_body, body, name, mime, O)
        if bad:
            continue
        assert clean_body(body, name, mime, O) == once
        if not name.endswith("epub"):  # its new identifier follows from the body
            assert clean_body(once, name, mime, O) == once, name


def test_docx():
    z = zipfile.ZipFile(io.BytesIO(office.clean_office(docx(), name="a.docx")))
    doc = z.read("word/document.xml").decode()
    assert "kept" in doc and "gone" not in doc and "rsid" not in doc and "w:ins" not in doc
    assert "word/comments.xml" not in z.namelist() and b"comments" not in z.read("[Content_Types].xml") + z.read("word/_rels/document.xml.rels")
    assert b"Al" not in z.read("docProps/core.xml")
    assert all(i.date_time[0] == 1980 for i in z.infolist())


def test_odt_and_epub():
    z = zipfile.ZipFile(io.BytesIO(office.clean_office(odt(), name="a.odt")))
    assert z.namelist() == ["mimetype", "content.xml"] and b"tracked" not in z.read("content.xml")
    z = zipfile.ZipFile(io.BytesIO(office.clean_office(epub(), name="a.epub")))
    assert b"urn:uuid:" in z.read("OEBPS/content.opf") and b"Al" not in z.read("OEBPS/content.opf") and b"meta" not in z.read("OEBPS/a.xhtml")
    locked = zip_bytes([("mimetype", b"application/epub+zip"), ("META-INF/encryption.xml", b"<x/>")])
    with pytest.raises(FormatError):
        office.clean_office(locked, name="a.epub")


def test_pdf():
    assert pdf.read_pdf(sample_pdf()) == [("Author", "Al"), ("Title", "A"), ("Annotations", "1 of 1 pages")]
    assert pdf.read_pdf(pdf.clean_pdf(sample_pdf())) == []


def test_archive_names_and_policies():
    assert [probe(n) for n in ("a.TAR.gz", "a.tzst", "a.zip")] == ["tar.gz", "tar.zst", "zip"]
    for n in ("a.gz", "a.rar"):
        with pytest.raises(FormatError):
            probe(n)
    assert traverses("a\\..\\b") and not traverses("..file")
    assert unsafe("a", "symlink", 0o777, "/etc", False).startswith("symlink escape") and unsafe("a", "regular", 0o644, None, False) is None
    body = zip_bytes([("x.weird", b"1"), ("a.txt", b"t")])
    assert zipfile.ZipFile(io.BytesIO(clean_body(body, "a.zip", "application/zip", Options(unknown="omit")))).namelist() == ["a.txt"]
    with pytest.raises(FormatError):
        clean_body(body, "a.zip", "application/zip", Options(unknown="abort"))


def test_caps():
    body = zip_bytes([("a.txt", b"x" * 100), ("b.txt", b"y" * 100)])
    for o in (Options(member_cap=50), Options(total_cap=150), Options(input_cap=10)):
        assert safely(clean_body, body, "a.zip", "application/zip", o)[1] == "FileTooLarge"
    assert safely(clean_body, tar_bytes([("a.txt", b"x" * 9000)]), "a.tar", "application/x-tar", Options(stream_cap=100))[1] == "FileTooLarge"
    assert safely(clean_body, body, "a.zip", "application/zip", Options(member_cap=50).unlimited())[1] is None


def test_gif_reads_what_is_there_and_cleans_whole_files_only():
    for _, body, items, cleaned in X.GIF:
        assert raster.read_gif(body) == items
        if cleaned is None:
            with pytest.raises(FormatError):
                raster.clean_gif(body)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-= \"'abonTITLEscript\n"), max_size=80))
def test_html_tokens_add_up(src):
    assert "".join(t.raw for t in web.tokens(src)) == src
    once = web.clean_html_text(src)
    web.html_items(src)
    assert web.clean_html_text(once) is not None


_BEN = st.recursive(st.integers(-(2**63), 2**63 - 1) | st.binary(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.binary(max_size=4), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(_BEN)
def test_bencode_round_trip(v):
    assert torrent.decode(torrent.encode(v)) == v


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_bencode_never_crashes(b):
    try:
        torrent.decode(b)
    except FormatError:
        pass


def test_packets_that_hold_nothing_readable_are_named():
    from loomsift.formats.raster import read_image

    def segment(kind, data):
        return b"\xff" + bytes([kind]) + (len(data) + 2).to_bytes(2, "big") + data

    body = b"\xff\xd8" + segment(0xED, b"Photoshop 3.0\0") + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>") + segment(0xE2, b"ICC_PROFILE\0x") + segment(0xE2, b"ICC_PROFILE\0y") + b"\xff\xd9"
    assert read_image(body) == [("IPTC/Photoshop data", "present"), ("XMP data", "present"), ("ICC Profile", "present")]


def test_pictures_carry_the_tag_they_are_in():
    from loomsift.formats.audio import read_audio

    picture = (3).to_bytes(4, "big") + (0).to_bytes(4, "big") * 2 + b"\0" * 16 + (5).to_bytes(4, "big") + b"bytes"
    body = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + b"\0" * 34 + b"\x86" + len(picture).to_bytes(3, "big") + picture
    assert read_audio(body, name="a.flac") == [("[VorbisComments] Picture #1", "CoverFront, 5 bytes")]
