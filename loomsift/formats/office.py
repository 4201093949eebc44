"""OOXML, ODF and EPUB packages."""

from __future__ import annotations

import hashlib
import posixpath
import re
import uuid

from ..options import Options
from .archive import build_zip, first_of_each, open_zip, read_member, traverses
from .errors import CleanError, FormatError, TooLarge, utf8
from .fixed import JUNK_BEGINNINGS, JUNK_ENDS, JUNK_PATHS, OFFICE_MEDIA, OFFICE_PARTS, OFFICE_STUBS, OFFICE_TEXTS, OFFICE_XML
from .xmltext import Node, edit_attrs, nodes, rewrite, sort_attributes, tag_texts

_TEXTS = frozenset(OFFICE_TEXTS)
_JUNK = frozenset(JUNK_PATHS)


def is_junk(name: str) -> bool:
    """A part that is left out: by its path, or a part of comments."""
    comments = re.search(r"(^|/)comments[^/]*\.xml(\.rels)?$", name) or "/threadedComments/" in name
    return name in _JUNK or name.startswith(tuple(JUNK_BEGINNINGS)) or name.endswith(tuple(JUNK_ENDS)) or bool(comments)


def media_type(name: str) -> str | None:
    return OFFICE_MEDIA.get(name.lower().rpartition(".")[2]) if "." in name else None


def is_xml(name: str) -> bool:
    return name.lower().endswith(tuple(OFFICE_XML))


def package_kind(z, o: Options) -> str:
    names = set(z.namelist())
    if "mimetype" in names:
        said = read_member(z, z.getinfo("mimetype"), o)[:256].decode("utf-8", "replace").strip()
        if said == "application/epub+zip":
            return "epub"
        if said.startswith("application/vnd.oasis.opendocument"):
            return "odf"
    return "ooxml" if "[Content_Types].xml" in names else "odf" if "content.xml" in names else "generic"


def read_office(body: bytes, name: str = "", options: Options = Options(), **_: object):
    z = open_zip(body)
    names = z.namelist()
    groups = []
    for part in OFFICE_PARTS:
        if part in names:
            try:
                items = tag_texts(utf8(read_member(z, z.getinfo(part), options)), _TEXTS)
            except TooLarge:
                raise
            except FormatError:
                continue
            if items:
                groups.append((f"{name}/{part}", items))
    media = sum(media_type(n) is not None for n in names)
    revisions = comments = 0
    for n in names:
        if n.endswith("word/document.xml"):
            with z.open(n) as f:
                sample = f.read(256 << 10).decode("utf-8", "replace")
            revisions += (":rsid" in sample) + ("w:del " in sample or "w:ins " in sample)
            comments += "commentReference" in sample or "commentRangeStart" in sample
    items = [("Embedded images", f"{media} file(s) may contain EXIF/GPS")] if media else []
    items += [("Revision fingerprints", "rsid / tracked changes present")] if revisions else []
    items += [("Comment references", "comment anchors present")] if comments else []
    return groups + ([(f"{name}/[archive]", items)] if items else [])


# ---- OOXML ----
def is_fingerprint(local: str) -> bool:
    return local.lower().startswith("rsid") or local.lower() == "nsid"


def _fresh(seed: bytes, salt: str, bits: int = 31) -> int:
    """A number that follows from the file's content: retries agree, files differ."""
    return int.from_bytes(hashlib.sha256(seed + salt.encode()).digest()[:8], "big") % (1 << bits)


def scrub_fingerprints(src: str, seed: bytes = b"") -> str:
    count = 0

    def change(n: Node) -> str:
        nonlocal count
        raw = edit_attrs(n.raw, lambda k, v: not is_fingerprint(k.split(":", 1)[-1]))
        if n.local == "creationId":
            count += 1
            raw = re.sub(r"(\bval\s*=\s*[\"'])[^\"']*", lambda m: f"{m[1]}{_fresh(seed, f'creationId{count}', 32)}", raw)
        return raw

    return rewrite(src, drop=lambda n: is_fingerprint(n.local), change=change)


def accept_revisions(src: str) -> str:
    return rewrite(src, drop=lambda n: n.local == "del", unwrap=lambda n: n.local == "ins")


def drop_comment_refs(src: str) -> str:
    return rewrite(src, drop=lambda n: n.local in ("commentRangeStart", "commentRangeEnd", "commentReference"))


def renumber_masters(src: str, seed: bytes) -> str:
    count = 0

    def change(n: Node) -> str:
        nonlocal count
        if n.local != "sldMasterId":
            return n.raw
        count += 1
        return re.sub(r"(\sid\s*=\s*[\"'])[^\"']*", lambda m: f"{m[1]}{(1 << 31) + _fresh(seed, f'master{count}', 30)}", n.raw)

    return rewrite(src, change=change)


def drop_ignorable(src: str) -> str:
    return re.sub(r' ?mc:Ignorable="[^"]*"', "", src)


def clean_ooxml_part(name: str, src: str, seed: bytes) -> str:
    src = scrub_fingerprints(src, seed)
    if name.endswith("word/document.xml"):
        src = drop_comment_refs(accept_revisions(src))
    if name.endswith("ppt/presentation.xml"):
        src = renumber_masters(src, seed)
    return drop_ignorable(sort_attributes(src))


def rels_base(rels: str) -> str:
    """The folder that relative targets of a .rels part start from."""
    folder = posixpath.dirname(posixpath.dirname(rels))
    return folder


def resolve(base: str, target: str) -> str:
    """A part name from a relationship's target; .. at the root stays there."""
    out: list[str] = []
    for part in (target if target.startswith("/") else f"{base}/{target}").split("/"):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def prune_types(src: str, kept: set[str]) -> str:
    def gone(n: Node) -> bool:
        part = dict(n.attrs()).get("PartName")
        return n.local == "Override" and part is not None and part.lstrip("/") not in kept

    return rewrite(src, drop=gone)


def prune_rels(name: str, src: str, kept: set[str]) -> str:
    base = rels_base(name)

    def gone(n: Node) -> bool:
        a = dict(n.attrs())
        return n.local == "Relationship" and a.get("TargetMode") != "External" and "Target" in a and resolve(base, a["Target"].split("#")[0]) not in kept

    return rewrite(src, drop=gone)


# ---- EPUB ----
def _uuid(seed: bytes, salt: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(seed + salt.encode()).digest()[:16], version=4)}"


def _replace_element(src: str, local: str, inside: str) -> tuple[str, int]:
    """The source with the content of each outermost element of that name replaced."""
    out, depth, found = [], 0, 0
    for n in nodes(src):
        if depth:
            depth += (n.kind == "open") - (n.kind == "close")
            if not depth:
                out.append(n.raw)
        elif n.kind == "open" and n.local == local:
            depth, found = 1, found + 1
            out += [n.raw, inside]
        elif n.kind == "empty" and n.local == local:
            found += 1
            out.append(f"{n.raw.rstrip()[:-2].rstrip()}>{inside}</{n.name}>" if inside else n.raw)
        else:
            out.append(n.raw)
    return "".join(out), found


def clean_opf(src: str, seed: bytes) -> str:
    ident = next((v for n in nodes(src) if n.local == "package" for k, v in n.attrs() if k == "unique-identifier"), "id")
    dc = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
    inside = f'<dc:identifier {dc} id="{ident}">{_uuid(seed, "opf")}</dc:identifier><dc:language {dc}/><dc:title {dc}/>'
    out, found = _replace_element(src, "metadata", inside)
    if not found:
        raise CleanError("the OPF has no metadata element")
    return out


def blank_head(src: str, title: bool) -> str:
    return _replace_element(src, "head", "<title/>" if title else "")[0]


def clean_office(body: bytes, name: str = "", options: Options = Options(), **_: object) -> bytes:
    from .registry import clean_body

    z = open_zip(body)
    kind = package_kind(z, options)
    infos = first_of_each(z)
    seed = hashlib.sha256(body).digest()
    if kind == "epub" and any(i.filename == "META-INF/encryption.xml" for i in infos):
        raise CleanError("an encrypted EPUB can't be cleaned")
    keep = [i for i in infos if not i.is_dir() and (i.filename == "mimetype" or not is_junk(i.filename))]
    kept = {i.filename for i in keep}
    out, total = [], 0
    for info in sorted(keep, key=lambda i: i.filename != "mimetype"):
        n = info.filename
        if traverses(n):
            raise CleanError(f"member leaves the package: {n}")
        data = read_member(z, info, options)
        total += len(data)
        if options.total_cap is not None and total > options.total_cap:
            raise TooLarge(f"members inflate to more than {options.total_cap} bytes")
        try:
            if n != "mimetype":
                data = _clean_part(kind, n, data, kept, seed, options, clean_body)
        except FormatError as e:
            raise CleanError(f"member {n}: {e}") from None
        out.append((n, data, 0 if n == "mimetype" else info.compress_type))
    return build_zip(out)


def _clean_part(kind: str, n: str, data: bytes, kept: set[str], seed: bytes, o: Options, clean_body) -> bytes:
    mime = media_type(n)
    if mime:
        return clean_body(data, n.rsplit("/", 1)[-1], mime, o)
    if kind == "ooxml" and n in OFFICE_STUBS:
        return OFFICE_STUBS[n].encode()
    if not is_xml(n):
        return data
    src = utf8(data)
    if kind == "ooxml":
        if n == "[Content_Types].xml":
            return sort_attributes(prune_types(src, kept)).encode()
        if n.endswith(".rels"):
            return sort_attributes(prune_rels(n, src, kept)).encode()
        return clean_ooxml_part(n, src, seed).encode()
    if kind == "odf":
        if n.endswith("content.xml"):
            src = rewrite(src, drop=lambda x: x.local == "tracked-changes")
        if n == "META-INF/manifest.xml":
            src = rewrite(src, drop=lambda x: x.local == "file-entry" and is_junk(dict(x.attrs()).get("manifest:full-path", "")))
        return sort_attributes(src).encode()
    if kind == "epub":
        lower = n.lower()
        if lower.endswith(".opf"):
            return clean_opf(src, seed).encode()
        if lower.endswith(".ncx"):
            return blank_head(src, False).encode()
        if n.startswith(("OPS/", "OEBPS/")) and lower.endswith((".xhtml", ".xml")):
            return blank_head(src, True).encode()
    return data
