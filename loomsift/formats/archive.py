"""ZIP and (compressed) TAR: members, safety, policies, rebuilding."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import stat
import tarfile
import zipfile
from dataclasses import dataclass

from ..options import Options
from .errors import CleanError, FormatError, TooLarge, Unsupported
from .fixed import ARCHIVE_SUFFIXES, HANDLERS, PLAIN_SUFFIXES

Groups = list[tuple[str, list[tuple[str, str]]]]

NESTED = frozenset(HANDLERS["archive"])


def probe(name: str) -> str:
    """The archive format of a file name; raises for plain compressed files and unknown suffixes."""
    lower = name.lower()
    for suffix in sorted(ARCHIVE_SUFFIXES, key=len, reverse=True):
        if lower.endswith(suffix):
            return ARCHIVE_SUFFIXES[suffix]
    for suffix, kind in PLAIN_SUFFIXES.items():
        if lower.endswith(suffix):
            raise Unsupported(f"a plain {kind} file is no archive")
    raise Unsupported("no known archive suffix")


def traverses(name: str) -> bool:
    return ".." in name.replace("\\", "/").split("/")


def _capped(f, cap: int | None, what: str) -> bytes:
    body = f.read(-1 if cap is None else cap + 1)
    if cap is not None and len(body) > cap:
        raise TooLarge(f"{what} inflates to more than {cap} bytes")
    return body


@dataclass
class Member:
    """One row of the members table."""

    ord: int
    name: str
    type: str
    mode: int | None
    uid: int
    gid: int
    mtime: int
    uname: str
    gname: str
    link_target: str | None
    comment: str
    compression: str
    body: bytes | None
    year: int = 0
    month: int = 0
    day: int = 0


# ---- ZIP ----
def open_zip(body: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(body))
    except (zipfile.BadZipFile, ValueError, EOFError, OSError, NotImplementedError, IndexError) as e:
        raise FormatError(f"bad zip: {e}") from None


def read_member(z: zipfile.ZipFile, info: zipfile.ZipInfo, o: Options) -> bytes:
    try:
        with z.open(info) as f:
            return _capped(f, o.member_cap, info.filename)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError, ValueError, lzma.LZMAError) as e:
        raise FormatError(f"member {info.filename}: {e}") from None
    except Exception as e:  # zlib.error and others of the decoders
        if isinstance(e, FormatError):
            raise
        raise FormatError(f"member {info.filename}: {e}") from None


def unix_mode(info: zipfile.ZipInfo) -> int | None:
    return info.external_attr >> 16 if info.create_system == 3 else None


def describe_zip(mode: int | None, year: int, month: int, day: int, comment: str) -> str:
    parts = [f"special bits 0o{mode & 0o7000:o}"] if mode is not None and mode & 0o7000 else []
    parts += [f"mtime {year}-{month:02}-{day:02}"] if year != 1980 else []
    quoted = comment.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    parts += [f'comment "{quoted}"'] if comment else []
    return ", ".join(parts) or "normalized"


def _zip_comment(info: zipfile.ZipInfo) -> str:
    return info.comment.decode("utf-8", "replace")


def _read_zip(body: bytes, name: str, o: Options) -> Groups:
    from .registry import handler_of, mime_of, read_groups

    z = open_zip(body)
    summary, groups, total = [], [], 0
    for info in z.infolist():
        mode, (y, m, d) = unix_mode(info), info.date_time[:3]
        if info.comment or mode is None or y != 1980:
            summary.append((f"zip member: {info.filename}", describe_zip(mode, y, m, d, _zip_comment(info))))
    for info in z.infolist():
        if traverses(info.filename):
            raise FormatError(f"zip member leaves the archive: {info.filename}")
        if info.is_dir():
            continue
        try:
            data = read_member(z, info, o)
        except TooLarge:
            raise
        except FormatError:
            continue
        total += len(data)
        if o.total_cap is not None and total > o.total_cap:
            raise TooLarge(f"members inflate to more than {o.total_cap} bytes")
        flat = info.filename.replace("/", "_").replace("\\", "_")
        mime = mime_of(flat)
        if mime in NESTED or not handler_of(mime):
            continue
        try:
            inner = read_groups(data, flat, mime, o)
        except FormatError:
            continue
        groups += [(f"{info.filename}/{g}", items) for g, items in inner if items]
    return groups + ([(name, summary)] if summary else [])


def zip_info(name: str, compression: int = zipfile.ZIP_DEFLATED) -> zipfile.ZipInfo:
    """A header without traces: 1980-01-01, mode 0644."""
    info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
    info.create_system, info.external_attr, info.compress_type = 3, (stat.S_IFREG | 0o644) << 16, compression
    return info


def build_zip(members: list[tuple[str, bytes, int]]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, data, compression in members:
            z.writestr(zip_info(name, compression), data)
    return buf.getvalue()


def first_of_each(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Members by name, byte order, the first of each name."""
    by: dict[str, zipfile.ZipInfo] = {}
    for info in z.infolist():
        by.setdefault(info.filename, info)
    return [by[k] for k in sorted(by, key=lambda n: n.encode("utf-8", "surrogatepass"))]


def dispatch(name: str, data: bytes, o: Options) -> bytes | None:
    """The cleaned member, the member itself, or None to leave it out, as type and policy say."""
    from .registry import clean_body, handler_of, mime_of

    flat = name.replace("/", "_").replace("\\", "_")
    mime = mime_of(flat)
    if mime in NESTED or not handler_of(mime):
        if o.unknown == "abort":
            raise CleanError(f"unknown member {name}")
        return data if o.unknown == "keep" else None
    try:
        return clean_body(data, flat, mime, o)
    except FormatError as e:
        raise CleanError(f"member {name} ({mime}): {e}") from None


def _clean_zip(body: bytes, o: Options) -> bytes:
    z = open_zip(body)
    out, total = [], 0
    for info in first_of_each(z):
        if traverses(info.filename):
            raise CleanError(f"zip member leaves the archive: {info.filename}")
        if info.is_dir():
            continue
        data = read_member(z, info, o)
        total += len(data)
        if o.total_cap is not None and total > o.total_cap:
            raise TooLarge(f"members inflate to more than {o.total_cap} bytes")
        done = dispatch(info.filename, data, o)
        if done is not None:
            out.append((info.filename, done, info.compress_type))
    return build_zip(out)


# ---- TAR ----
def inflate(body: bytes, kind: str, o: Options) -> bytes:
    try:
        if kind == "tar":
            return _capped(io.BytesIO(body), o.stream_cap, "the stream")
        if kind == "tar.zst":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True) as f:
                return _capped(f, o.stream_cap, "the stream")
        f = {"tar.gz": gzip.GzipFile, "tar.bz2": bz2.BZ2File, "tar.xz": lzma.LZMAFile}[kind]
        with f(fileobj=io.BytesIO(body)) if kind == "tar.gz" else f(io.BytesIO(body)) as g:
            return _capped(g, o.stream_cap, "the stream")
    except FormatError:
        raise
    except Exception as e:
        raise FormatError(f"bad {kind}: {e}") from None


def deflate(body: bytes, kind: str) -> bytes:
    if kind == "tar.zst":
        import zstandard

        return zstandard.ZstdCompressor().compress(body)
    if kind == "tar.gz":
        return gzip.compress(body, mtime=0)
    return {"tar": lambda b: b, "tar.bz2": bz2.compress, "tar.xz": lzma.compress}[kind](body)


_TYPES = {tarfile.CHRTYPE: "char", tarfile.BLKTYPE: "block", tarfile.FIFOTYPE: "fifo", tarfile.LNKTYPE: "hardlink", tarfile.SYMTYPE: "symlink", tarfile.DIRTYPE: "dir"}


def unsafe(name: str, kind: str, mode: int, link: str | None, seen: bool) -> str | None:
    """Why a tar member is refused; the first reason counts."""
    if name.startswith("/"):
        return f"absolute path: {name}"
    if traverses(name):
        return f"path traversal: {name}"
    if seen:
        return f"duplicate member: {name}"
    for bit, what in ((0o4000, "setuid"), (0o2000, "setgid")):
        if mode & bit:
            return f"{what} member: {name}"
    if kind in ("char", "block", "fifo"):
        return f"non-regular member: {name}"
    if kind == "hardlink":
        return f"hardlink: {name}"
    if kind == "symlink" and link is not None and (link.startswith("/") or traverses(link)):
        return f"symlink escape: {name} -> {link}"
    return None


def describe_tar(mtime: int, uid: int, gid: int, uname: str, gname: str) -> str:
    pairs = (("mtime", mtime), ("uid", uid), ("gid", gid), ("uname", uname), ("gname", gname))
    return ", ".join(f"{k}={v}" for k, v in pairs if v)


def tar_members(body: bytes, kind: str, o: Options) -> list[Member]:
    raw = inflate(body, kind, o)
    out, seen = [], set()
    try:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:") as t:
            for i, info in enumerate(t):
                what = _TYPES.get(info.type, "regular")
                why = unsafe(info.name, what, info.mode, info.linkname or None, info.name in seen)
                if why:
                    raise FormatError(f"tar {why}")
                seen.add(info.name)
                data = None
                if what == "regular":
                    data = _capped(t.extractfile(info), o.member_cap, info.name)
                    if len(data) < info.size:
                        raise FormatError("the tar is cut off")
                out.append(Member(i, info.name, what, info.mode, info.uid, info.gid, int(info.mtime), info.uname, info.gname, info.linkname or None, "", kind, data))
    except (tarfile.TarError, OSError, EOFError, ValueError) as e:
        if not out and not raw.strip(b"\0") and raw:
            return []
        raise FormatError(f"bad tar: {e}") from None
    return out


def _clean_tar(body: bytes, kind: str, o: Options) -> bytes:
    total, done = 0, []
    for m in tar_members(body, kind, o):
        if m.type == "regular":
            total += len(m.body)
            if o.total_cap is not None and total > o.total_cap:
                raise TooLarge(f"members inflate to more than {o.total_cap} bytes")
            data = dispatch(m.name, m.body, o)
            if data is not None:
                done.append((m.name, data, None))
        elif m.type == "symlink":
            done.append((m.name, None, m.link_target))
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data, link in sorted(done, key=lambda x: x[0].encode("utf-8", "surrogateescape")):
            info = tarfile.TarInfo(name)
            if link is not None:
                info.type, info.linkname, info.mode = tarfile.SYMTYPE, link, 0o777
                t.addfile(info)
            else:
                info.size, info.mode = len(data), 0o644
                t.addfile(info, io.BytesIO(data))
    return deflate(buf.getvalue(), kind)


def members(body: bytes, name: str, o: Options) -> list[Member]:
    """All members of an archive with their bodies, directories included."""
    kind = probe(name)
    if kind != "zip":
        return tar_members(body, kind, o)
    z = open_zip(body)
    out = []
    for i, info in enumerate(z.infolist()):
        if traverses(info.filename):
            raise FormatError(f"zip member leaves the archive: {info.filename}")
        y, m, d = info.date_time[:3]
        data = None if info.is_dir() else read_member(z, info, o)
        kind = {0: "stored", 8: "deflated", 12: "bzip2", 14: "lzma"}.get(info.compress_type, str(info.compress_type))
        out.append(Member(i, info.filename, "dir" if info.is_dir() else "regular", unix_mode(info), 0, 0, 0, "", "", None, _zip_comment(info), kind, data, y, m, d))
    return out


def read_archive(body: bytes, name: str = "", options: Options = Options(), **_: object) -> Groups:
    kind = probe(name)
    if kind == "zip":
        return _read_zip(body, name, options)
    items = [(f"tar member: {m.name}", d) for m in tar_members(body, kind, options) if (d := describe_tar(m.mtime, m.uid, m.gid, m.uname, m.gname))]
    return [(name, items)] if items else []


def clean_archive(body: bytes, name: str = "", options: Options = Options(), **_: object) -> bytes:
    kind = probe(name)
    return _clean_zip(body, options) if kind == "zip" else _clean_tar(body, kind, options)
