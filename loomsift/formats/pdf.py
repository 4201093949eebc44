"""PDF: a reader of objects (classic and stream cross-references), metadata items, and a scrubbing writer."""

from __future__ import annotations

import hashlib
import re
import zlib

from .errors import CleanError, FormatError
from .fixed import PDF_ADVICE, PDF_CATALOG, PDF_INFO, PDF_NAMES, PDF_PAGE, PDF_XOBJECT
from .packets import xmp_items

Items = list[tuple[str, str]]


class Name(str):
    __slots__ = ()


class Ref(tuple):
    """(number, generation)"""

    __slots__ = ()


class Stream:
    def __init__(self, dictionary: dict, raw: bytes) -> None:
        self.dict, self.raw = dictionary, raw


_SPACE = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_WORD = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_ESC = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
DEPTH = 200


class Parser:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        if depth > DEPTH:
            raise FormatError("PDF objects are nested too deeply")
        self.skip()
        d, at = self.data, self.at
        c = d[at : at + 1]
        if d[at : at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self.skip()
                if d[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    raise FormatError("a PDF dictionary key is no name")
                out[key] = self.value(depth + 1)
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if c == b"/":
            m = _WORD.match(d, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0]).decode("latin-1") if m else "")
        if c == b"(":
            return self._literal()
        if c == b"<":
            end = d.find(b">", at)
            if end < 0:
                raise FormatError("a PDF string has no end")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at:end])
            return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())
        if m := _REF.match(d, at):
            self.at = m.end()
            return Ref((int(m[1]), int(m[2])))
        if m := _NUMBER.match(d, at):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        m = _WORD.match(d, at)
        if not m:
            raise FormatError(f"bad PDF syntax at byte {at}")
        self.at = m.end()
        known = {b"true": True, b"false": False, b"null": None}
        if m[0] not in known:
            raise FormatError(f"bad PDF word at byte {at}")
        return known[m[0]]

    def _literal(self) -> bytes:
        d, at, level, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at : at + 1]
            if c == b"\\":
                e = d[at + 1 : at + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(d, at + 1):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                if e in (b"\r", b"\n"):
                    at += 3 if d[at + 1 : at + 3] == b"\r\n" else 2
                    continue
                out += _ESC.get(e, e)
                at += 2
                continue
            level += (c == b"(") - (c == b")")
            at += 1
            if not level:
                self.at = at
                return bytes(out)
            out += c
        raise FormatError("a PDF string has no end")


def text_of(v: object) -> str:
    if isinstance(v, bytes):
        if v[:2] == b"\xfe\xff":
            return v[2:].decode("utf-16-be", "replace")
        return v.decode("utf-8", "replace")
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


class Document:
    """All objects of a file by number, the newest of each, and the trailer. Found by scanning, so damaged tables do no harm."""

    def __init__(self, body: bytes) -> None:
        if b"%PDF-" not in body[:1024]:
            raise FormatError("no PDF signature")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        packed = []
        at = 0
        head = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj(?![A-Za-z])|trailer(?=[\0\t\n\x0c\r <])")
        while m := head.search(body, at):
            at = m.end()
            p = Parser(body, at)
            try:
                v = p.value()
            except FormatError:
                continue
            p.skip()
            if m[1] is None:
                if isinstance(v, dict):
                    self.trailer = {**self.trailer, **v}
                at = p.at
                continue
            if isinstance(v, dict) and body.startswith(b"stream", p.at):
                start = p.at + 6
                start += 2 if body[start : start + 2] == b"\r\n" else 1
                n = v.get("Length")
                n = n if isinstance(n, int) and body[start + n : start + n + 12].lstrip().startswith(b"endstream") else None
                end = start + n if n is not None else body.find(b"endstream", start)
                if end < 0:
                    continue
                raw = body[start:end] if n is not None else body[start:end].removesuffix(b"\n").removesuffix(b"\r")
                v = Stream(v, raw)
                at = end
                if v.dict.get("Type") == "XRef":
                    self.trailer = {**self.trailer, **{k: x for k, x in v.dict.items() if k in ("Root", "Info", "ID", "Encrypt")}}
                    continue
                if v.dict.get("Type") == "ObjStm":
                    packed.append(v)
                    continue
            else:
                at = p.at
            self.objects[int(m[1])] = v
        for s in packed:
            self._unpack(s)
        if "Encrypt" in self.trailer:
            raise FormatError("an encrypted PDF can't be read")
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            root = next((Ref((n, 0)) for n, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
            if root is None:
                raise FormatError("the PDF has no catalog")
            self.trailer["Root"] = root

    def _unpack(self, s: Stream) -> None:
        try:
            data, n, first = self.data(s), int(s.dict["N"]), int(s.dict["First"])
            p = Parser(data)
            pairs = [(p.value(), p.value()) for _ in range(n)]
            for number, offset in pairs:
                self.objects.setdefault(number, Parser(data, first + offset).value())
        except (FormatError, KeyError, TypeError, ValueError):
            return

    def get(self, v: object):
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            v = self.objects.get(v[0])
        return None

    def data(self, s: Stream) -> bytes:
        filters = self.get(s.dict.get("Filter"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        raw = s.raw
        for f in filters:
            if f != "FlateDecode":
                raise FormatError(f"PDF filter {f} can't be decoded")
            try:
                raw = zlib.decompressobj().decompress(raw, 256 << 20)
            except zlib.error as e:
                raise FormatError(f"bad PDF stream: {e}") from None
        parms = self.get(s.dict.get("DecodeParms"))
        if isinstance(parms, dict) and parms.get("Predictor", 1) > 1:
            raise FormatError("PDF predictors can't be decoded")
        return raw

    @property
    def root(self) -> dict:
        return self.get(self.trailer["Root"])

    def pages(self) -> list[dict]:
        out, seen = [], set()
        stack = [self.root.get("Pages")]
        while stack:
            ref = stack.pop()
            v = self.get(ref)
            if not isinstance(v, dict) or id(v) in seen:
                continue
            seen.add(id(v))
            kids = self.get(v.get("Kids"))
            if isinstance(kids, list):
                stack += reversed(kids)
            else:
                out.append(v)
        return out


def read_pdf(body: bytes, extended: bool = False, **_: object) -> Items:
    d = Document(body)
    out: Items = []
    info = d.get(d.trailer.get("Info"))
    if isinstance(info, dict):
        for k in [*PDF_INFO, *(k for k in info if k not in PDF_INFO)]:
            if k in info and (t := text_of(d.get(info[k]))):
                out.append((k, t))
    meta = d.get(d.root.get("Metadata"))
    if isinstance(meta, Stream):
        try:
            fields = xmp_items(d.data(meta), extended)
        except FormatError:
            fields = []
        out += fields or [("XMP Metadata", "present")]
    out += [(label, "present") for k, label in PDF_ADVICE.items() if k in d.root]
    names = d.root.get("Names")
    if isinstance(names, Ref) or extended:
        names = d.get(names)
        if isinstance(names, dict):
            out += [(label, "present") for k, label in (("EmbeddedFiles", "Embedded files"), ("JavaScript", "JavaScript actions")) if k in names]
    pages = d.pages()
    for k, label in (("Annots", "Annotations"), ("Metadata", "Per-page XMP metadata")):
        n = sum(k in p for p in pages)
        if n:
            out.append((label, f"{n} of {len(pages)} pages"))
    return out


def _write(v: object, number: dict[int, int]) -> bytes:
    if isinstance(v, Ref):
        return b"%d 0 R" % number[v[0]] if v[0] in number else b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if v is None:
        return b"null"
    if isinstance(v, Name):
        return b"/" + re.sub(rb"[^!$&'*+,.0-;=?-Z^-z|~\\-]", lambda m: b"#%02X" % m[0][0], v.encode("latin-1", "replace"))
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(v, list):
        return b"[" + b" ".join(_write(x, number) for x in v) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(_write(Name(k), number) + b" " + _write(x, number) for k, x in v.items()) + b">>"
    raise CleanError("unknown PDF value")


def clean_pdf(body: bytes, **_: object) -> bytes:
    """The objects that the stripped catalog still reaches, renumbered; the /ID follows from the content."""
    d = Document(body)
    root = d.root
    for k in PDF_CATALOG:
        root.pop(k, None)
    names = d.get(root.get("Names"))
    if isinstance(names, dict):
        for k in PDF_NAMES:
            names.pop(k, None)
        if not names:
            root.pop("Names", None)
    for p in d.pages():
        for k in PDF_PAGE:
            p.pop(k, None)
    for v in d.objects.values():
        if isinstance(v, Stream):
            for k in PDF_XOBJECT:
                v.dict.pop(k, None)
    order: list[int] = []
    number: dict[int, int] = {}
    stack: list = [d.trailer["Root"]]
    while stack:
        v = stack.pop()
        if isinstance(v, Ref):
            if v[0] in d.objects and v[0] not in number:
                order.append(v[0])
                number[v[0]] = len(order)
                stack.append(d.objects[v[0]])
        elif isinstance(v, Stream):
            v.dict.pop("Length", None)
            stack += reversed(v.dict.values())
        elif isinstance(v, dict):
            stack += reversed(v.values())
        elif isinstance(v, list):
            stack += reversed(v)
    version = re.match(rb"%PDF-\d\.\d", body[body.find(b"%PDF-") :])
    out = bytearray((version[0] if version else b"%PDF-1.7") + b"\n%\xe2\xe3\xcf\xd3\n")
    places = []
    for n in order:
        v = d.objects[n]
        places.append(len(out))
        out += b"%d 0 obj\n" % number[n]
        if isinstance(v, Stream):
            out += _write({**v.dict, "Length": len(v.raw)}, number) + b"\nstream\n" + v.raw + b"\nendstream"
        else:
            out += _write(v, number)
        out += b"\nendobj\n"
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(order) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    ident = hashlib.sha256(bytes(out)).digest()[:16].hex().encode()
    out += b"trailer\n<</Size %d /Root %d 0 R /ID [<%s> <%s>]>>\nstartxref\n%d\n%%%%EOF\n" % (len(order) + 1, number[d.trailer["Root"][0]], ident, ident, table)
    return bytes(out)
