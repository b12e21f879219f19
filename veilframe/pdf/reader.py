"""From bytes to an object table and its pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from veilframe.pdf import crypto, filters
from veilframe.pdf.lexer import Lexer
from veilframe.pdf.model import File, PdfError, Ref, Stream, as_int, as_number

#: Deepest page tree that is followed.
MAX_DEPTH = 64
_GAP, _DELIMITED = rb"[\0\t\n\x0c\r ]", rb"(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|$)"
_ENTRY = re.compile(_GAP + rb"*(\d+)" + _GAP + rb"+(\d+)" + _GAP + rb"+([nf])" + _DELIMITED)
_HEAD = re.compile(_GAP + rb"*(\d+)" + _GAP + rb"+(\d+)" + _GAP + rb"+obj" + _DELIMITED)
_ENDSTREAM = re.compile(_GAP + rb"*endstream")


@dataclass
class Page:
    ref: Ref
    dict: dict
    resources: Any
    media: tuple[float, float, float, float]
    crop: tuple[float, float, float, float]
    rotate: int

    @property
    def size(self) -> tuple[float, float]:
        w, h = self.crop[2] - self.crop[0], self.crop[3] - self.crop[1]
        return (h, w) if self.rotate % 360 in (90, 270) else (w, h)


@dataclass
class Document:
    file: File
    pages: list[Page] = field(default_factory=list)

    @property
    def catalog(self) -> dict:
        return self.file.dict_of(self.file.trailer.get("Root"))

    def page(self, i: int) -> Page:
        if not 0 <= i < len(self.pages):
            raise PdfError("InvalidPageIndex", f"page {i} of {len(self.pages)}")
        return self.pages[i]


@dataclass
class _Xref:
    """What a chain of sections says of each object number: the newest section wins, also by freeing."""

    places: dict[int, tuple] = field(default_factory=dict)  # num -> (gen, offset) or ("in", container, index) or None if free
    trailer: dict = field(default_factory=dict)
    form: str = ""


def open_pdf(data: bytes, password: bytes | str = b"", certificate: tuple[bytes, bytes] | None = None) -> Document:
    """A document; ``certificate`` is (certificate, private key), both DER."""
    return build(parse(data, password, certificate))


def parse(data: bytes, password: bytes | str = b"", certificate: tuple[bytes, bytes] | None = None) -> File:
    if not data.startswith(b"%PDF-"):
        raise PdfError("Parse", "the header is missing")
    version = re.match(rb"%PDF-([0-9.]+)", data)
    start = data.rfind(b"startxref")
    if start < 0:
        raise PdfError("Parse", "startxref is missing")
    x = _Xref()
    lex = Lexer(data, start + 9)
    _follow(data, lex.integer(), x)
    file = File(version[1].decode() if version else "1.4", {}, x.trailer, x.form or "classic")
    lengths: dict[int, int] = {}

    def length(v: Any) -> int | None:
        """A stream's length, perhaps the value of another object."""
        if isinstance(v, Ref):
            if v.num not in lengths and isinstance(p := x.places.get(v.num), tuple) and p[0] != "in":
                lengths[v.num] = -1
                n = as_int(_indirect(data, p[1], lambda _: None)[1])
                lengths[v.num] = -1 if n is None else n
            v = lengths.get(v.num, -1)
        n = as_int(v)
        return n if n is not None and n >= 0 else None

    packed = []
    for num, place in sorted(x.places.items()):
        if place is None:
            continue
        if place[0] == "in":
            packed.append((num, place[1], place[2]))
            continue
        ref, value = _indirect(data, place[1], length)
        if ref.num != num:
            raise PdfError("Corrupt", f"object {num} is not where the cross-reference has it")
        file.objects[ref] = value
    _decrypt(file, password, certificate)
    _unpack(file, packed)
    return file


def _follow(data: bytes, at: int, x: _Xref) -> None:
    """Sections from the newest to the oldest; a hybrid's stream counts before what is older than its table."""
    todo, seen = [at], set()
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        if not 0 <= at < len(data):
            raise PdfError("Corrupt", f"a cross-reference at byte {at}")
        lex = Lexer(data, at)
        lex.skip()
        if data.startswith(b"xref", lex.pos):
            lex.pos += 4
            places, trailer, form = _table(lex), None, "classic"
            lex.expect(b"trailer")
            trailer = lex.value()
            if not isinstance(trailer, dict):
                raise PdfError("Corrupt", "the trailer is no dictionary")
        else:
            places, trailer = _stream_section(data, lex.pos)
            form = "stream"
        for num, p in places.items():
            x.places.setdefault(num, p)
        for k, v in trailer.items():
            x.trailer.setdefault(k, v)
        x.form = x.form or form
        more = [as_int(trailer.get(k)) for k in ("XRefStm", "Prev")]
        todo[:0] = [m for m in more if m is not None]
    for k in ("Prev", "XRefStm", "W", "Index", "Type", "Filter", "DecodeParms", "Length", "Size"):
        x.trailer.pop(k, None)


def _table(lex: Lexer) -> dict[int, tuple | None]:
    out: dict[int, tuple | None] = {}
    while True:
        lex.skip()
        if lex.data.startswith(b"trailer", lex.pos):
            return out
        first, n = lex.integer(), lex.integer()
        for num in range(first, first + n):
            if m := _ENTRY.match(lex.data, lex.pos):
                lex.pos = m.end()
                out[num] = (int(m[2]), int(m[1])) if m[3] == b"n" else None
                continue
            offset, gen, kind = lex.integer(), lex.integer(), lex.word()
            if kind not in (b"n", b"f"):
                raise PdfError("Corrupt", "an entry of the cross-reference table")
            out[num] = (gen, offset) if kind == b"n" else None


def _stream_section(data: bytes, at: int) -> tuple[dict, dict]:
    _, value = _indirect(data, at, as_int)
    if not isinstance(value, Stream) or value.dict.get("Type") != "XRef":
        raise PdfError("Corrupt", "no cross-reference where one should be")
    d = value.dict
    body = filters.decode(value.data, d)
    w = [as_int(v, -1) for v in d.get("W", [])]
    if len(w) != 3 or min(w) < 0 or max(w) > 8:
        raise PdfError("Corrupt", "field widths of a cross-reference stream")
    index = d.get("Index") or [0, as_int(d.get("Size"), 0)]
    out: dict[int, tuple | None] = {}
    row = 0
    for first, n in zip(index[::2], index[1::2]):
        for num in range(first, first + n):
            at = row * sum(w)
            if at + sum(w) > len(body):
                raise PdfError("Corrupt", "a cross-reference stream is cut short")
            a, b, c = (body[at + sum(w[:k]) : at + sum(w[: k + 1])] for k in range(3))
            kind, two, three = int.from_bytes(a) if w[0] else 1, int.from_bytes(b), int.from_bytes(c)
            out[num] = {1: (three, two), 2: ("in", two, three)}.get(kind)
            row += 1
    return out, dict(d)


def _indirect(data: bytes, at: int, length) -> tuple[Ref, Any]:
    """The object at a byte, streams framed by their length or, where that leads nowhere, by endstream."""
    if not 0 <= at < len(data):
        raise PdfError("Corrupt", f"an object at byte {at}")
    lex = Lexer(data, at)
    if m := _HEAD.match(data, at):
        ref, lex.pos = Ref(int(m[1]), int(m[2])), m.end()
    else:
        ref = Ref(lex.integer(), lex.integer())
        lex.expect(b"obj")
    value = lex.value()
    lex.skip()
    if not (isinstance(value, dict) and data.startswith(b"stream", lex.pos)):
        return ref, value
    start = lex.pos + 6
    start += 2 if data[start : start + 2] == b"\r\n" else 1 if data[start : start + 1] in (b"\n", b"\r") else 0
    n = length(value.get("Length"))
    if n is None or not _ENDSTREAM.match(data, start + n):
        end = data.find(b"endstream", start)
        if end < 0:
            raise PdfError("Corrupt", "a stream does not end")
        n = end - start
        n -= 2 if data[start + n - 2 : start + n] == b"\r\n" else 1 if data[start + n - 1 : start + n] in (b"\n", b"\r") else 0
    return ref, Stream(value, data[start : start + n])


def _decrypt(file: File, password: bytes | str, certificate: tuple[bytes, bytes] | None) -> None:
    enc = file.trailer.get("Encrypt")
    d = file.resolve(enc)
    if d is None:
        return
    if not isinstance(d, dict):
        raise PdfError("Corrupt", "the encryption dictionary")
    kind = d.get("Filter")
    if kind == "Standard":
        handler = crypto.standard(d, file.trailer, password.encode() if isinstance(password, str) else password, file.resolve)
    elif kind in ("Adobe.PubSec", "Adobe.PPKLite"):
        if certificate is None:
            raise PdfError("InvalidPassword", "a certificate is needed")
        handler = crypto.public_key(d, *certificate, file.resolve)
    else:
        raise PdfError("Unsupported", f"security handler {kind}")
    crypto.decrypt_file(file, handler, enc if isinstance(enc, Ref) else None)


def _unpack(file: File, packed: list[tuple[int, int, int]]) -> None:
    """Members of object streams take their place in the table, their containers leave it."""
    containers: dict[int, list] = {}
    for num, container, _ in packed:
        if container not in containers:
            box = file.objects.get(Ref(container, 0))
            if not isinstance(box, Stream):
                raise PdfError("Corrupt", f"object stream {container} is not there")
            body = filters.decode(box.data, box.dict, file.resolve)
            n, first = as_int(file.resolve(box.dict.get("N")), 0), as_int(file.resolve(box.dict.get("First")), 0)
            head = Lexer(body)
            containers[container] = [(head.integer(), body, first + head.integer()) for _ in range(n)]
        where = next((c for c in containers[container] if c[0] == num), None)
        if where is None:
            raise PdfError("Corrupt", f"object {num} is not in its stream")
        file.objects.setdefault(Ref(num, 0), Lexer(where[1], where[2]).value())
    for container in containers:
        file.objects.pop(Ref(container, 0), None)
    for ref in [r for r, v in file.objects.items() if isinstance(v, Stream) and v.dict.get("Type") in ("ObjStm", "XRef")]:
        del file.objects[ref]


def build(file: File) -> Document:
    """Checks catalog and page tree, and walks the pages with what they inherit."""
    doc = Document(file)
    if "Root" not in file.trailer:
        raise PdfError("Corrupt", "the trailer has no Root")
    if doc.catalog.get("Type") != "Catalog":
        raise PdfError("Corrupt", "the catalog")
    root = doc.catalog.get("Pages")
    if not isinstance(root, Ref):
        raise PdfError("Corrupt", "the catalog has no page tree")
    todo: list[tuple] = [(root, {}, 0, frozenset())]
    while todo:
        ref, above, depth, trail = todo.pop()
        if depth > MAX_DEPTH:
            raise PdfError("Unsupported", f"a page tree deeper than {MAX_DEPTH}")
        if ref in trail:
            raise PdfError("Corrupt", "the page tree leads in a circle")
        node = file.dict_of(ref)
        own = above | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
        if node.get("Type") == "Pages" or "Kids" in node:
            kids = file.resolve(node.get("Kids")) or []
            todo += [(k, own, depth + 1, trail | {ref}) for k in reversed(kids) if isinstance(k, Ref)]
        elif node.get("Type") == "Page":
            media = rectangle(file, own.get("MediaBox"))
            if media is None:
                raise PdfError("Corrupt", "a page has no MediaBox")
            crop = rectangle(file, own.get("CropBox")) or media
            turn = as_int(file.resolve(own.get("Rotate")), 0) % 360
            doc.pages.append(Page(ref, node, own.get("Resources", {}), media, crop, turn))
        else:
            raise PdfError("Corrupt", "a node of the page tree is neither page nor pages")
    return doc


def rectangle(file: File, v: Any) -> tuple[float, float, float, float] | None:
    v = file.resolve(v)
    if not isinstance(v, list) or len(v) != 4:
        return None
    n = [as_number(file.resolve(x)) for x in v]
    if None in n:
        return None
    return min(n[0], n[2]), min(n[1], n[3]), max(n[0], n[2]), max(n[1], n[3])
