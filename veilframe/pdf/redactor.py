"""Applying a plan to a document: text, paths, images, forms, annotations, layers, metadata.

One interpretation of a page says where everything is; each stream that is touched is
then written anew, the innermost forms first. Every drawing of a form or of a partly
covered image gets a copy of its own, so other drawings keep theirs. What nothing leads
to any more is dropped at the end, so no removed content stays in the file.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from typing import Any

from veilframe.operators.redact import ALLOWED
from veilframe.operators.targets import Plan
from veilframe.pdf import content, filters, jpeg, layout
from veilframe.pdf.content import Operation
from veilframe.pdf.layout import Box, Draw, Glyph, meets
from veilframe.pdf.lexer import number_text
from veilframe.pdf.model import File, Name, PdfError, Ref, Stream, as_int, reachable, refs_in
from veilframe.pdf.reader import Document, Page, build

#: Forms within forms that are rewritten; deeper ones that are hit are dropped whole.
MAX_FORMS = 8
LEAST_KERN = 0.01
#: A draw covered to within this is covered.
EDGE = 1e-6
OVERLAY_FONT = "RedactOverlay"


@dataclass
class Target:
    """Boxes on a page; ``group`` makes their common bounds the place of one label."""

    page: int
    quads: list[Box]

    @property
    def bounds(self) -> Box:
        q = self.quads
        return min(b[0] for b in q), min(b[1] for b in q), max(b[2] for b in q), max(b[3] for b in q)


@dataclass
class Report:
    pages_touched: int = 0
    text_glyphs_removed: int = 0
    path_paints_removed: int = 0
    image_draws_removed: int = 0
    image_draws_masked: int = 0
    annotations_removed: int = 0
    form_xobjects_rewritten: int = 0
    warnings: list[str] = field(default_factory=list)


def targets_of(plan: list[dict], doc: Document) -> list[Target]:
    """Checked targets of a plan's JSON (rect, quad, quadGroup)."""
    out = []
    for t in plan:
        i, kind = as_int(t.get("pageIndex"), -1), t.get("kind")
        w, h = doc.page(i).size
        points = lambda ps: (min(p["x"] for p in ps), min(p["y"] for p in ps), max(p["x"] for p in ps), max(p["y"] for p in ps))
        if kind == "rect":
            x, y, dx, dy = (float(t[k]) for k in ("x", "y", "width", "height"))
            quads = [(min(x, x + dx), min(y, y + dy), max(x, x + dx), max(y, y + dy))]
        elif kind in ("quad", "quadGroup"):
            quads = [points(q) for q in ([t["points"]] if kind == "quad" else t.get("quads") or [])]
        else:
            raise PdfError("UnsupportedOption", f"target kind {kind}")
        if not quads:
            raise PdfError("UnsupportedOption", "a group without quads")
        target = Target(i, quads)
        b = target.bounds
        if not (b[2] > b[0] and b[3] > b[1]):
            raise PdfError("UnsupportedOption", "an empty target")
        if not meets(b, (0.0, 0.0, w, h)):
            raise PdfError("UnsupportedOption", "a target off the page")
        out.append(target)
    return out


def apply(doc: Document, targets: list[Target], plan: Plan = Plan()) -> tuple[Document, Report]:
    """A new document; the given one is left as it is, also on failure."""
    try:
        file = doc.file.copy()
        doc = build(file)
        report = Report()
        layers = _hidden_layers(doc)
        if layers:
            if not plan.sanitize_hidden_ocgs:
                raise PdfError("Unsupported", "the document has hidden layers")
            _strip_layers(doc, layers)
            doc = build(file)
        if plan.strip_metadata:
            file.trailer.pop("Info", None)
            for d in [doc.catalog, *(p.dict for p in doc.pages)]:
                d.pop("Metadata", None)
        if plan.strip_attachments:
            _strip_attachments(doc)
        by_page: dict[int, list[Target]] = defaultdict(list)
        for t in targets:
            doc.page(t.page)
            by_page[t.page].append(t)
        replaced: set[Ref] = set()
        for i in sorted(by_page):
            replaced |= _Page(doc, i, by_page[i], plan, report).redact()
        if replaced:
            _forget(file, replaced - _drawn(build(file)))
        sweep(file)
        return build(file), report
    except RecursionError as e:
        raise PdfError("Unsupported", "values are nested too deeply") from e


def _drawn(doc: Document) -> set[Ref]:
    """XObjects that some page draws, also through forms. Content that cannot be read counts as drawing all it names."""
    file, out = doc.file, set()
    todo = [(p.dict.get("Contents"), file.dict_of(p.resources), None) for p in doc.pages]
    while todo:
        source, res, form = todo.pop()
        table = file.dict_of(res.get("XObject"))
        try:
            data = content.page_data(file, source) if form is None else filters.decode(form.data, form.dict, file.resolve)
            names = {o.args[0] for o in content.parse(data) if o.op == "Do" and o.args}
        except PdfError:
            names = set(table)
        for ref in (table.get(n) for n in names):
            if isinstance(ref, Ref) and ref not in out:
                out.add(ref)
                thing = file.resolve(ref)
                if isinstance(thing, Stream) and thing.dict.get("Subtype") == "Form":
                    own = file.dict_of(thing.dict.get("Resources"))
                    todo.append((None, own | {"XObject": dict(table) | dict(file.dict_of(own.get("XObject")))}, thing))
    return out


def _forget(file: File, refs: set[Ref]) -> None:
    """Take XObjects that nothing draws any more out of every table of resources that names them."""
    todo: list[Any] = list(file.objects.values())
    while todo:
        v = todo.pop()
        v = v.dict if isinstance(v, Stream) else v
        if isinstance(v, dict):
            table = file.dict_of(v.get("XObject"))
            for k in [k for k, x in table.items() if isinstance(x, Ref) and x in refs]:
                del table[k]
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)


def sweep(file: File) -> None:
    """Drop every object that nothing leads to."""
    alive = reachable(file, [file.trailer])
    for ref in [r for r in file.objects if r not in alive]:
        del file.objects[ref]


class _Page:
    def __init__(self, doc: Document, index: int, targets: list[Target], plan: Plan, report: Report):
        self.doc, self.file, self.page, self.plan, self.report = doc, doc.file, doc.page(index), plan, report
        self.index, self.targets = index, targets
        self.quads = [q for t in targets for q in t.quads]
        self.areas = [*self.quads, *(t.bounds for t in targets)]  # what paths and annotations are tested against

    def hit(self, b: Box, areas: list[Box] | None = None) -> bool:
        # A box without width or height still lies somewhere.
        b = (b[0], b[1], max(b[2], b[0] + 1e-9), max(b[3], b[1] + 1e-9))
        return any(meets(b, a) for a in (self.quads if areas is None else areas))

    def redact(self) -> set[Ref]:
        """Rewrites the page; the objects that some drawing no longer uses."""
        ops = content.parse(content.page_data(self.file, self.page.dict.get("Contents")))
        found = layout.layout(self.doc, self.index, ops)
        self.report.warnings += found.warnings
        for path, (stream_ops, _) in found.streams.items():
            self._check(stream_ops, path)
        gone: dict[tuple, list[Glyph]] = defaultdict(list)
        for g in found.hits(self.quads):
            gone[g.path].append(g)
        self.report.text_glyphs_removed += len({(g.path, g.op, g.operand, g.element, g.start, g.end) for gs in gone.values() for g in gs})
        edits: dict[tuple, dict[int, Any]] = defaultdict(dict)  # stream -> operation -> what takes its place
        for path, i, box in found.paints:
            if self.hit(box, self.areas):
                edits[path][i] = [Operation("n", [])]
                self.report.path_paints_removed += 1
        names: dict[tuple, dict[str, Ref]] = defaultdict(dict)  # stream -> XObjects added to its resources
        for d in found.draws:
            if d.kind != "form":
                self._image(d, edits, names)
        # Innermost first: a form's copy must be there when what draws it is written.
        for path in sorted(found.streams, key=len, reverse=True):
            stream_ops, res = found.streams[path]
            if path in gone:
                edits[path] |= self._text(stream_ops, gone[path])
            if not path or not (edits[path] or names[path]):
                continue
            draw = next(d for d in found.draws if d.kind == "form" and d.path == path[:-1] and d.op == path[-1])
            if len(path) > MAX_FORMS:
                self.report.warnings.append(f"a form deeper than {MAX_FORMS} that is hit is dropped whole")
                edits[path[:-1]][path[-1]] = []
                continue
            edits[path[:-1]][path[-1]] = [Operation("Do", [self._form(draw, stream_ops, res, edits[path], names[path], names[path[:-1]])])]
            self.report.form_xobjects_rewritten += 1
        self._annotations()
        self._write(_edited(ops, edits[()]), names[()])
        self.report.pages_touched += 1
        return {d.ref for d in found.draws if d.ref is not None and d.op in edits[d.path]}

    def _check(self, ops: list[Operation], path: tuple) -> None:
        depth = 0
        for o in ops:
            depth += {"BX": 1, "EX": -1}.get(o.op, 0)
            depth = max(depth, 0)
            if not depth and o.op not in ALLOWED and o.op != "BI":
                raise PdfError("Unsupported", f"operator {o.op} on a page to be rewritten")

    def _text(self, ops: list[Operation], gone: list[Glyph]) -> dict[int, list[Operation]]:
        """Show operations without the bytes of removed glyphs, closed up or with kerning in their place."""
        out = {}
        removed: dict[int, dict[tuple, float]] = defaultdict(dict)
        for g in gone:  # characters of one code have one box, so all of them are here
            key = (g.element, g.start, g.end)
            removed[g.op][key] = removed[g.op].get(key, 0.0) + g.kern
        for i, cuts in removed.items():
            o = ops[i]
            if o.op == "TJ":
                parts = list(o.args[-1])
            else:
                parts = [o.args[-1]]
                cuts = {(0, s, e): k for (_, s, e), k in cuts.items()}
            new: list[Any] = []
            for n, part in enumerate(parts):
                if not isinstance(part, bytes):
                    _push(new, part)
                    continue
                at = 0
                for (_, s, e), kern in sorted((c for c in cuts.items() if c[0][0] == n), key=lambda c: c[0][1]):
                    _push(new, part[at:s])
                    if self.plan.mode != "strip":
                        _push(new, -kern)
                    at = e
                _push(new, part[at:])
            new = [x for x in new if isinstance(x, bytes) or abs(x) >= LEAST_KERN]
            before = []
            if o.op in ("'", '"'):  # what these do besides showing
                before = [Operation("Tw", [o.args[0]]), Operation("Tc", [o.args[1]])] if o.op == '"' else []
                before.append(Operation("T*", []))
            only = [x for x in new if isinstance(x, bytes)]
            if self.plan.mode == "strip" and o.op != "TJ":
                shown = [Operation("Tj", [b"".join(only)])]
            else:
                shown = [Operation("TJ", [new])]
            out[i] = [*before, *shown]
        return out

    def _image(self, d: Draw, edits: dict, names: dict) -> None:
        cover = _coverage(d, self.quads)
        if cover is None:
            return
        if d.kind == "image" and cover != "full":
            masked = self._masked(d, cover)
            if masked is not None:
                name = f"{d.name}_r{len(names[d.path])}_{d.op}"
                names[d.path][name] = masked
                edits[d.path][d.op] = [Operation("Do", [Name(name)])]
                self.report.image_draws_masked += 1
                return
        edits[d.path][d.op] = []
        self.report.image_draws_removed += 1

    def _masked(self, d: Draw, cover: tuple[float, float, float, float]) -> Ref | None:
        """A copy of an image with the covered pixels painted, None where its format does not allow it."""
        image = self.file.resolve(d.ref)
        if d.ref is None or not isinstance(image, Stream):
            return None
        get = lambda k: self.file.resolve(image.dict.get(k))
        w, h, bpc = as_int(get("Width"), 0), as_int(get("Height"), 0), as_int(get("BitsPerComponent"), 0)
        space = get("ColorSpace")
        space = space[0] if isinstance(space, list) and len(space) == 1 else space
        n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(str(space))
        chain = filters.names(image.dict, self.file.resolve)
        odd = any(k in image.dict for k in ("ImageMask", "Decode", "Mask")) or any(f != "FlateDecode" for f in chain if f != chain[-1] or f != "DCTDecode")
        data = None if n is None or bpc != 8 or odd else self._samples(image, chain, w, h, n)
        if data is None:
            self.report.warnings.append(f"image {d.name} cannot be painted in part and is dropped whole")
            return None
        if len(data) < w * h * n:
            raise PdfError("Corrupt", "an image has too few bytes")
        pixel = _pixel(self.plan.fill, n)
        for x0, y0, x1, y1 in self._pixels(d, w, h):
            for y in range(y0, y1):
                at = (y * w + x0) * n
                data[at : at + (x1 - x0) * n] = pixel * (x1 - x0)
        new = {k: v for k, v in image.dict.items() if k not in ("Filter", "DecodeParms", "Length")}
        soft = self.file.resolve(new.pop("SMask", None))
        if isinstance(soft, Stream):  # what is painted must show
            new["SMask"] = self._opaque(soft, d)
        return self.file.add(Stream(new | {"Filter": Name("FlateDecode")}, zlib.compress(bytes(data))))

    def _samples(self, image: Stream, chain: list[str], w: int, h: int, n: int) -> bytearray | None:
        """The samples of an image, row by row; None if it is a picture of another kind or shape than is read."""
        if chain[-1:] != ["DCTDecode"]:
            return bytearray(filters.decode(image.data, image.dict, self.file.resolve))
        parms = self.file.resolve(image.dict.get("DecodeParms"))
        every = [self.file.dict_of(p) for p in (parms if isinstance(parms, list) else [parms])]
        inner = {"Filter": [Name(f) for f in chain[:-1]], "DecodeParms": every[: len(chain) - 1]}
        raw = filters.decode(image.data, inner, self.file.resolve) if len(chain) > 1 else image.data
        try:
            picture = jpeg.decode(raw, as_int(every[-1].get("ColorTransform")) if every else None)
        except PdfError:
            return None
        return bytearray(picture.tobytes()) if picture.shape == (h, w, n) else None

    def _opaque(self, soft: Stream, d: Draw) -> Ref:
        w, h = as_int(self.file.resolve(soft.dict.get("Width")), 0), as_int(self.file.resolve(soft.dict.get("Height")), 0)
        chain = filters.names(soft.dict, self.file.resolve)
        if as_int(soft.dict.get("BitsPerComponent"), 0) != 8 or any(f != "FlateDecode" for f in chain):
            return self.file.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\xff"))
        data = bytearray(filters.decode(soft.data, soft.dict, self.file.resolve))
        for x0, y0, x1, y1 in self._pixels(d, w, h):
            for y in range(y0, y1):
                data[y * w + x0 : y * w + x1] = b"\xff" * (x1 - x0)
        new = {k: v for k, v in soft.dict.items() if k not in ("Filter", "DecodeParms", "Length")}
        return self.file.add(Stream(new | {"Filter": Name("FlateDecode")}, zlib.compress(bytes(data))))

    def _pixels(self, d: Draw, w: int, h: int) -> list[tuple[int, int, int, int]]:
        out = []
        for q in self.quads:
            c = _coverage(d, [q])
            if c is None:
                continue
            u0, v0, u1, v1 = (0.0, 0.0, 1.0, 1.0) if c == "full" else c
            # Pixel rows count from the top. Products a hair off a whole number are that number.
            low, high = (lambda x: math.floor(x + 1e-9)), (lambda x: math.ceil(x - 1e-9))
            out.append((max(0, low(u0 * w)), max(0, low((1 - v1) * h)), min(w, high(u1 * w)), min(h, high((1 - v0) * h))))
        return out

    def _form(self, d: Draw, ops: list[Operation], res: dict, edits: dict, added: dict, above: dict) -> Name:
        """A rewritten copy of a form for this one drawing; its name in the resources of what draws it."""
        form = self.file.resolve(d.ref) if d.ref is not None else None
        if form is None:
            raise PdfError("Unsupported", "a form that is no object of its own")
        new = {k: v for k, v in form.dict.items() if k not in ("Filter", "DecodeParms", "Length")}
        if added:
            new["Resources"] = _with(self.file, res, "XObject", added)
        ref = self.file.add(Stream(new | {"Filter": Name("FlateDecode")}, zlib.compress(content.write(_edited(ops, edits)))))
        name = f"{d.name}_f{d.op}"
        above[name] = ref
        return Name(name)

    def _annotations(self) -> None:
        old = self.file.resolve(self.page.dict.get("Annots"))
        if not isinstance(old, list):
            return
        kept = []
        for a in old:
            d = self.file.dict_of(a)
            box = layout.annotation_box(self.doc, self.page, d)
            kind = d.get("Subtype")
            remove = box is not None and self.hit(box, self.areas) or box is None and kind != "Link" or kind == "FileAttachment"
            if self.plan.remove_intersecting_annotations and remove:
                self.report.annotations_removed += 1
            else:
                kept.append(a)
        if len(kept) < len(old):
            if kept:
                self.page.dict["Annots"] = kept
            else:
                self.page.dict.pop("Annots")
            _unlink(self.doc, [a for a in old if a not in kept])

    def _write(self, ops: list[Operation], added: dict[str, Ref]) -> None:
        data = content.write(ops)
        res = self.file.dict_of(self.page.resources)
        if added:
            res = _with(self.file, res, "XObject", added)
        if self.plan.mode == "redact":
            label = self.plan.overlay_text
            data = b"q\n" + data + b"Q\n" * (1 + _open_states(ops)) + self._overlay(label)
            if label is not None:
                font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
                res = _with(self.file, res, "Font", {OVERLAY_FONT: self._shared(font)})
        self.page.dict["Resources"] = res
        self.page.dict["Contents"] = self.file.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(data)))

    def _shared(self, font: dict) -> Ref:
        return next((r for r, v in self.file.objects.items() if v == font), None) or self.file.add(font)

    def _overlay(self, label: str | None) -> bytes:
        """Fills of every quad and a label for every target, in the page's own space."""
        back = layout.inverse(layout.page_matrix(self.page)) or layout.IDENTITY
        n = lambda v: number_text(float(v), 4)
        out = ["q", " ".join(n(c / 255) for c in self.plan.fill) + " rg"]
        for q in self.quads:
            b = layout.box_through(back, q)
            out.append(f"{n(b[0])} {n(b[1])} {n(b[2] - b[0])} {n(b[3] - b[1])} re f")
        if label is not None:
            r, g, b_ = self.plan.fill
            ink = 1 if (0.299 * r + 0.587 * g + 0.114 * b_) / 255 < 0.5 else 0
            shown = label.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").decode("latin-1")
            for t in self.targets:
                x0, y0, _, y1 = t.bounds
                size = min(max(0.6 * (y1 - y0), 4.0), 14.0)
                turn = layout.times((1, 0, 0, 1, x0 + 0.25 * size, y0 + 0.2 * size), back)
                out.append(f"BT /{OVERLAY_FONT} {n(size)} Tf {ink} {ink} {ink} rg {' '.join(n(v) for v in turn)} Tm ({shown}) Tj ET")
        return "\n".join([*out, "Q\n"]).encode("latin-1")


def _push(parts: list, x: Any) -> None:
    """Add a string or number to a TJ array, joined with a neighbour of its kind."""
    if isinstance(x, bytes):
        if x and parts and isinstance(parts[-1], bytes):
            parts[-1] += x
        elif x:
            parts.append(x)
    elif parts and not isinstance(parts[-1], bytes):
        parts[-1] += x
    else:
        parts.append(x)


def _edited(ops: list[Operation], edits: dict[int, list[Operation]]) -> list[Operation]:
    return [x for i, o in enumerate(ops) for x in edits.get(i, [o])]


def _open_states(ops: list[Operation]) -> int:
    """Saved states that are never restored, so that an overlay can be drawn in the page's own."""
    depth = 0
    for o in ops:
        depth = max(0, depth + {"q": 1, "Q": -1}.get(o.op, 0))
    return depth


def _with(file: File, res: dict, kind: str, more: dict) -> dict:
    """Resources with some entries added; neither they nor a shared dictionary of that kind are changed."""
    return res | {kind: dict(file.dict_of(res.get(kind))) | more}


def _pixel(fill: tuple[int, int, int], n: int) -> bytes:
    r, g, b = fill
    if n == 1:
        return bytes([math.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)])
    if n == 3:
        return bytes(fill)
    k = 1 - max(fill) / 255
    ink = lambda v: 0 if k >= 1 else math.floor((1 - v / 255 - k) / (1 - k) * 255 + 0.5)
    return bytes([ink(r), ink(g), ink(b), math.floor(k * 255 + 0.5)])


def _coverage(d: Draw, quads: list[Box]) -> tuple[float, float, float, float] | str | None:
    """The part of the unit square that is covered: None, "full", or (u0, v0, u1, v1)."""
    drawn = layout.box_through(d.ctm, (0.0, 0.0, 1.0, 1.0))
    hits = [q for q in quads if meets(drawn, q)]
    if not hits:
        return None
    back = layout.inverse(d.ctm)
    if back is None:
        return "full"
    us, vs = [], []
    for q in hits:
        part = (max(q[0], drawn[0]), max(q[1], drawn[1]), min(q[2], drawn[2]), min(q[3], drawn[3]))
        b = layout.box_through(back, part)
        us += [min(max(b[0], 0.0), 1.0), min(max(b[2], 0.0), 1.0)]
        vs += [min(max(b[1], 0.0), 1.0), min(max(b[3], 0.0), 1.0)]
        if us[-2] <= EDGE and vs[-2] <= EDGE and us[-1] >= 1 - EDGE and vs[-1] >= 1 - EDGE:
            return "full"
    return min(us), min(vs), max(us), max(vs)


def _unlink(doc: Document, gone: list[Any]) -> None:
    """Take removed annotations out of every other list that leads to them (form fields, popups)."""
    refs = {r for r in gone if isinstance(r, Ref)}

    def clean(v: Any) -> Any:
        if isinstance(v, list):
            return [clean(x) for x in v if x not in refs or not isinstance(x, Ref)]
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if not (isinstance(x, Ref) and x in refs)}
        return v

    for ref, v in doc.file.objects.items():
        if ref in refs or not any(r in refs for r in refs_in(v)):
            continue
        if isinstance(v, Stream):
            v.dict = clean(v.dict)
        elif isinstance(v, dict):
            new = clean(v)
            v.clear()
            v.update(new)
        else:
            doc.file.objects[ref] = clean(v)


def _strip_attachments(doc: Document) -> None:
    """Embedded files, wherever the catalog and annotations name them; other name trees stay."""
    names = doc.file.dict_of(doc.catalog.get("Names"))
    names.pop("EmbeddedFiles", None)
    if not names:
        doc.catalog.pop("Names", None)
    for d in [doc.catalog, *(p.dict for p in doc.pages)]:
        d.pop("AF", None)
    for p in doc.pages:
        old = doc.file.resolve(p.dict.get("Annots"))
        if isinstance(old, list):
            kept = [a for a in old if doc.file.dict_of(a).get("Subtype") != "FileAttachment"]
            if len(kept) < len(old):
                p.dict["Annots"] = kept
                _unlink(doc, [a for a in old if a not in kept])


def _hidden_layers(doc: Document) -> set[Ref]:
    """Layers that the default configuration hides."""
    props = doc.file.dict_of(doc.catalog.get("OCProperties"))
    d = doc.file.dict_of(props.get("D"))
    refs = lambda v: {r for r in doc.file.resolve(v) or [] if isinstance(r, Ref)}
    if d.get("BaseState") in ("OFF", "Unchanged"):
        return refs(props.get("OCGs")) - refs(d.get("ON"))
    return refs(d.get("OFF"))


def _strip_layers(doc: Document, hidden: set[Ref]) -> None:
    """Take hidden sections out of all pages and forms, then make the configuration say that nothing is hidden."""
    file = doc.file
    seen: set[int] = set()

    def is_hidden(v: Any) -> bool:
        if isinstance(v, Ref) and v in hidden:
            return True
        d = file.dict_of(v)
        if d.get("Type") != "OCMD":
            return False
        named = d.get("OCGs")
        group = file.resolve(named) if not isinstance(named, Ref) or isinstance(file.resolve(named), list) else [named]
        group = [g for g in (group if isinstance(group, list) else [named]) if isinstance(g, Ref)]
        off = [g in hidden for g in group]
        policy = str(d.get("P", "AnyOn"))
        shown = {"AnyOn": not all(off), "AllOn": not any(off), "AnyOff": any(off), "AllOff": all(off)}.get(policy, True)
        return bool(group) and not shown

    def cleaned(ops: list[Operation], res: dict) -> list[Operation]:
        out, depth, hide = [], 0, 0
        props, objects = file.dict_of(res.get("Properties")), file.dict_of(res.get("XObject"))
        for o in ops:
            if o.op in ("BDC", "BMC"):
                depth += 1
                if not hide and o.op == "BDC" and o.args[:1] == [Name("OC")] and len(o.args) > 1:
                    value = props.get(o.args[1]) if isinstance(o.args[1], Name) else o.args[1]
                    hide = depth if is_hidden(value) else 0
            if not hide:
                thing = file.resolve(objects.get(o.args[0])) if o.op == "Do" and o.args else None
                if isinstance(thing, Stream):
                    if is_hidden(thing.dict.get("OC")):
                        continue
                    if thing.dict.get("Subtype") == "Form" and id(thing) not in seen:
                        seen.add(id(thing))
                        inner = content.parse(filters.decode(thing.data, thing.dict, file.resolve))
                        own = file.dict_of(thing.dict.get("Resources")) or res
                        rewrite = cleaned(inner, own)
                        if rewrite != inner:
                            thing.dict = {k: v for k, v in thing.dict.items() if k not in ("Filter", "DecodeParms")} | {"Filter": Name("FlateDecode")}
                            thing.data = zlib.compress(content.write(rewrite))
                out.append(o)
            if o.op == "EMC":
                if hide == depth:
                    hide = 0
                depth = max(0, depth - 1)
        return out

    for p in doc.pages:
        ops = content.parse(content.page_data(file, p.dict.get("Contents")))
        new = cleaned(ops, file.dict_of(p.resources))
        if new != ops:
            p.dict["Contents"] = file.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(content.write(new))))
        old = file.resolve(p.dict.get("Annots"))
        if isinstance(old, list):
            p.dict["Annots"] = [a for a in old if not is_hidden(file.dict_of(a).get("OC"))]
    props = file.dict_of(doc.catalog.get("OCProperties"))
    d = file.dict_of(props.get("D"))
    for k in ("OFF", "BaseState", "AS"):
        d.pop(k, None)
    props.pop("Configs", None)
