"""Interpretation of a page: glyphs, painted paths, images and forms, each with its place; and search."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate, repeat
from typing import Any

from veilframe.operators import visual
from veilframe.pdf import content, filters, fonts
from veilframe.pdf.content import Operation
from veilframe.pdf.model import File, PdfError, Ref, Stream, as_number
from veilframe.pdf.reader import Document, Page, rectangle

Matrix = tuple[float, float, float, float, float, float]
Box = tuple[float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Forms within forms that are followed.
MAX_FORMS = 16
#: Paint operators. Fixed values.
PAINTS = frozenset("S s f F f* B B* b b* n".split())


def times(m: Matrix, n: Matrix) -> Matrix:
    """m first, then n."""
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


def point(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def inverse(m: Matrix) -> Matrix | None:
    det = m[0] * m[3] - m[1] * m[2]
    if abs(det) < 1e-12:
        return None
    return (m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)


def hull(points: list[tuple[float, float]]) -> Box:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def box_through(m: Matrix, b: Box) -> Box:
    return hull([point(m, x, y) for x in (b[0], b[2]) for y in (b[1], b[3])])


def meets(a: Box, b: Box) -> bool:
    return max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])


def page_matrix(page: Page) -> Matrix:
    w, h = page.crop[2] - page.crop[0], page.crop[3] - page.crop[1]
    turn: dict[int, Matrix] = {90: (0, 1, -1, 0, h, 0), 180: (-1, 0, 0, -1, w, h), 270: (0, -1, 1, 0, 0, w)}
    return times((1, 0, 0, 1, -page.crop[0], -page.crop[1]), turn.get(page.rotate % 360, IDENTITY))


@dataclass(slots=True)
class Glyph:
    """A character as shown. ``path`` says in which stream: the operations that led to it, () for the page."""

    ch: str
    box: Box
    quad: list[tuple[float, float]] | None  # corners where they are not the box's
    path: tuple[int, ...]
    op: int
    operand: int
    element: int | None
    start: int
    end: int
    visible: bool
    kern: float  # what it advances, in thousandths of the font size


@dataclass(slots=True)
class Run:
    """The glyphs of a shown string that runs to the right along an upright line, a byte and a character each; glyphs are made when asked for."""

    text: str
    path: tuple[int, ...]
    op: int
    operand: int
    element: int | None
    visible: bool
    low: float
    high: float
    scale: float  # from text space to the page
    shift: float
    advances: list[float] | float  # of each glyph, or of all, in text space
    kerns: list[float] | float
    _edges: list[float] | None = None

    @property
    def edges(self) -> list[float]:
        """Where each glyph begins, and where the last one ends."""
        if self._edges is None:
            steps = self.advances if isinstance(self.advances, list) else repeat(self.advances, len(self.text))
            self._edges = [self.scale * x + self.shift for x in accumulate(steps, initial=0.0)]
        return self._edges

    def box(self, k: int) -> Box:
        return self.edges[k], self.low, self.edges[k + 1], self.high

    def near(self, x0: float, x1: float) -> range:
        """Glyphs that may lie between ``x0`` and ``x1``, and perhaps some beside them."""
        return range(max(0, bisect_left(self.edges, x0 - 1e-6) - 1), min(len(self.text), bisect_right(self.edges, x1 + 1e-6)))

    def glyph(self, k: int) -> Glyph:
        return Glyph(self.text[k], self.box(k), None, self.path, self.op, self.operand, self.element, k, k + 1, self.visible, self.kerns[k] if isinstance(self.kerns, list) else self.kerns)


@dataclass
class Item:
    text: str
    box: Box
    char_start: int
    char_end: int


@dataclass
class Draw:
    """An image, an inline image (no name) or a form that is drawn, with the matrix it is drawn by."""

    kind: str
    path: tuple[int, ...]
    op: int
    name: str | None
    ref: Ref | None
    ctm: Matrix


@dataclass
class Layout:
    parts: list[Glyph | Run] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    paints: list[tuple[tuple[int, ...], int, Box]] = field(default_factory=list)
    draws: list[Draw] = field(default_factory=list)
    streams: dict[tuple[int, ...], tuple[list[Operation], dict]] = field(default_factory=dict)  # operations and resources
    text: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def page_text(self) -> str:
        return "".join(self.text)

    @cached_property
    def glyphs(self) -> list[Glyph]:
        return [g for p in self.parts for g in ((p,) if isinstance(p, Glyph) else map(p.glyph, range(len(p.text))))]

    @property
    def codes(self) -> int:
        """How many codes are shown; one may stand for several characters."""
        single = {(p.path, p.op, p.operand, p.element, p.start, p.end) for p in self.parts if isinstance(p, Glyph)}
        return len(single) + sum(len(p.text) for p in self.parts if isinstance(p, Run))

    def hits(self, boxes: list[Box], least: float = 1e-9) -> list[Glyph]:
        """Glyphs that meet some box. One without width or height still lies somewhere: each is ``least`` wide and high, or more."""
        out = []
        for p in self.parts:
            if isinstance(p, Glyph):
                b = p.box
                if any(meets((b[0], b[1], max(b[2], b[0] + least), max(b[3], b[1] + least)), q) for q in boxes):
                    out.append(p)
                continue
            high = max(p.high, p.low + least)
            level = [q for q in boxes if max(p.low, q[1]) < min(high, q[3])]
            if level:
                e = p.edges
                found = {k for q in level for k in p.near(q[0], q[2]) if max(e[k], q[0]) < min(max(e[k + 1], e[k] + least), q[2])}
                out += map(p.glyph, sorted(found))
        return out


@dataclass
class _State:
    ctm: Matrix
    width: float = 1.0
    font: fonts.Font | None = None
    size: float = 12.0
    char: float = 0.0
    word: float = 0.0
    leading: float = 0.0
    rise: float = 0.0
    scale: float = 100.0
    mode: int = 0

    def copy(self) -> _State:
        return _State(**self.__dict__)


class Interpreter:
    """Reads a page's operations once and notes everything that has a place on the page."""

    def __init__(self, file: File, page_to_user: Matrix):
        self.file, self.to_page, self.out = file, page_to_user, Layout()
        self.length, self.pending = 0, False
        self.loaded: dict[Any, fonts.Font] = {}

    def run(self, ops: list[Operation], resources: Any, ctm: Matrix = IDENTITY, path: tuple[int, ...] = (), trail: tuple = (), parent: dict | None = None) -> None:
        res = self.file.dict_of(resources)
        self.out.streams[path] = (ops, res)
        state, stack = _State(ctm), []
        tm = line = IDENTITY
        segments: list[tuple[float, float]] = []
        for i, o in enumerate(ops):
            a, op = o.args, o.op
            n = [as_number(x) for x in a] if op not in ("BI",) else []
            need = _NEEDS.get(op)
            if need and (len(n) != need or None in n):
                raise PdfError("Corrupt", f"{op} at operation {i} needs {need} numbers")
            if op == "q":
                stack.append(state.copy())
            elif op == "Q":
                state = stack.pop() if stack else state  # one too many changes nothing
            elif op == "cm":
                state.ctm = times(tuple(n), state.ctm)
            elif op == "w":
                state.width = n[0]
            elif op == "gs":
                g = self.file.dict_of(self._look(res, parent, "ExtGState", a[0] if a else None))
                f = self.file.resolve(g.get("Font"))
                if isinstance(f, list) and len(f) == 2:
                    state.font, state.size = self._font(f[0]), as_number(self.file.resolve(f[1]), 12.0)
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf":
                found = self._look(res, parent, "Font", a[0] if a else None)
                state.font, state.size = (self._font(found) if found is not None else None), as_number(a[1] if len(a) > 1 else None, 12.0)
            elif op in _TEXT_STATE:
                setattr(state, _TEXT_STATE[op], int(n[0]) if op == "Tr" else n[0])
            elif op == "Tm":
                tm = line = tuple(n)
            elif op in ("Td", "TD"):
                if op == "TD":
                    state.leading = -n[1]
                tm = line = times((1, 0, 0, 1, n[0], n[1]), line)
                self._break(op == "TD" or n[1] != 0)
            elif op == "T*":
                tm = line = times((1, 0, 0, 1, 0, -state.leading), line)
                self._break(True)
            elif op in ("Tj", "'", '"', "TJ"):
                if op == '"':
                    if len(a) != 3 or None in n[:2]:
                        raise PdfError("Corrupt", f"operands of the operator at {i}")
                    state.word, state.char = n[0], n[1]
                if op in ("'", '"'):
                    tm = line = times((1, 0, 0, 1, 0, -state.leading), line)
                    self._break(True)
                shown = a[-1] if a else None
                for k, part in enumerate(shown if op == "TJ" and isinstance(shown, list) else [shown]):
                    if isinstance(part, bytes):
                        tm = self._show(part, state, tm, path, i, len(a) - 1, k if op == "TJ" else None)
                    elif op == "TJ" and (x := as_number(part)) is not None:
                        tm = times((1, 0, 0, 1, -x / 1000 * state.size * state.scale / 100, 0), tm)
                    else:
                        raise PdfError("Corrupt", f"{op} at operation {i} shows no string")
            elif op in ("m", "l"):
                segments.append((n[0], n[1]))
            elif op in ("c", "v", "y"):
                segments += list(zip(n[::2], n[1::2]))
            elif op == "re":
                segments += [(n[0], n[1]), (n[0] + n[2], n[1]), (n[0] + n[2], n[1] + n[3]), (n[0], n[1] + n[3])]
            elif op in PAINTS:
                if segments and op != "n":
                    b, half = hull(segments), state.width / 2
                    grown = (b[0] - half, b[1] - half, b[2] + half, b[3] + half)
                    self.out.paints.append((path, i, box_through(times(state.ctm, self.to_page), grown)))
                segments = []
            elif op == "BI":
                self.out.draws.append(Draw("inline", path, i, None, None, times(state.ctm, self.to_page)))
            elif op == "Do":
                self._do(a, i, state, res, parent, path, trail)

    def _look(self, res: dict, parent: dict | None, kind: str, name: Any) -> Any:
        """A resource by name: the stream's own first, then those of what drew it."""
        for r in (res, parent or {}):
            d = self.file.dict_of(r.get(kind))
            if name in d:
                return d[name]
        return None

    def _font(self, value: Any) -> fonts.Font:
        key = value if isinstance(value, Ref) else id(value)
        if key not in self.loaded:
            self.loaded[key] = fonts.load(self.file, value)
        return self.loaded[key]

    def _do(self, a: list, i: int, state: _State, res: dict, parent: dict | None, path: tuple[int, ...], trail: tuple) -> None:
        name = a[0] if a else None
        ref = self._look(res, parent, "XObject", name)
        thing = self.file.resolve(ref)
        if not isinstance(thing, Stream):
            raise PdfError("MissingObject", f"XObject {name} is not there")
        kind = thing.dict.get("Subtype")
        ref = ref if isinstance(ref, Ref) else None
        if kind == "Image":
            self.out.draws.append(Draw("image", path, i, str(name), ref, times(state.ctm, self.to_page)))
            return
        if kind != "Form":
            raise PdfError("Unsupported", f"XObject type {kind}")
        self.out.draws.append(Draw("form", path, i, str(name), ref, times(state.ctm, self.to_page)))
        if ref in trail:
            return
        if len(trail) >= MAX_FORMS:
            self.out.warnings.append(f"forms deeper than {MAX_FORMS} are left alone")
            return
        m = self.file.resolve(thing.dict.get("Matrix"))
        matrix = tuple(as_number(self.file.resolve(x), 0.0) for x in m) if isinstance(m, list) and len(m) == 6 else IDENTITY
        ops = content.parse(filters.decode(thing.data, thing.dict, self.file.resolve))
        inner = self.file.dict_of(thing.dict.get("Resources"))
        self.run(ops, inner, times(matrix, state.ctm), (*path, i), (*trail, ref), res if parent is None else parent | res)

    def _break(self, yes: bool) -> None:
        self.pending = self.pending or (yes and self.length > 0)  # nothing shown yet: no line to end

    def _line(self) -> None:
        """Ends the line before what is shown next, if one is to end."""
        if self.pending:
            self.out.text.append("\n")
            self.length += 1
        self.pending = False

    def _show(self, raw: bytes, s: _State, tm: Matrix, path: tuple[int, ...], op: int, operand: int, element: int | None) -> Matrix:
        if s.font is None:
            raise PdfError("Unsupported", "text without a font")
        out, start, boxes, shown = self.out, None, [], []
        m = times(times(tm, s.ctm), self.to_page)
        low, x = s.rise - 0.12 * s.size, 0.0
        high = low + 0.8 * s.size
        upright = m[1] == 0 and m[2] == 0
        y0, y1 = sorted((m[3] * low + m[5], m[3] * high + m[5])) if upright else (0.0, 0.0)
        if upright and m[0] > 0 and (plain := s.font.plain(raw)) is not None:
            shown_text, widths = plain
            advances, kerns, x = _advances(shown_text, widths, s)
            if advances is not None:
                run = Run(shown_text, path, op, operand, element, s.mode != 3, y0, y1, m[0], m[4], advances, kerns)
                if raw:
                    out.parts.append(run)
                if raw and run.visible:
                    self._line()
                    out.items.append(Item(shown_text, (m[4], y0, m[0] * x + m[4], y1), self.length, self.length + len(shown_text)))
                    out.text.append(shown_text)
                    self.length += len(shown_text)
                return times((1, 0, 0, 1, x, 0), tm)
            x = 0.0
        for text, width, first, last in s.font.decode(raw):
            spacing = s.char + (s.word if text == " " else 0.0)
            advance = (width / 1000 * s.size + spacing) * s.scale / 100
            right = x + max(advance, 0.0)
            if upright:
                x0, x1 = m[0] * x + m[4], m[0] * right + m[4]
                box, quad = ((x0, y0, x1, y1) if x0 <= x1 else (x1, y0, x0, y1)), None
            else:
                quad = [point(m, *p) for p in ((x, low), (right, low), (right, high), (x, high))]
                box = hull(quad)
            visible = s.mode != 3
            kern = width + (1000 * spacing / s.size if s.size else 0.0)
            for k, ch in enumerate(text or fonts.UNKNOWN):
                out.parts.append(Glyph(ch, box, quad, path, op, operand, element, first, last, visible, kern if k == 0 else 0.0))
            if visible:
                if start is None:
                    self._line()
                    start = self.length
                out.text.append(text)
                self.length += len(text)
                shown.append(text)
                boxes.append(box)
            x += advance
        tm = times((1, 0, 0, 1, x, 0), tm)
        if boxes:
            corners = [(b[0], b[1]) for b in boxes] + [(b[2], b[3]) for b in boxes]
            out.items.append(Item("".join(shown), hull(corners), start, self.length))
        return tm


def _advances(text: str, widths: list[float] | float, s: _State) -> tuple[list[float] | float | None, list[float] | float, float]:
    """Advance and kern of each character, or of all, and the advance of all; no advance where one leads to the left."""
    if isinstance(widths, list) or s.word and " " in text:
        spaced = zip(text, widths if isinstance(widths, list) else repeat(widths))
        of = {}
        keys = list(spaced)
        for c, w in set(keys):
            spacing = s.char + (s.word if c == " " else 0.0)
            of[c, w] = (w / 1000 * s.size + spacing) * s.scale / 100, w + (1000 * spacing / s.size if s.size else 0.0)
        if any(not a >= 0 for a, _ in of.values()):
            return None, 0.0, 0.0
        advances = [of[k][0] for k in keys]
        total = 0.0
        for a in advances:
            total += a
        return advances, [of[k][1] for k in keys], total
    a, kern = (widths / 1000 * s.size + s.char) * s.scale / 100, widths + (1000 * s.char / s.size if s.size else 0.0)
    if not a >= 0:
        return None, 0.0, 0.0
    if a.is_integer() and a * len(text) < 2**53:
        return a, kern, a * len(text)
    total = 0.0
    for total in accumulate(repeat(a, len(text)), initial=0.0):
        pass
    return a, kern, total


_NEEDS = {"cm": 6, "w": 1, "Tm": 6, "Td": 2, "TD": 2, "m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4, "Tc": 1, "Tw": 1, "TL": 1, "Tr": 1, "Ts": 1, "Tz": 1}
_TEXT_STATE = {"Tc": "char", "Tw": "word", "TL": "leading", "Tr": "mode", "Ts": "rise", "Tz": "scale"}


def layout(doc: Document, index: int, ops: list[Operation] | None = None) -> Layout:
    page = doc.page(index)
    if ops is None:
        ops = content.parse(content.page_data(doc.file, page.dict.get("Contents")))
    run = Interpreter(doc.file, page_matrix(page))
    run.run(ops, page.resources)
    return run.out


@dataclass
class Match:
    text: str
    page: int
    quads: list[Box]


_BLANK = re.compile(r"[\t-\r \x85\xa0  -     　]")


def display(found: Layout) -> tuple[str, list[int | None]]:
    """The page's text as a reader sees it, and the glyph of each character (none for what was put between)."""
    order = sorted((k for k, g in enumerate(found.glyphs) if g.visible), key=lambda k: (-(found.glyphs[k].box[1] + found.glyphs[k].box[3]) / 2, found.glyphs[k].box[0]))
    boxes = [found.glyphs[k].box for k in order]
    numbers = visual.cluster([(b[1] + b[3]) / 2 for b in boxes], [b[3] - b[1] for b in boxes], [b[0] for b in boxes])
    lines: dict[int, list[int]] = {}
    for k, line in zip(order, numbers):
        lines.setdefault(line, []).append(k)
    centre = lambda ks: sum((found.glyphs[k].box[1] + found.glyphs[k].box[3]) / 2 for k in ks) / len(ks)
    text, owner = [], []
    for ks in sorted(lines.values(), key=centre, reverse=True):
        if text:
            text.append("\n")
            owner.append(None)
        before: Box | None = None
        for k in sorted(ks, key=lambda k: found.glyphs[k].box[0]):
            b = found.glyphs[k].box
            if before and b[0] - before[2] > 0.3 * max(min(before[3] - before[1], b[3] - b[1]), 1.0):
                text.append(" ")
                owner.append(None)
            text.append(found.glyphs[k].ch)
            owner.append(k)
            before = b
    return "".join(text), owner


def _rows(found: Layout) -> list[list[Run]] | None:
    """The page's lines from top to bottom where its runs alone tell them, as ``display`` would have them; else None.

    So it is where the runs of a line stand one behind another, and lines further apart than glyphs of one line may be.
    """
    rows: list[list[Run]] = []
    tall = 1.0
    for p in found.parts:
        if not p.visible:
            continue
        if not isinstance(p, Run):
            return None
        if rows and (p.low, p.high) == (rows[-1][0].low, rows[-1][0].high):
            before = rows[-1][-1]
            if p.shift < before.edges[-2]:
                return None
            rows[-1].append(p)
        else:
            rows.append([p])
            tall = max(tall, p.high - p.low)
    rows.sort(key=lambda r: -(r[0].low + r[0].high) / 2)
    centres = [(r[0].low + r[0].high) / 2 for r in rows]
    return rows if all(a - b > 0.1 * tall for a, b in zip(centres, centres[1:])) else None


def _run_text(rows: list[list[Run]]) -> tuple[str, list[int], list[Run]]:
    """What ``display`` gives for these lines; where in it each run begins, and the runs."""
    text: list[str] = []
    starts: list[int] = []
    runs: list[Run] = []
    at = 0
    for row in rows:
        if text:
            text.append("\n")
            at += 1
        before: Run | None = None
        for r in row:
            if before and r.edges[0] - before.edges[-1] > 0.3 * max(r.high - r.low, 1.0):
                text.append(" ")
                at += 1
            text.append(r.text)
            starts.append(at)
            runs.append(r)
            at += len(r.text)
            before = r
    return "".join(text), starts, runs


def _search_runs(rows: list[list[Run]], q: str, page: int) -> list[Match] | None:
    """``search`` over runs; None where letters change their number in lower case."""
    shown, starts, runs = _run_text(rows)
    low = shown.lower()
    if len(low) != len(shown) or "Σ" in shown:  # which has two small letters, by what follows
        return None
    out = []
    if all(w in low for w in q.split(" ")):
        for m in re.finditer(f"{_BLANK.pattern}+".join(map(re.escape, q.split(" "))), low):
            boxes: list[Box] = []
            for n in range(bisect_right(starts, m.start()) - 1, bisect_left(starts, m.end())):
                r = runs[n]
                for k in range(max(0, m.start() - starts[n]), min(len(r.text), m.end() - starts[n])):
                    if (b := r.box(k)) not in boxes[-1:]:
                        boxes.append(b)
            out.append(Match(shown[m.start() : m.end()].strip(), page, visual.merge(boxes)))
    return out


def search(found: Layout, query: str, page: int = 0) -> list[Match]:
    """Matches from left to right, without overlap; any case, any run of white space for a space."""
    norm = lambda t: "".join(c.lower() for c in t)
    q = re.sub(f"{_BLANK.pattern}+", " ", norm(query)).strip(" ")
    if not q:
        return []
    rows = _rows(found)
    matches = None if rows is None else _search_runs(rows, q, page)
    return _search_glyphs(found, q, page) if matches is None else matches


def _search_glyphs(found: Layout, q: str, page: int) -> list[Match]:
    shown, owner = display(found)
    index, where, blank = [], [], False
    for k, ch in enumerate(shown):
        if _BLANK.match(ch):
            if not blank:
                index.append(" ")
                where.append(k)
            blank = True
            continue
        blank = False
        low = ch.lower()
        index.append(low)
        where += [k] * len(low)
    text, out, at = "".join(index), [], 0
    while (at := text.find(q, at)) >= 0:
        span = range(where[at], where[at + len(q) - 1] + 1)
        boxes: list[Box] = []
        for k in dict.fromkeys(owner[k] for k in span if owner[k] is not None):
            if found.glyphs[k].box not in boxes[-1:]:
                boxes.append(found.glyphs[k].box)
        if boxes:
            out.append(Match(shown[span[0] : span[-1] + 1].strip(), page, visual.merge(boxes)))
        at += len(q)
    return out


def annotation_box(doc: Document, page: Page, d: dict) -> Box | None:
    r = rectangle(doc.file, d.get("Rect"))
    return box_through(page_matrix(page), r) if r else None
