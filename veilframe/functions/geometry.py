"""Rectangles, quads and matrices as column expressions.

A rectangle is four columns or numbers (x0, y0, x1, y1) with x0 <= x1 and y0 <= y1 once
normalised; a matrix is six (a, b, c, d, e, f) in the row-vector convention:
(x, y) -> (a x + c y + e, b x + d y + f).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


@dataclass(frozen=True)
class Rect:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, x0, y0, x1, y1) -> Rect:
        return cls(_c(x0), _c(y0), _c(x1), _c(y1))

    @classmethod
    def named(cls, prefix: str = "") -> Rect:
        return cls.of(*(f"{prefix}{k}" for k in ("x0", "y0", "x1", "y1")))

    @classmethod
    def sized(cls, x, y, width, height) -> Rect:
        """From a corner and a size of either sign."""
        x, y, w, h = map(_c, (x, y, width, height))
        return cls(F.least(x, x + w), F.least(y, y + h), F.greatest(x, x + w), F.greatest(y, y + h))

    def intersects(self, other: Rect) -> Column:
        """Strictly: touching edges do not count."""
        return (
            (F.greatest(self.x0, other.x0) < F.least(self.x1, other.x1))
            & (F.greatest(self.y0, other.y0) < F.least(self.y1, other.y1))
        )

    def contains(self, x, y) -> Column:
        """Edges count."""
        return _c(x).between(self.x0, self.x1) & _c(y).between(self.y0, self.y1)

    def union(self, other: Rect) -> Rect:
        return Rect(F.least(self.x0, other.x0), F.least(self.y0, other.y0), F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1))

    def clip(self, other: Rect) -> Rect:
        """The common part, null where there is none."""
        hit = self.intersects(other)
        on = lambda v: F.when(hit, v)
        return Rect(on(F.greatest(self.x0, other.x0)), on(F.greatest(self.y0, other.y0)), on(F.least(self.x1, other.x1)), on(F.least(self.y1, other.y1)))

    def quad(self) -> Column:
        """Corners from the lower left, counter-clockwise."""
        p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        return F.array(p(self.x0, self.y0), p(self.x1, self.y0), p(self.x1, self.y1), p(self.x0, self.y1))

    def bounds(self) -> dict[str, Column]:
        """Aggregates of the union of many."""
        return {"x0": F.min(self.x0), "y0": F.min(self.y0), "x1": F.max(self.x1), "y1": F.max(self.y1)}

    def columns(self, prefix: str = "") -> list[Column]:
        return [v.alias(f"{prefix}{k}") for k, v in (("x0", self.x0), ("y0", self.y0), ("x1", self.x1), ("y1", self.y1))]


def quad_bounds(quad: Column) -> Rect:
    """Bounding box of an array of points."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return Rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def well_formed(quads: Column) -> Column:
    """The quads of an array that have four points with both coordinates."""
    there = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"].cast("double")) & ~F.isnan(p["y"].cast("double"))
    return F.filter(quads, lambda q: (F.size(q) == 4) & F.forall(q, lambda p: p.isNotNull() & there(p)))


@dataclass(frozen=True)
class Matrix:
    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    @classmethod
    def of(cls, *v) -> Matrix:
        return cls(*map(_c, v))

    @classmethod
    def identity(cls) -> Matrix:
        return cls.of(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    @classmethod
    def translate(cls, x, y) -> Matrix:
        return cls.of(1.0, 0.0, 0.0, 1.0, x, y)

    @classmethod
    def scale(cls, x, y) -> Matrix:
        return cls.of(x, 0.0, 0.0, y, 0.0, 0.0)

    @classmethod
    def rotate(cls, degrees) -> Matrix:
        """Quarter turns; any other angle is the identity."""
        r = F.pmod(_c(degrees), F.lit(360))
        pick = lambda q0, q90, q180, q270: F.when(r == 90, q90).when(r == 180, q180).when(r == 270, q270).otherwise(q0)
        return cls.of(pick(1.0, 0.0, -1.0, 0.0), pick(0.0, 1.0, 0.0, -1.0), pick(0.0, -1.0, 0.0, 1.0), pick(1.0, 0.0, -1.0, 0.0), 0.0, 0.0)

    def then(self, m: Matrix) -> Matrix:
        """This first, then ``m``."""
        return Matrix(
            self.a * m.a + self.b * m.c, self.a * m.b + self.b * m.d, self.c * m.a + self.d * m.c,
            self.c * m.b + self.d * m.d, self.e * m.a + self.f * m.c + m.e, self.e * m.b + self.f * m.d + m.f,
        )

    def inverse(self) -> Matrix:
        """Null where the determinant is nearly zero."""
        det = self.a * self.d - self.b * self.c
        ok = lambda v: F.when(F.abs(det) >= 1e-12, v / det)
        return Matrix(
            ok(self.d), ok(-self.b), ok(-self.c), ok(self.a),
            ok(self.c * self.f - self.d * self.e), ok(self.b * self.e - self.a * self.f),
        )

    def point(self, x, y) -> tuple[Column, Column]:
        x, y = _c(x), _c(y)
        return self.a * x + self.c * y + self.e, self.b * x + self.d * y + self.f

    def quad(self, quad: Column) -> Column:
        """Each point of an array of points, transformed."""

        def moved(p: Column) -> Column:
            x, y = self.point(p["x"], p["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform(quad, moved)

    def rect(self, r: Rect) -> Rect:
        """Bounding box of the transformed rectangle."""
        corners = [self.point(x, y) for x in (r.x0, r.x1) for y in (r.y0, r.y1)]
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        return Rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def page_size(width, height, rotate) -> tuple[Column, Column]:
    """Width and height as a reader sees them."""
    turned = F.pmod(_c(rotate), F.lit(360)).isin(90, 270)
    return F.when(turned, _c(height)).otherwise(_c(width)), F.when(turned, _c(width)).otherwise(_c(height))


def page_transform(crop: Rect, rotate) -> Matrix:
    """From page space to the space whose origin is the lower left corner a reader sees."""
    w, h = crop.x1 - crop.x0, crop.y1 - crop.y0
    r = F.pmod(_c(rotate), F.lit(360))
    back = Matrix.translate(F.when(r == 90, h).when(r == 180, w).otherwise(0.0), F.when(r == 180, h).when(r == 270, w).otherwise(0.0))
    return Matrix.translate(-crop.x0, -crop.y0).then(Matrix.rotate(r)).then(back)


def rect_from_top_left(x, y, width, height, page_height) -> Rect:
    """A rectangle drawn with y growing downwards, in page space."""
    y0 = _c(page_height) - _c(y) - _c(height)
    return Rect.sized(x, y0, width, height)


def luminance(r, g, b) -> Column:
    """BT.601, of 0..255 channels."""
    return 0.299 * _c(r) + 0.587 * _c(g) + 0.114 * _c(b)
