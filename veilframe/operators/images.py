"""Images under targets: how much of a draw is covered, and the pixels to paint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.geometry import Matrix, Rect, luminance

EDGE = 1e-6


def coverage(ctm: Matrix, target: Rect, width: Column, height: Column) -> dict[str, Column]:
    """``hit`` (none, partial, full) of a draw of the unit square under ``ctm``, and the covered pixels px0, py0, px1, py1.

    Corners of the target clipped to the drawn box go through the inverse matrix; pixel rows count from the top.
    """
    drawn = ctm.rect(Rect.of(0.0, 0.0, 1.0, 1.0))
    part = target.clip(drawn)
    inverse = ctm.inverse()
    us, vs = zip(*[inverse.point(x, y) for x in (part.x0, part.x1) for y in (part.y0, part.y1)])
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    u0, u1, v0, v1 = unit(F.least(*us)), unit(F.greatest(*us)), unit(F.least(*vs)), unit(F.greatest(*vs))
    full = (u0 <= EDGE) & (v0 <= EDGE) & (u1 >= 1 - EDGE) & (v1 >= 1 - EDGE)
    hit = F.when(~target.intersects(drawn), "none").when(full | inverse.a.isNull(), "full").otherwise("partial")
    px = {"px0": F.floor(u0 * width), "py0": F.floor((1 - v1) * height), "px1": F.ceil(u1 * width), "py1": F.ceil((1 - v0) * height)}
    return {"hit": hit} | {k: F.when(hit == "partial", v).cast("long") for k, v in px.items()}


def pixel_template(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The bytes of one filled pixel in gray, RGB and CMYK."""
    k = 1 - F.greatest(r, g, b) / 255.0
    ink = lambda v: F.when(k >= 1.0, 0).otherwise(F.floor(((1 - v / 255.0 - k) / (1 - k)) * 255.0 + 0.5))
    return {
        "gray": F.floor(luminance(r, g, b) + 0.5).cast("long"),
        "cyan": ink(r).cast("long"), "magenta": ink(g).cast("long"), "yellow": ink(b).cast("long"), "black": F.floor(k * 255.0 + 0.5).cast("long"),
    }
