"""Visual order: lines, display strings and merged boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster(cy: list[float], height: list[float], x: list[float]) -> list[int]:
    """Line number of each glyph, in the order given: first fit over the lines opened so far.

    Glyphs come from top to bottom, then left to right. One joins the first line whose
    anchor is within a tenth of the larger height of its centre and that does not lie to its right.
    """
    anchors: list[float] = []
    tall: list[float] = []
    right: list[float] = []
    out = []
    alive, reach = 0, 0.10 * max([1.0, *height])
    for c, h, left in zip(cy, height, x):
        place = -1
        for k in range(alive, len(anchors)):
            if abs(c - anchors[k]) + 1e-6 < 0.10 * max(tall[k], h) and left + 1.0 >= right[k]:
                place = k
                break
        if place < 0:
            place = len(anchors)
            anchors.append(c)
            tall.append(max(h, 1.0))
            right.append(left)
        else:
            tall[place], right[place] = max(tall[place], h), left
        # Lines far above can take no later glyph, which all lie lower.
        while alive < len(anchors) and anchors[alive] - c > reach:
            alive += 1
        out.append(place)
    return out


def visual_lines(glyphs: DataFrame) -> DataFrame:
    """``line`` of each glyph (doc_id, page_index, x0, y0, x1, y1); a page is one group."""

    def page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cy=(pdf.y0 + pdf.y1) / 2).sort_values(["cy", "x0", "x1"], ascending=[False, True, True], kind="stable")
        pdf["line"] = cluster(pdf.cy.tolist(), (pdf.y1 - pdf.y0).tolist(), pdf.x0.tolist())
        return pdf[["doc_id", "page_index", "x0", "y0", "x1", "y1", "line"]]

    g = glyphs.select("doc_id", "page_index", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    return g.groupBy("doc_id", "page_index").applyInPandas(page, "doc_id long, page_index long, x0 double, y0 double, x1 double, y1 double, line int")


def with_gaps(glyphs: DataFrame, line: list[str], order: list[str], height: str = "h") -> DataFrame:
    """``space_before``: whether the gap to the glyph before on its line counts as a space."""
    w = Window.partitionBy(*line).orderBy(*order)
    gap = F.col("x0") - F.lag("x1").over(w)
    least = F.least(F.lag(height).over(w), F.col(height))
    return glyphs.withColumn("space_before", F.coalesce(gap > 0.3 * F.greatest(least, F.lit(1)), F.lit(False)))


def coalesce_boxes(boxes: DataFrame, line: list[str], reach: Column) -> DataFrame:
    """Boxes of a line merged where the gap to all before is at most ``reach``: line, island, x0, x1, n."""
    w = Window.partitionBy(*line).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = boxes.withColumn("__new", F.when(F.col("x0") - before <= reach, 0).otherwise(1))
    numbered = opened.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*line, "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def merge(rects: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Ordered merge of the boxes (x0, y0, x1, y1) of one match: neighbours on a line with little between them."""
    out: list[tuple[float, float, float, float]] = []
    for r in rects:
        if out and _near(out[-1], r):
            a = out[-1]
            out[-1] = (min(a[0], r[0]), min(a[1], r[1]), max(a[2], r[2]), max(a[3], r[3]))
        else:
            out.append(r)
    return out


def _near(a: tuple, b: tuple) -> bool:
    least = max(min(a[3] - a[1], b[3] - b[1]), 1.0)
    overlap = min(a[3], b[3]) - max(a[1], b[1])
    gap = max(0.0, b[0] - a[2], a[0] - b[2])
    return overlap >= 0.45 * least and gap <= 0.8 * least


def display(lines: Iterator[list[tuple[str, float, float, float]]]) -> str:
    """Display text of lines of (character, x0, x1, height), with spaces for wide gaps."""
    out = []
    for line in lines:
        text, before = [], None
        for ch, x0, x1, h in line:
            if before and x0 - before[0] > 0.3 * max(min(before[1], h), 1.0):
                text.append(" ")
            text.append(ch)
            before = (x1, h)
        out.append("".join(text))
    return "\n".join(out)
