"""The text layer of plain documents: pages, lines, items and positioned glyphs.

A document's lines are dealt out to pages of ``LINES``; line n of a page is one show
operation at (72, 720 - 12 n) pt in size 10 with 6 pt advances. Coordinates are whole
tenths of a point. Pages are cut inside the row, so no operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.geometry import Rect
from veilframe.functions.text import let

LINES = 50
LEFT, TOP, LEADING, ADVANCE = 720, 7200, 120, 60
DESCENT, HEIGHT = 12, 80
WIDTH_UNITS, SIZE_UNITS = 600, 1000


def baseline(line: Column) -> Column:
    return F.lit(TOP) - LEADING * line


def run_box(line: Column, first: Column, last: Column) -> Rect:
    """Box of the glyphs ``first`` to ``last`` of a line."""
    y0 = baseline(line) - DESCENT
    return Rect(LEFT + ADVANCE * first, y0, LEFT + ADVANCE * (last + 1), y0 + HEIGHT)


def pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, page_index, lines of each page; null texts have no page."""
    lines = F.split(F.col(text), "\n")
    cut = let(
        lines,
        lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) + LINES - 1) / LINES).cast("int") - 1), lambda p: F.slice(x, p * LINES + 1, F.lit(LINES))),
    )
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.posexplode(cut).alias("page_index", "lines")).withColumn("page_index", F.col("page_index").cast("long"))


def page_count(docs: DataFrame) -> DataFrame:
    """doc_id, n_pages; a null text has none."""
    n = F.size(F.split("text", "\n"))
    return docs.select("doc_id", F.coalesce(F.floor((n + (LINES - 1)) / LINES), F.lit(0)).cast("long").alias("n_pages"))


def starts(lines: Column) -> Column:
    """Where each line begins in its page's text (at most ``LINES`` of them)."""
    return F.transform(lines, lambda _, i: F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1))


def items(pages: DataFrame) -> DataFrame:
    """One row per line that shows something: its text, box and character span in the page's text."""
    p = pages.withColumn("__at", starts(F.col("lines"))).select("doc_id", "page_index", "__at", F.posexplode("lines").alias("item_index", "text"))
    p = p.where(F.length("text") > 0)
    at = F.get("__at", F.col("item_index"))
    box = run_box(F.col("item_index"), F.lit(0), F.length("text") - 1)
    return p.select(
        "doc_id", "page_index", F.col("item_index").cast("long").alias("item_index"), "text",
        at.cast("long").alias("char_start"), (at + F.length("text")).cast("long").alias("char_end"), *[c.cast("long").alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), (box.x0, box.y0, box.x1, box.y1))],
    )


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_index", F.array_join("lines", "\n").alias("text"))


def glyphs(pages: DataFrame) -> DataFrame:
    """One row per character with its box."""
    lines = pages.select("doc_id", "page_index", F.posexplode("lines").alias("line_no", "line")).where(F.length("line") > 0)
    chars = lines.select("doc_id", "page_index", "line_no", F.posexplode(F.split("line", "")).alias("col", "ch"))
    box = run_box(F.col("line_no"), F.col("col"), F.col("col"))
    return chars.select("doc_id", "page_index", "line_no", "col", "ch", *box.columns())
