"""Redaction: what is removed, how text closes up, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veilframe.functions.geometry import Rect, luminance
from veilframe.functions.text import literal, normalise_query, number, quote

#: Operators that may stand on a page whose content is rewritten. Fixed values.
ALLOWED = tuple(
    "q Q cm w J j M d ri i gs m l c v y h re S s f F f* B B* b b* n W W* BT ET Tc Tw Tz TL Tf Tr Ts Td TD Tm T* Tj ' \" TJ "
    "rg RG g G k K cs CS sc SC scn SCN Do BMC BDC EMC MP DP BX EX".split()
)
#: Kerning below this is not written.
LEAST_KERN = 0.01


def pattern(query: str) -> str:
    """A pattern for what search finds in unnormalised text: any run of white space for a space, any case."""
    q = normalise_query(query)
    return r"(?iuU)" + r"\s+".join(quote(p) for p in q.split(" ")) if q else r"(?!)"


def text(column: Column, query: str, mode: str = "redact", fill: str = "█") -> Column:
    """A text without the matches of ``query``: closed up (strip), or with blanks (erase) or fills (redact) of their length."""
    p = pattern(query)
    if mode == "strip":
        return F.regexp_replace(column, p, "")
    with_ = " " if mode == "erase" else fill
    q = normalise_query(query)
    if q and " " not in q:  # every match has the query's length
        return F.regexp_replace(column, p, with_ * len(q))
    parts, found = F.split(column, p, -1), F.regexp_extract_all(column, F.lit(p), F.lit(0))
    blanks = F.concat(F.transform(found, lambda m: F.regexp_replace(m, r"(?s).", with_)), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, blanks, lambda a, b: F.concat(a, b)), "")


def _fresh(line: WindowSpec) -> Column:
    """Glyphs of a span that no span before it on its line has."""
    before = F.max("last_col").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(F.lit(0), F.col("last_col") - F.greatest(F.col("first_col") - 1, F.coalesce(before, F.lit(-1))))


def removed_count(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct glyphs under spans (line_no, first_col, last_col), which may overlap: merged first, so no glyph becomes a row."""
    line = Window.partitionBy(*keys, "page_index", "line_no").orderBy("first_col", "last_col")
    return spans.withColumn("__n", _fresh(line)).groupBy(*keys).agg(F.sum("__n").cast("long").alias("glyphs_removed"))


def kern_runs(glyphs: DataFrame, keys: list[str], order: list[str], removed: str, width: str) -> DataFrame:
    """Runs of neighbouring removed glyphs with the kern that takes their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w)
    numbered = glyphs.withColumn("__n", n).where(F.col(removed))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("__n"))
    return (
        numbered.withColumn("__island", F.col("__n") - r)
        .groupBy(*keys, "__island")
        .agg(F.min("__n").alias("first"), F.count("*").alias("n"), (-F.sum(width)).alias("kern"))
        .where(F.abs("kern") >= LEAST_KERN)
        .drop("__island")
    )


def disallowed(ops: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """Operators outside the allow list that no BX ... EX section tolerates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(F.col(op) == "BX", 1).when(F.col(op) == "EX", -1).otherwise(0)
    level = ops.withColumn("__s", F.sum(step).over(w))
    level = level.withColumn("__f", F.least(F.lit(0), F.min("__s").over(w)))
    return level.where((F.col("__s") - F.col("__f") <= 0) & ~F.col(op).isin(*ALLOWED)).drop("__s", "__f")


def path_bounds(segments: DataFrame, keys: list[str], order: list[str], paint: str, x: str, y: str, stroke: Column) -> DataFrame:
    """Bounds of each painted path: a path number is the count of paints before, its box the points grown by half the stroke."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = segments.withColumn("path", F.sum(F.col(paint).cast("int")).over(w) - F.col(paint).cast("int"))
    half = stroke / 2
    drawn = lambda c: F.when(~F.col(paint), F.col(c))
    return (
        numbered.groupBy(*keys, "path")
        .agg(
            F.min(drawn(x)).alias("x0"), F.min(drawn(y)).alias("y0"), F.max(drawn(x)).alias("x1"), F.max(drawn(y)).alias("y1"),
            F.count(drawn(x)).alias("n_points"), F.max(F.col(paint).cast("int")).alias("painted"),
        )
        .where("painted = 1 and n_points > 0")
        .drop("painted")
        .withColumns({"x0": F.col("x0") - half, "y0": F.col("y0") - half, "x1": F.col("x1") + half, "y1": F.col("y1") + half})
    )


def keep_annotation(subtype: Column, box: Rect, target: Rect) -> Column:
    """Whether an annotation stays: attachments go, boxless ones go unless they are links, others if they miss the target."""
    boxless = box.x0.isNull()
    return ~((subtype == "FileAttachment") | (boxless & (subtype != "Link")) | (~boxless & box.intersects(target)))


def overlay_label(box: Rect, r, g, b) -> dict[str, Column]:
    """Size, place and colour of a target's label."""
    h = box.y1 - box.y0
    size = F.least(F.greatest(0.6 * h, F.lit(4.0)), F.lit(14.0))
    return {
        "label_size": size, "label_x": box.x0 + 0.25 * size, "label_y": box.y0 + 0.2 * size,
        "label_color": F.when(luminance(r, g, b) / 255.0 < 0.5, "white").otherwise("black"),
    }


def overlay_stream(box: Rect, r, g, b, label: Column | None = None) -> Column:
    """Content that fills a box and writes its label."""
    n = lambda v: number(v, 4)
    color = F.concat_ws(" ", *[n(F.lit(v) / 255.0 if not isinstance(v, Column) else v / 255.0) for v in (r, g, b)])
    fill = F.concat_ws(" ", F.lit("q"), color, F.lit("rg"), n(box.x0), n(box.y0), n(box.x1 - box.x0), n(box.y1 - box.y0), F.lit("re f Q"))
    if label is None:
        return fill
    o = overlay_label(box, r, g, b)
    ink = F.when(o["label_color"] == "white", "1 1 1 rg").otherwise("0 0 0 rg")
    show = F.concat_ws(" ", F.lit("q BT /RedactOverlay"), n(o["label_size"]), F.lit("Tf"), ink, n(o["label_x"]), n(o["label_y"]), F.lit("Td"), literal(label), F.lit("Tj ET Q"))
    return F.concat_ws("\n", fill, show)


def report(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Pages touched, matches and distinct glyphs removed of each document."""
    # One exchange by page: glyphs by line within it, and a match counts where its first span is.
    line = Window.partitionBy(*keys, "page_index", "line_no").orderBy("first_col", "last_col")
    match = Window.partitionBy(*keys, "page_index", "match_index").orderBy("line_no", "first_col")
    dealt = spans.select(*keys, "page_index", "match_index", "line_no", "first_col", "last_col").repartition(*keys, "page_index")
    rows = dealt.withColumn("__n", _fresh(line)).withColumn("__first", (F.row_number().over(match) == 1).cast("long"))
    pages = rows.groupBy(*keys, "page_index").agg(F.sum("__n").alias("g"), F.sum("__first").alias("m"))
    return pages.groupBy(*keys).agg(F.count("*").alias("pages_touched"), F.sum("m").cast("long").alias("matches"), F.sum("g").cast("long").alias("glyphs_removed"))
