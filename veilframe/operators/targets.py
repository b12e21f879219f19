"""Redaction plans: validation, defaults and the targets they come down to."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.geometry import Rect

MODES = ("strip", "erase", "redact")

PLAN_SCHEMA = (
    "targets array<struct<kind:string,pageIndex:int,x:double,y:double,width:double,height:double,"
    "points:array<struct<x:double,y:double>>,quads:array<array<struct<x:double,y:double>>>>>,"
    "mode string, fillColor struct<r:smallint,g:smallint,b:smallint>, overlayText string, "
    "removeIntersectingAnnotations boolean, stripMetadata boolean, stripAttachments boolean, sanitizeHiddenOcgs boolean"
)


@dataclass(frozen=True)
class Plan:
    """What a plan says besides its targets; defaults as documented."""

    mode: str = "redact"
    fill: tuple[int, int, int] = (0, 0, 0)
    overlay_text: str | None = None
    remove_intersecting_annotations: bool = True
    strip_metadata: bool = False
    strip_attachments: bool = False
    sanitize_hidden_ocgs: bool = False

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"UnsupportedOption: mode {self.mode!r}")
        if self.overlay_text is not None:
            if not self.overlay_text.strip():
                raise ValueError("UnsupportedOption: the overlay text is empty")
            if self.mode == "strip":
                raise ValueError("UnsupportedOption: an overlay text needs space that strip mode does not keep")

    @classmethod
    def from_json(cls, d: dict) -> Plan:
        c = d.get("fillColor") or {}
        return cls(
            d.get("mode") or "redact", (c.get("r", 0), c.get("g", 0), c.get("b", 0)), d.get("overlayText"),
            *(d.get(k) if d.get(k) is not None else v for k, v in (("removeIntersectingAnnotations", True), ("stripMetadata", False), ("stripAttachments", False), ("sanitizeHiddenOcgs", False))),
        )


def parse_plans(df: DataFrame, json: str) -> DataFrame:
    """``plan``: the struct of a JSON plan column, with defaults filled in."""
    p = F.from_json(F.col(json), PLAN_SCHEMA)
    return df.withColumn("plan", p).withColumn(
        "plan",
        F.col("plan")
        .withField("mode", F.coalesce("plan.mode", F.lit("redact")))
        .withField("removeIntersectingAnnotations", F.coalesce("plan.removeIntersectingAnnotations", F.lit(True)))
        .withField("stripMetadata", F.coalesce("plan.stripMetadata", F.lit(False)))
        .withField("stripAttachments", F.coalesce("plan.stripAttachments", F.lit(False)))
        .withField("sanitizeHiddenOcgs", F.coalesce("plan.sanitizeHiddenOcgs", F.lit(False))),
    )


def validate(targets: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """``error`` of each target (x0, y0, x1, y1): null where it is a rectangle of positive size on a page that is there.

    ``pages`` has ``keys``, width and height. Errors are rows, never a failed job.
    """
    there = pages.select(*keys, F.col("width").alias("__w"), F.col("height").alias("__h"))
    page = Rect.of(F.lit(0), F.lit(0), F.col("__w"), F.col("__h"))
    r = Rect.named()
    return targets.join(there, keys, "left").withColumn(
        "error",
        F.when(F.col("__w").isNull(), "InvalidPageIndex")
        .when(~((r.x1 > r.x0) & (r.y1 > r.y0)), "UnsupportedOption: empty rectangle")
        .when(~r.intersects(page), "UnsupportedOption: off the page"),
    ).drop("__w", "__h")


def group_bounds(quads: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of the union of a group's quads (rows x0, y0, x1, y1)."""
    return quads.groupBy(*keys).agg(*[c.alias(n) for n, c in Rect.named().bounds().items()], F.count("*").alias("n_quads"))


def by_page(targets: DataFrame, keys: list[str]) -> DataFrame:
    box = F.struct("x0", "y0", "x1", "y1")
    return targets.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("targets"))


def hits(things: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The ``things`` that some target of the same page intersects: a semi join on the page with the boxes as residual."""
    cond: Column = reduce(lambda a, b: a & b, [things[k] == targets[k] for k in keys])
    t = Rect.of(targets["x0"], targets["y0"], targets["x1"], targets["y1"])
    return things.join(targets, cond & Rect.of(things["x0"], things["y0"], things["x1"], things["y1"]).intersects(t), "left_semi")


def hits_by_cell(things: DataFrame, targets: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """``hits`` for pages with very many targets: boxes are dealt to grid cells first, so a page is many keys."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    tag = "__thing"
    t = things.withColumn(tag, F.monotonically_increasing_id())
    t = t.withColumn("__cx", cells("x0", "x1")).withColumn("__cy", cells("y0", "y1"))
    g = targets.select(*keys, "x0", "y0", "x1", "y1").withColumn("__cx", cells("x0", "x1")).withColumn("__cy", cells("y0", "y1"))
    return hits(t, g, [*keys, "__cx", "__cy"]).drop("__cx", "__cy").dropDuplicates([tag]).drop(tag)
