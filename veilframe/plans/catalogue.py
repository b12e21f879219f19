"""The engine's queries over the driver's tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import encodings
from veilframe.functions.geometry import Matrix, Rect, page_size, page_transform, quad_bounds, well_formed
from veilframe.operators import fonts, graph, images, redact, sanitize, search, targets, textlayer, visual
from veilframe.session import table as t

QUERY = "th the"
QUERIES = ["the", "th the", "  La  ", "und"]
ONE = "the"

# What several counterparts begin with: pages of fifty lines, and their normalised text.
_PAGES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, n // 50 AS page_index, string_agg(x, chr(10) ORDER BY n) AS display, list(x ORDER BY n) AS lines FROM l GROUP BY ALL),
i AS (SELECT doc_id, page_index, display, lines, lower(regexp_replace(display, '[\\t-\\r\\x{85}\\p{Z}]+', ' ', 'g')) AS norm FROM p)"""


def _matches(q: str) -> str:
    n = len(q)
    return f"""
m AS (SELECT doc_id, page_index, display, lines, k - 1 AS match_index,
             list_sum(list_transform(parts[1:k], lambda x: length(x))) + {n} * (k - 1) AS start
      FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM (SELECT *, string_split(norm, '{q}') AS parts FROM i WHERE contains(norm, '{q}'))))"""


def _spans(q: str) -> str:
    n = len(q)
    return f"""{_PAGES}, {_matches(q)},
k AS (SELECT doc_id, page_index, list_filter(range(len(cs)), lambda z: NOT (z > 0 AND ws[z + 1] AND ws[greatest(z, 1)])) AS kept
      FROM (SELECT doc_id, page_index, cs, list_transform(cs, lambda c: regexp_matches(c, '[\\t-\\r\\x{{85}}\\p{{Z}}]')) AS ws
            FROM (SELECT doc_id, page_index, string_split(display, '') AS cs FROM i WHERE contains(norm, '{q}')))),
a AS (SELECT m.doc_id, m.page_index, match_index, kept[CAST(start AS BIGINT) + 1] AS a, kept[CAST(start AS BIGINT) + {n}] AS b FROM m JOIN k ON m.doc_id = k.doc_id AND m.page_index = k.page_index),
s AS (SELECT doc_id, n // 50 AS page_index, n % 50 AS line_no, length(x) AS size,
             sum(length(x) + 1) OVER (PARTITION BY doc_id, n // 50 ORDER BY n) - length(x) - 1 AS pos FROM l),
r AS (SELECT a.doc_id, a.page_index, match_index, line_no, greatest(a - pos, 0) AS first_col, least(b - pos, size - 1) AS last_col
      FROM a JOIN s ON a.doc_id = s.doc_id AND a.page_index = s.page_index WHERE greatest(a - pos, 0) <= least(b - pos, size - 1))"""


_CAST = "CAST({0} AS BIGINT) AS {0}"


def _long(*names: str) -> str:
    return ", ".join(_CAST.format(n) for n in names)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return textlayer.pages(t(spark, d, "documents"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return search.index(_pages(spark, d))


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Boxes on numbered pages: rows of lineitem; one target a page: rows of orders. Whole numbers.
def _boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") % 500, F.col("l_suppkey") % 700
    return t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity").cast("long")).alias("x1"), (y + 5 + 2 * F.col("l_linenumber")).alias("y1")
    )


def _targets(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("o_custkey") % 500, F.col("o_orderkey") % 600
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 120).alias("x1"), (y + 150).alias("y1"))


_BOXES = """b AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey % 500 AS x0, l_suppkey % 700 AS y0,
  l_partkey % 500 + CAST(l_quantity AS BIGINT) AS x1, l_suppkey % 700 + 5 + 2 * l_linenumber AS y1 FROM lineitem),
g AS (SELECT o_orderkey AS page, o_custkey % 500 AS x0, o_orderkey % 600 AS y0, o_custkey % 500 + 120 AS x1, o_orderkey % 600 + 150 AS y1 FROM orders)"""
_HIT = "greatest({0}.x0, {1}.x0) < least({0}.x1, {1}.x1) AND greatest({0}.y0, {1}.y0) < least({0}.y1, {1}.y1)"


def q01_page_count(spark, d):
    return textlayer.page_count(t(spark, d, "documents"))


def q02_page_size(spark, d):
    w, h = page_size(F.lit(6120) - 10 * (F.col("doc_id") % 3), 7920, 90 * (F.col("doc_id") % 4))
    return t(spark, d, "documents").select("doc_id", w.cast("long").alias("width"), h.cast("long").alias("height"))


def q03_page_tree_inherit(spark, d):
    r = t(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), F.when(F.col("r_regionkey") % 2 == 1, 90).cast("long").alias("rotate"), F.when(F.col("r_regionkey") % 3 == 0, 500).cast("long").alias("width"))
    n = t(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("node"), (F.col("n_regionkey") + 100).cast("long").alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, 180).cast("long").alias("rotate"), F.lit(None).cast("long").alias("width"))
    root = spark.createDataFrame([(0, None, 0, 612)], "node long, parent long, rotate long, width long")
    return _longs(graph.inherit(root.unionByName(r).unionByName(n), ["rotate", "width"]).drop("error"), "depth")


def q04_extract_text(spark, d):
    return textlayer.items(_pages(spark, d))


def q05_glyph_layout(spark, d):
    g = textlayer.glyphs(_pages(spark, d))
    return g.groupBy("doc_id", "page_index").agg(
        F.count("*").alias("n_glyphs"), F.sum(F.col("x0").cast("long")).alias("sum_x0"), F.sum(F.col("y0").cast("long")).alias("sum_y0"), F.max(F.col("x1").cast("long")).alias("right"), F.min(F.col("y0").cast("long")).alias("bottom"), F.sum((F.col("ch") == " ").cast("long")).alias("n_spaces")
    )


def _codes(spark, d):
    return t(spark, d, "events").select("event_id", (F.col("event_id") % 256).cast("int").alias("code"), F.element_at(F.array(*map(F.lit, encodings.NAMES)), (F.col("user_id") % 3 + 1).cast("int")).alias("encoding"))


def q06_font_decode(spark, d):
    to_unicode = spark.createDataFrame([(c, chr(0x3B1 + c % 20)) for c in range(0, 256, 7)], "code int, ch string")
    differences = spark.createDataFrame([(c, chr(0x410 + c % 30)) for c in range(0, 256, 5)], "code int, ch string")
    widths = spark.createDataFrame([(c, 250 + c) for c in range(32, 127)], "code int, width int")
    return _longs(fonts.decode(_codes(spark, d), to_unicode, differences, widths), "code", "width")


def q07_differences(spark, d):
    rows = t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("font"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("at"),
        F.when(F.col("l_linenumber").isin(1, 4), F.col("l_partkey") % 200).alias("number"), F.when(~F.col("l_linenumber").isin(1, 4), F.concat_ws("", "l_returnflag", "l_linestatus")).alias("name"),
    )
    return fonts.differences(rows.dropDuplicates(["font", "at"]), ["font"], ["at"]).groupBy("font", "code").agg(F.max("name").alias("name"), F.count("*").alias("n"))


def q08_search_count(spark, d):
    return search.count(_index(spark, d), QUERY)


def q09_search_positions(spark, d):
    return _longs(search.positions(_index(spark, d), QUERY).select("doc_id", "page_index", "match_index", "start"), "match_index", "start")


def q10_search_multi(spark, d):
    return search.multi(_index(spark, d), QUERIES)


def q11_search_quads(spark, d):
    return search.quads(_index(spark, d), QUERY)


def q12_visual_lines(spark, d):
    """Words as boxes whose heights jitter, put back into lines; per page how many lines and words."""
    lines = _pages(spark, d).select("doc_id", "page_index", F.posexplode("lines").alias("line_no", "line"))
    words = lines.select("doc_id", "page_index", "line_no", F.posexplode(F.split("line", " ")).alias("k", "w")).where(F.length("w") > 0)
    y = 7200 - 120 * F.col("line_no") + F.crc32(F.col("w").cast("binary")) % 7
    boxes = words.select("doc_id", "page_index", (F.col("k") * 100).alias("x0"), y.alias("y0"), (F.col("k") * 100 + 90).alias("x1"), (y + 80).alias("y1"))
    return visual.visual_lines(boxes).groupBy("doc_id", "page_index").agg((F.max("line") + 1).cast("long").alias("n_lines"), F.count("*").alias("n_words"))


def q13_display_gaps(spark, d):
    g = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("line"), (F.col("l_orderkey") * 60 + F.col("l_linenumber") * 7).alias("x0"), (F.col("l_orderkey") * 60 + F.col("l_linenumber") * 7 + F.col("l_quantity").cast("long")).alias("x1"), (1 + F.col("l_partkey") % 12).alias("h")).distinct()
    return visual.with_gaps(g, ["line"], ["x0", "x1", "h"]).groupBy("line").agg(F.count("*").alias("n_glyphs"), F.sum(F.col("space_before").cast("long")).alias("n_spaces"))


def q14_coalesce_boxes(spark, d):
    b = _boxes(spark, d).select("page", "x0", "x1")
    return _longs(visual.coalesce_boxes(b, ["page"], F.lit(8)), "island")


def q15_rect_intersect_join(spark, d):
    return targets.hits(_boxes(spark, d), _targets(spark, d), ["page"]).groupBy("page").agg(F.count("*").alias("n_hit"))


def q16_quadgroup_bounds(spark, d):
    """Groups whose bounds a target meets though none of its quads does, and those a quad of which it meets."""
    b, g = _boxes(spark, d), _targets(spark, d)
    bounds = targets.group_bounds(b, ["page"])
    by_bounds = targets.hits(bounds, g, ["page"]).select("page", F.lit(True).alias("bounds_hit"))
    by_quad = targets.hits(b, g, ["page"]).groupBy("page").agg(F.lit(True).alias("quad_hit"))
    return bounds.join(by_bounds, "page", "left").join(by_quad, "page", "left").na.fill(False, ["bounds_hit", "quad_hit"])


def q17_plan_validation(spark, d):
    pages = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 5).cast("int"))).alias("page_index"), F.lit(6120).alias("width"), F.lit(7920).alias("height"))
    o, key = t(spark, d, "orders"), F.col("o_orderkey")
    x, w = F.when(key % 13 == 0, 7000).otherwise(key % 5000), F.when(key % 11 == 0, 0).otherwise(key % 300 + 1)
    plan = o.select(key.alias("target"), F.col("o_custkey").alias("doc_id"), (key % 6).cast("int").alias("page_index"), x.alias("x0"), F.lit(100).alias("y0"), (x + w).alias("x1"), F.lit(300).alias("y1"))
    return targets.validate(plan, pages, ["doc_id", "page_index"]).select("target", F.coalesce("error", F.lit("ok")).alias("verdict"))


def _redacted(mode):
    def run(spark, d):
        return t(spark, d, "documents").select("doc_id", redact.text(F.col("text"), ONE if mode != "erase" else QUERY, mode).alias("text"))

    return run


def q21_removed_count(spark, d):
    return redact.removed_count(search.quads(_index(spark, d), [ONE, QUERY]), ["doc_id"])


def q22_kern_runs(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max((F.col("l_returnflag") == "R")).alias("gone"), F.sum(F.col("l_quantity").cast("long") * 10).alias("width"))
    return _longs(redact.kern_runs(g, ["l_orderkey"], ["l_linenumber"], "gone", "width"), "first", "kern")


_OPS = ["BX", "EX", "sh", "Tj", "re", "f", "d0", "q", "Q", "Do"]


def q23_operator_allowlist(spark, d):
    ops = t(spark, d, "events").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, _OPS)), (F.col("event_id") % 10 + 1).cast("int")).alias("op"))
    return redact.disallowed(ops, ["user_id"], ["event_id"])


def q24_path_bounds(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("paint"), (F.col("event_id") % 613).alias("x"), (F.col("event_id") * 7 % 797).alias("y"))
    box = Rect.of(200, 200, 400, 420)
    p = redact.path_bounds(e, ["user_id"], ["event_id"], "paint", "x", "y", F.lit(4))
    return _longs(p.withColumn("hit", Rect.named().intersects(box)), "path", "x0", "y0", "x1", "y1")


def _part_box():
    x, y = F.col("p_partkey") % 400, F.col("p_partkey") * 3 % 500
    return x, y, F.col("p_size") * 8, F.col("p_size") * 6 + 10


def q25_image_overlap(spark, d):
    x, y, w, h = _part_box()
    f = lambda c: c.cast("double")
    ctm = Matrix.of(f(w), F.lit(0.0), F.lit(0.0), f(h), f(x), f(y))
    target = Rect.of(F.lit(150.0), F.lit(120.0), F.lit(330.0), F.lit(300.0))
    return t(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in images.coverage(ctm, target, F.lit(64), F.lit(48)).items()])


def q26_image_pixel_template(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in images.pixel_template(k % 256, k * 7 % 256, k * 31 % 256).items()])


def q27_annotation_removal(spark, d):
    k = F.col("c_custkey")
    subtype = F.element_at(F.array(*map(F.lit, ["Link", "Text", "FileAttachment", "Widget"])), (F.col("c_nationkey") % 4 + 1).cast("int"))
    x, y = F.when(k % 5 != 0, k % 600), F.when(k % 5 != 0, k * 3 % 780)
    keep = redact.keep_annotation(subtype, Rect(x, y, x + 40, y + 20), Rect.of(100, 100, 300, 500))
    return t(spark, d, "customer").select("c_custkey", subtype.alias("subtype"), keep.alias("kept"))


def q28_overlay_label(spark, d):
    x, y, w, h = _part_box()
    k = F.col("p_partkey")
    label = redact.overlay_label(Rect(x, y, x + w, y + h), k % 256, k * 7 % 256, k * 31 % 256)
    out = t(spark, d, "part").select("p_partkey", *[(c if n == "label_color" else F.floor(c * 1000 + 0.5).cast("long")).alias(n) for n, c in label.items()])
    return out


def q29_hidden_set(spark, d):
    n = F.col("n_nationkey")
    layers = t(spark, d, "nation").select(F.col("n_regionkey").alias("doc"), n.alias("layer"), (n % 4 == 0).alias("listed_on"), (n % 3 == 0).alias("listed_off"))
    config = t(spark, d, "region").select(F.col("r_regionkey").alias("doc"), F.when(F.col("r_regionkey") % 2 == 1, "OFF").when(F.col("r_regionkey") == 2, "Unchanged").alias("base_state"))
    return _longs(sanitize.hidden_layers(layers, config, ["doc"]), "doc", "layer")


def q30_strip_hidden(spark, d):
    k = F.col("event_id") % 17
    ops = t(spark, d, "events").select("user_id", "event_id", k.alias("k"))
    marked = sanitize.hidden_sections(ops, ["user_id"], ["event_id"], F.col("k") == 3, F.col("k") == 8, F.col("k").isin(5, 12))
    return marked.groupBy("user_id").agg(F.count("*").alias("n_ops"), F.sum(F.col("hidden").cast("long")).alias("n_hidden"), F.min(F.when(F.col("hidden"), F.col("event_id"))).alias("first_hidden"))


def _edges(spark, d):
    p = t(spark, d, "part").select("p_partkey")
    k = F.col("p_partkey")
    return p.select(k.alias("src"), F.explode(F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long"))).alias("dst")).where("dst > 0")


def q31_reachability(spark, d):
    roots = t(spark, d, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"))
    return graph.reachable(_edges(spark, d), roots)


def q32_latest_revision(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return graph.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def q33_attachment_anti(spark, d):
    """Objects that no returned item refers to: what is left once reachable attachments are deleted."""
    used = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return t(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_brand")


def q34_html_sanitize(spark, d):
    return t(spark, d, "pages").select("page_id", sanitize.html(F.col("html")).alias("html"))


def q35_pii_redact(spark, d):
    return t(spark, d, "documents").select("doc_id", sanitize.pii(F.col("text")).alias("text"), sanitize.pii_count(F.col("text")).cast("long").alias("n_found"))


def q36_apply_report(spark, d):
    return redact.report(search.quads(_index(spark, d), QUERY), ["doc_id"])


def _objects(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("num"), (F.col("l_partkey") % 50 + 20).alias("length")).dropDuplicates(["doc", "num"])


def q37_objstm_chunk(spark, d):
    o = _objects(spark, d).drop("length")
    return graph.chunks(o, ["doc"], ["num"]).groupBy("doc", "chunk").agg(F.count("*").alias("n"), F.min("num").alias("first_num"), F.max("num").alias("last_num"))


def q38_xref_offsets(spark, d):
    o = _objects(spark, d).groupBy("doc", "num").agg(F.max("length").alias("length"))
    o = o.withColumn("length", F.col("num") % 50 + 20)
    return graph.offsets(o, ["doc"], ["num"], F.col("length"), 15)


def q41_matrix_algebra(spark, d):
    """cm chains: a scale, a turn and a move, then its inverse, applied to a point; whole numbers again at the end."""
    k = F.col("p_partkey")
    m = Matrix.scale((k % 7 + 1).cast("double"), F.lit(2.0)).then(Matrix.rotate(90 * (k % 4))).then(Matrix.translate((k % 50).cast("double"), F.lit(5.0)))
    r = m.rect(Rect.of(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(4.0)))
    x, y = m.point((k % 30).cast("double"), (k % 20).cast("double"))
    back = m.inverse().point(x, y)
    at = lambda v: F.floor(v + 0.5).cast("long")
    px, py = page_transform(Rect.of(F.lit(10.0), F.lit(20.0), F.lit(622.0), F.lit(812.0)), 90 * (k % 4)).point((k % 600).cast("double"), F.lit(30.0))
    return t(spark, d, "part").select("p_partkey", *[at(v).alias(n) for n, v in {"x": x, "y": y, "bx": back[0], "by": back[1], "rx0": r.x0, "ry0": r.y0, "rx1": r.x1, "ry1": r.y1, "px": px, "py": py}.items()])


def q42_rect_algebra(spark, d):
    """Normalisation, union, clip and containment of a box of either sign with a fixed one."""
    k = F.col("p_partkey")
    r = Rect.sized(k % 300, k * 7 % 300, k % 41 - 20, k % 31 - 15)
    o = Rect.of(100, 80, 260, 240)
    u, c = r.union(o), r.clip(o)
    return _longs(t(spark, d, "part").select("p_partkey", *u.columns("u"), *c.columns("c"), r.intersects(o).alias("hit"), o.contains(k % 300, k * 7 % 300).alias("inside")), *[p + n for p in "uc" for n in ("x0", "y0", "x1", "y1")])


def q43_match_targets(spark, d):
    """Matches of a search, as targets, beside one drawn by hand on each first page: what a user's plan is made of."""
    found = search.matches_to_targets(search.quads(_index(spark, d), QUERY)).select("doc_id", "page_index", "target_index", "kind", "x0", "y0", "x1", "y1")
    hand = t(spark, d, "documents").where("text is not null").select("doc_id", F.lit(0).cast("long").alias("page_index"), F.lit(-1).cast("long").alias("target_index"), F.lit("rect").alias("kind"), *[F.lit(v).cast("long").alias(n) for n, v in (("x0", 700), ("y0", 6950), ("x1", 1650), ("y1", 7250))])
    return found.unionByName(hand)


def q44_page_search_hits(spark, d):
    """Lines that a target of the page's plan meets: items x targets, a semi join on (document, page)."""
    items = textlayer.items(_pages(spark, d))
    return targets.hits(items, q43_match_targets(spark, d), ["doc_id", "page_index"]).groupBy("doc_id", "page_index").agg(F.count("*").alias("n_items"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def q45_number_format(spark, d):
    from veilframe.functions.text import literal, number

    v = F.col("l_partkey") * 0.125 - 40
    return t(spark, d, "lineitem").select("l_partkey").distinct().select("l_partkey", number(v, 4).alias("number"), literal(F.concat(F.lit("a(b)\\"), F.col("l_partkey").cast("string"))).alias("literal"))


def q48_conversation_search(spark, d):
    """Search over turns of conversations: the text layer of any table of texts."""
    docs = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return search.count(search.index(textlayer.pages(docs)), ONE)


def q52_fonts_of_documents(spark, d):
    """Codes of many fonts, each with ToUnicode, differences and widths of its own."""
    codes = t(spark, d, "events").select(
        "event_id", (F.col("user_id") % 40).alias("font"), (F.col("event_id") % 256).cast("int").alias("code"), F.element_at(F.array(*map(F.lit, encodings.NAMES)), (F.col("user_id") % 3 + 1).cast("int")).alias("encoding")
    )
    every = codes.select("font").distinct().select("font", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("code"))
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 4, "0")), "UTF-16BE")
    n = F.col("code") + F.col("font")
    to_unicode = every.where(n % 7 == 0).select("font", "code", char(0x3B1 + n % 20).alias("ch"))
    differences = every.where(n % 5 == 0).select("font", "code", char(0x410 + n % 30).alias("ch"))
    widths = every.where("code between 32 and 126").select("font", "code", (250 + n).cast("int").alias("width"))
    return _longs(fonts.decode(codes, to_unicode, differences, widths, ["font"]), "code", "width")


def q54_quad_transform(spark, d):
    """Quads, of which some lack a point or a coordinate, through a matrix; and the bounds of each."""
    k = F.col("p_partkey")
    m = Matrix.rotate(90 * (k % 4)).then(Matrix.translate((k % 50).cast("double"), F.lit(5.0)))
    whole = Rect.of((k % 30).cast("double"), F.lit(0.0), (k % 30 + 10).cast("double"), F.lit(4.0)).quad()
    broken = F.concat(F.slice(whole, 1, 3), F.array(F.struct(F.lit(None).cast("double").alias("x"), F.lit(1.0).alias("y"))))
    quads = well_formed(F.when(k % 3 == 0, F.array(F.slice(whole, 1, 3), whole)).when(k % 3 == 1, F.array(whole, broken)).otherwise(F.array(whole, whole)))
    each = t(spark, d, "part").select("p_partkey", F.posexplode(F.transform(quads, m.quad)).alias("n", "quad"))
    b = quad_bounds(F.col("quad"))
    return _longs(each.select("p_partkey", "n", *[F.round(c).alias(x) for x, c in zip(("x0", "y0", "x1", "y1"), (b.x0, b.y0, b.x1, b.y1))], F.round(F.col("quad")[0]["x"]).alias("first_x")), "n", "x0", "y0", "x1", "y1", "first_x")


def _pdf(name):
    def run(spark, d):
        from veilframe.plans import pdf_queries

        return getattr(pdf_queries, name)(spark, d)

    return run


_NOT_SQL = ("q12_visual_lines",)
_PDF = ("q39_filters_roundtrip", "q40_pdf_roundtrip", "q46_aes_decrypt", "q47_object_key", "q49_pdf_search", "q50_pdf_objects", "q51_plan_per_document", "q53_decrypt_documents", "q55_pdf_things")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {k: f for k, f in globals().items() if k[:1] == "q" and k[1:3].isdigit()}
    named |= {"q18_redact_strip": _redacted("strip"), "q19_redact_erase": _redacted("erase"), "q20_redact_fill": _redacted("redact")}
    named |= {k: _pdf(k) for k in _PDF}
    return dict(sorted(named.items()))


def _base_char() -> str:
    rows = ", ".join(f"('{n}', {b}, {_sql(ch)})" for n in encodings.NAMES for b, ch in sorted(encodings.table(n).items()))
    return f"enc(encoding, code, ch) AS (VALUES {rows})"


def _sql(text: str) -> str:
    return f"chr({ord(text)})"


def oracle_sql() -> dict[str, str]:
    lum = "(0.299 * r + 0.587 * g + 0.114 * b)"
    sql = {
        "q01_page_count": "SELECT doc_id, CAST(coalesce((len(string_split(text, chr(10))) + 49) // 50, 0) AS BIGINT) AS n_pages FROM documents",
        "q02_page_size": "SELECT doc_id, CAST(CASE WHEN doc_id % 4 IN (1, 3) THEN 7920 ELSE 6120 - 10 * (doc_id % 3) END AS BIGINT) AS width, CAST(CASE WHEN doc_id % 4 IN (1, 3) THEN 6120 - 10 * (doc_id % 3) ELSE 7920 END AS BIGINT) AS height FROM documents",
        "q03_page_tree_inherit": f"""WITH RECURSIVE tree AS (
            SELECT 0 AS node, NULL AS parent, 0 AS rotate, 612 AS width
            UNION ALL SELECT r_regionkey + 100, 0, CASE WHEN r_regionkey % 2 = 1 THEN 90 END, CASE WHEN r_regionkey % 3 = 0 THEN 500 END FROM region
            UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100, CASE WHEN n_nationkey % 3 = 0 THEN 180 END, NULL FROM nation),
          t AS (SELECT node, parent, 0 AS depth, rotate, width FROM tree WHERE parent IS NULL
            UNION ALL SELECT n.node, n.parent, t.depth + 1, coalesce(n.rotate, t.rotate), coalesce(n.width, t.width) FROM tree n JOIN t ON n.parent = t.node)
          SELECT {_long('node', 'parent', 'depth', 'rotate', 'width')} FROM t""",
        "q04_extract_text": f"""WITH {_PAGES}, s AS (SELECT doc_id, n // 50 AS page_index, n % 50 AS item_index, x AS text, sum(length(x) + 1) OVER (PARTITION BY doc_id, n // 50 ORDER BY n) - length(x) - 1 AS char_start FROM l)
          SELECT doc_id, {_long('page_index', 'item_index', 'char_start')}, text, CAST(char_start + length(text) AS BIGINT) AS char_end, CAST(720 AS BIGINT) AS x0,
            CAST(7188 - 120 * item_index AS BIGINT) AS y0, CAST(720 + 60 * length(text) AS BIGINT) AS x1, CAST(7268 - 120 * item_index AS BIGINT) AS y1 FROM s WHERE length(text) > 0""",
        "q05_glyph_layout": f"""WITH {_PAGES}, g AS (SELECT doc_id, n // 50 AS page_index, n % 50 AS line_no, unnest(string_split(x, '')) AS ch, generate_subscripts(string_split(x, ''), 1) - 1 AS c FROM l WHERE length(x) > 0)
          SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, count(*) AS n_glyphs, CAST(sum(720 + 60 * c) AS BIGINT) AS sum_x0, CAST(sum(7188 - 120 * line_no) AS BIGINT) AS sum_y0,
            CAST(max(780 + 60 * c) AS BIGINT) AS "right", CAST(min(7188 - 120 * line_no) AS BIGINT) AS bottom, CAST(sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) AS BIGINT) AS n_spaces FROM g GROUP BY ALL""",
        "q06_font_decode": f"""WITH {_base_char()}, c AS (SELECT event_id, event_id % 256 AS code, ['{"', '".join(encodings.NAMES)}'][user_id % 3 + 1] AS encoding FROM events)
          SELECT event_id, CAST(c.code AS BIGINT) AS code, encoding, CASE WHEN c.code % 7 = 0 THEN chr(CAST(945 + c.code % 20 AS INT)) WHEN c.code % 5 = 0 THEN chr(CAST(1040 + c.code % 30 AS INT)) ELSE coalesce(ch, chr(65533)) END AS ch,
            CAST(CASE WHEN c.code BETWEEN 32 AND 126 THEN 250 + c.code ELSE 600 END AS BIGINT) AS width FROM c LEFT JOIN enc USING (encoding, code)""",
        "q07_differences": """WITH r AS (SELECT DISTINCT l_orderkey AS font, l_linenumber * 10000000 + l_partkey * 100 + l_suppkey % 100 AS pos, l_linenumber AS n, l_partkey % 200 AS v, l_returnflag || l_linestatus AS name FROM lineitem),
          u AS (SELECT font, pos, min(n) AS n, min(v) AS v, min(name) AS name FROM r GROUP BY ALL),
          z AS (SELECT *, last_value(CASE WHEN n IN (1, 4) THEN v END IGNORE NULLS) OVER w AS base, last_value(CASE WHEN n IN (1, 4) THEN rn END IGNORE NULLS) OVER w AS base_at
                FROM (SELECT *, row_number() OVER (PARTITION BY font ORDER BY pos) AS rn FROM u) WINDOW w AS (PARTITION BY font ORDER BY pos))
          SELECT font, CAST(base + rn - base_at - 1 AS BIGINT) AS code, max(name) AS name, count(*) AS n FROM z WHERE n NOT IN (1, 4) AND base IS NOT NULL GROUP BY ALL""",
        "q08_search_count": f"WITH {_PAGES} SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, CAST((length(norm) - length(replace(norm, '{QUERY}', ''))) // {len(QUERY)} AS BIGINT) AS n_matches FROM i WHERE contains(norm, '{QUERY}')",
        "q09_search_positions": f"WITH {_PAGES}, {_matches(QUERY)} SELECT doc_id, {_long('page_index', 'match_index', 'start')} FROM m",
        "q10_search_multi": f"""WITH {_PAGES}, q AS (SELECT * FROM (VALUES {', '.join(f"('{x}', '{x.strip().lower()}')" for x in QUERIES)}) v(query, q))
          SELECT query, doc_id, CAST(page_index AS BIGINT) AS page_index, CAST((length(norm) - length(replace(norm, q, ''))) // length(q) AS BIGINT) AS n_matches FROM i JOIN q ON contains(norm, q)""",
        "q11_search_quads": f"""WITH {_spans(QUERY)} SELECT doc_id, {_long('page_index', 'match_index', 'line_no', 'first_col', 'last_col')}, CAST(720 + 60 * first_col AS BIGINT) AS x0,
          CAST(7188 - 120 * line_no AS BIGINT) AS y0, CAST(780 + 60 * last_col AS BIGINT) AS x1, CAST(7268 - 120 * line_no AS BIGINT) AS y1 FROM r""",
        "q13_display_gaps": """WITH g AS (SELECT DISTINCT l_suppkey AS line, l_orderkey * 60 + l_linenumber * 7 AS x0, l_orderkey * 60 + l_linenumber * 7 + CAST(l_quantity AS BIGINT) AS x1, 1 + l_partkey % 12 AS h FROM lineitem),
          s AS (SELECT line, coalesce(x0 - lag(x1) OVER w > 0.3 * greatest(least(lag(h) OVER w, h), 1), false) AS sp FROM g WINDOW w AS (PARTITION BY line ORDER BY x0, x1, h))
          SELECT line, count(*) AS n_glyphs, CAST(sum(CAST(sp AS INT)) AS BIGINT) AS n_spaces FROM s GROUP BY ALL""",
        "q14_coalesce_boxes": f"""WITH {_BOXES}, s AS (SELECT page, x0, x1, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
          k AS (SELECT *, sum(CASE WHEN x0 - before <= 8 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM s)
          SELECT page, CAST(island AS BIGINT) AS island, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM k GROUP BY ALL""",
        "q15_rect_intersect_join": f"WITH {_BOXES} SELECT page, count(*) AS n_hit FROM b WHERE EXISTS (SELECT 1 FROM g WHERE g.page = b.page AND {_HIT.format('b', 'g')}) GROUP BY ALL",
        "q16_quadgroup_bounds": f"""WITH {_BOXES}, u AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_quads FROM b GROUP BY ALL)
          SELECT *, EXISTS (SELECT 1 FROM g WHERE g.page = u.page AND {_HIT.format('u', 'g')}) AS bounds_hit,
            EXISTS (SELECT 1 FROM g JOIN b ON b.page = g.page WHERE g.page = u.page AND {_HIT.format('b', 'g')}) AS quad_hit FROM u""",
        "q17_plan_validation": """SELECT o_orderkey AS target, CASE WHEN c_custkey IS NULL OR o_orderkey % 6 > c_custkey % 5 THEN 'InvalidPageIndex' WHEN o_orderkey % 11 = 0 THEN 'UnsupportedOption: empty rectangle'
          WHEN o_orderkey % 13 = 0 THEN 'UnsupportedOption: off the page' ELSE 'ok' END AS verdict FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
        "q18_redact_strip": f"SELECT doc_id, regexp_replace(text, '(?i){ONE}', '', 'g') AS text FROM documents",
        "q19_redact_erase": f"""SELECT doc_id, array_to_string(list_transform(list_zip(string_split_regex(text, p), list_append(list_transform(regexp_extract_all(text, p), lambda z: repeat(' ', length(z))), '')), lambda z: z[1] || z[2]), '') AS text
          FROM (SELECT *, '(?i){QUERY.replace(' ', '[\\t-\\r\\x{85}\\p{Z}]+')}' AS p FROM documents)""",
        "q20_redact_fill": f"SELECT doc_id, regexp_replace(text, '(?i){ONE}', '{'█' * len(ONE)}', 'g') AS text FROM documents",
        "q22_kern_runs": """WITH g AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS gone, sum(CAST(l_quantity AS BIGINT) * 10) AS width FROM lineitem GROUP BY ALL),
          n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM g), r AS (SELECT *, k - row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS isl FROM n WHERE gone)
          SELECT l_orderkey, CAST(min(k) AS BIGINT) AS first, count(*) AS n, CAST(-sum(width) AS BIGINT) AS kern FROM r GROUP BY l_orderkey, isl""",
        "q23_operator_allowlist": f"""WITH o AS (SELECT user_id, event_id, [{', '.join(f"'{x}'" for x in _OPS)}][event_id % 10 + 1] AS op FROM events),
          s AS (SELECT *, sum(CASE op WHEN 'BX' THEN 1 WHEN 'EX' THEN -1 ELSE 0 END) OVER w AS s FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
          f AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS f FROM s)
          SELECT user_id, event_id, op FROM f WHERE s - f <= 0 AND op IN ('sh', 'd0')""",
        "q24_path_bounds": """WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS p, event_id % 613 AS x, event_id * 7 % 797 AS y FROM events),
          n AS (SELECT *, sum(CAST(p AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) - CAST(p AS INT) AS path FROM e),
          b AS (SELECT user_id, path, min(x) FILTER (NOT p) - 2 AS x0, min(y) FILTER (NOT p) - 2 AS y0, max(x) FILTER (NOT p) + 2 AS x1, max(y) FILTER (NOT p) + 2 AS y1, count(*) FILTER (NOT p) AS n_points FROM n GROUP BY ALL HAVING bool_or(p))
          SELECT user_id, CAST(path AS BIGINT) AS path, x0, y0, x1, y1, n_points, greatest(x0, 200) < least(x1, 400) AND greatest(y0, 200) < least(y1, 420) AS hit FROM b WHERE n_points > 0""",
        "q25_image_overlap": """WITH i AS (SELECT p_partkey, CAST(p_partkey % 400 AS DOUBLE) AS x, CAST(p_partkey * 3 % 500 AS DOUBLE) AS y, CAST(p_size * 8 AS DOUBLE) AS w, CAST(p_size * 6 + 10 AS DOUBLE) AS h FROM part),
          c AS (SELECT *, greatest(150.0::DOUBLE, x) AS a0, least(330.0::DOUBLE, x + w) AS a1, greatest(120.0::DOUBLE, y) AS b0, least(300.0::DOUBLE, y + h) AS b1 FROM i),
          d AS (SELECT *, w * h - 0.0 AS det, a0 < a1 AND b0 < b1 AS on_it FROM c),
          e AS (SELECT *, CASE WHEN on_it THEN least(greatest(h / det * a0 + (0.0 * y - h * x) / det, 0.0), 1.0) END AS u0, CASE WHEN on_it THEN least(greatest(h / det * a1 + (0.0 * y - h * x) / det, 0.0), 1.0) END AS u1,
            CASE WHEN on_it THEN least(greatest(w / det * b0 + (0.0 * x - w * y) / det, 0.0), 1.0) END AS v0, CASE WHEN on_it THEN least(greatest(w / det * b1 + (0.0 * x - w * y) / det, 0.0), 1.0) END AS v1 FROM d),
          f AS (SELECT *, CASE WHEN NOT on_it THEN 'none' WHEN u0 <= 1e-6 AND v0 <= 1e-6 AND u1 >= 1 - 1e-6 AND v1 >= 1 - 1e-6 THEN 'full' ELSE 'partial' END AS hit FROM e)
          SELECT p_partkey, hit, CASE WHEN hit = 'partial' THEN CAST(floor(u0 * 64) AS BIGINT) END AS px0, CASE WHEN hit = 'partial' THEN CAST(floor((1 - v1) * 48) AS BIGINT) END AS py0,
            CASE WHEN hit = 'partial' THEN CAST(ceil(u1 * 64) AS BIGINT) END AS px1, CASE WHEN hit = 'partial' THEN CAST(ceil((1 - v0) * 48) AS BIGINT) END AS py1 FROM f""",
        "q26_image_pixel_template": f"""WITH c AS (SELECT p_partkey, CAST(p_partkey % 256 AS DOUBLE) AS r, CAST(p_partkey * 7 % 256 AS DOUBLE) AS g, CAST(p_partkey * 31 % 256 AS DOUBLE) AS b FROM part),
          k AS (SELECT *, 1 - greatest(r, g, b) / 255.0::DOUBLE AS k FROM c)
          SELECT p_partkey, CAST(floor((0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) + 0.5) AS BIGINT) AS gray,
            {', '.join(f"CAST(CASE WHEN k >= 1.0 THEN 0 ELSE floor(((1 - {v} / 255.0::DOUBLE - k) / (1 - k)) * 255.0 + 0.5) END AS BIGINT) AS {n}" for v, n in (('r', 'cyan'), ('g', 'magenta'), ('b', 'yellow')))}, CAST(floor(k * 255.0 + 0.5) AS BIGINT) AS black FROM k""",
        "q27_annotation_removal": """WITH a AS (SELECT c_custkey, ['Link', 'Text', 'FileAttachment', 'Widget'][c_nationkey % 4 + 1] AS subtype, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 600 END AS x, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 3 % 780 END AS y FROM customer)
          SELECT c_custkey, subtype, NOT (subtype = 'FileAttachment' OR (x IS NULL AND subtype <> 'Link') OR (x IS NOT NULL AND greatest(x, 100) < least(x + 40, 300) AND greatest(y, 100) < least(y + 20, 500))) AS kept FROM a""",
        "q28_overlay_label": f"""WITH i AS (SELECT p_partkey, p_partkey % 400 AS x, p_partkey * 3 % 500 AS y, p_size * 6 + 10 AS h, CAST(p_partkey % 256 AS DOUBLE) AS r, CAST(p_partkey * 7 % 256 AS DOUBLE) AS g, CAST(p_partkey * 31 % 256 AS DOUBLE) AS b FROM part),
          s AS (SELECT *, least(greatest(0.6::DOUBLE * h, 4.0), 14.0) AS s FROM i)
          SELECT p_partkey, CAST(floor(s * 1000 + 0.5) AS BIGINT) AS label_size, CAST(floor((x + 0.25::DOUBLE * s) * 1000 + 0.5) AS BIGINT) AS label_x, CAST(floor((y + 0.2::DOUBLE * s) * 1000 + 0.5) AS BIGINT) AS label_y,
            CASE WHEN {lum.replace('0.299', '0.299::DOUBLE').replace('0.587', '0.587::DOUBLE').replace('0.114', '0.114::DOUBLE')} / 255.0::DOUBLE < 0.5 THEN 'white' ELSE 'black' END AS label_color FROM s""",
        "q29_hidden_set": """WITH a AS (SELECT n_regionkey AS doc, n_nationkey AS layer, n_regionkey IN (1, 2, 3) AND (n_regionkey % 2 = 1 OR n_regionkey = 2) AS off_base FROM nation),
          h AS ((SELECT doc, layer FROM a WHERE off_base EXCEPT SELECT doc, layer FROM a WHERE layer % 4 = 0) UNION SELECT doc, layer FROM a WHERE NOT off_base AND layer % 3 = 0)
          SELECT CAST(doc AS BIGINT) AS doc, CAST(layer AS BIGINT) AS layer FROM h""",
        "q30_strip_hidden": """WITH RECURSIVE o AS (SELECT user_id, event_id, event_id % 17 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
          f AS (SELECT user_id, event_id, rn, CASE WHEN k IN (3, 8) THEN 1 ELSE 0 END AS d, CASE WHEN k = 3 THEN 1 ELSE 0 END AS h, k = 3 AS hidden FROM o WHERE rn = 1
            UNION ALL SELECT o.user_id, o.event_id, o.rn, CASE WHEN k IN (3, 8) THEN d + 1 WHEN k IN (5, 12) THEN greatest(d - 1, 0) ELSE d END,
              CASE WHEN k = 3 AND h = 0 THEN d + 1 WHEN k IN (5, 12) AND h = d THEN 0 ELSE h END, h > 0 OR k = 3 FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
          SELECT user_id, count(*) AS n_ops, CAST(sum(CAST(hidden AS INT)) AS BIGINT) AS n_hidden, min(event_id) FILTER (hidden) AS first_hidden FROM f GROUP BY ALL""",
        "q31_reachability": """WITH RECURSIVE e AS (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part), r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 97 = 0
          UNION SELECT dst FROM r JOIN e ON src = node WHERE dst > 0) SELECT node FROM r""",
        "q32_latest_revision": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "q33_attachment_anti": "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)",
        "q34_html_sanitize": "SELECT page_id, " + _replaced("html", [(p, "") for p in sanitize.HTML_PATTERNS]) + " AS html FROM pages",
        "q35_pii_redact": "SELECT doc_id, " + _replaced("text", sanitize.PII_PATTERNS) + " AS text, CAST(" + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p, _ in sanitize.PII_PATTERNS) + " AS BIGINT) AS n_found FROM documents",
        "q36_apply_report": f"""WITH {_spans(QUERY)}, c AS (SELECT doc_id, count(DISTINCT page_index) AS pages_touched, count(DISTINCT (page_index, match_index)) AS matches FROM r GROUP BY ALL),
          g AS (SELECT doc_id, count(*) AS glyphs_removed FROM (SELECT DISTINCT doc_id, page_index, line_no, unnest(range(CAST(first_col AS BIGINT), CAST(last_col AS BIGINT) + 1)) FROM r) GROUP BY ALL)
          SELECT * FROM c JOIN g USING (doc_id)""",
        "q37_objstm_chunk": """WITH o AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS num FROM lineitem), k AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY num) - 1) // 100 AS chunk FROM o)
          SELECT doc, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(num) AS first_num, max(num) AS last_num FROM k GROUP BY ALL""",
        "q38_xref_offsets": """WITH o AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS num FROM lineitem)
          SELECT doc, num, num % 50 + 20 AS length, CAST(15 + coalesce(sum(num % 50 + 20) OVER (PARTITION BY doc ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM o""",
        "q41_matrix_algebra": """WITH k AS (SELECT p_partkey, p_partkey % 7 + 1 AS s, p_partkey % 4 AS q, p_partkey % 50 AS tx, p_partkey % 30 AS ax, p_partkey % 20 AS ay, p_partkey % 600 - 10 AS cx FROM part),
          z AS (SELECT *, CASE q WHEN 0 THEN ax * s WHEN 1 THEN -2 * ay WHEN 2 THEN -ax * s ELSE 2 * ay END AS mx, CASE q WHEN 0 THEN 2 * ay WHEN 1 THEN ax * s WHEN 2 THEN -2 * ay ELSE -ax * s END AS my FROM k)
          SELECT p_partkey, mx + tx AS x, CAST(my + 5 AS BIGINT) AS y, ax AS bx, ay AS by,
            CASE q WHEN 0 THEN tx WHEN 1 THEN tx - 8 WHEN 2 THEN tx - 10 * s ELSE tx END AS rx0, CAST(CASE q WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN -3 ELSE 5 - 10 * s END AS BIGINT) AS ry0,
            CASE q WHEN 0 THEN tx + 10 * s WHEN 1 THEN tx WHEN 2 THEN tx ELSE tx + 8 END AS rx1, CAST(CASE q WHEN 0 THEN 13 WHEN 1 THEN 5 + 10 * s WHEN 2 THEN 5 ELSE 5 END AS BIGINT) AS ry1,
            CAST(CASE q WHEN 0 THEN cx WHEN 1 THEN 792 - 10 WHEN 2 THEN 612 - cx ELSE 10 END AS BIGINT) AS px, CAST(CASE q WHEN 0 THEN 10 WHEN 1 THEN cx WHEN 2 THEN 792 - 10 ELSE 612 - cx END AS BIGINT) AS py FROM z""",
        "q42_rect_algebra": f"""WITH r AS (SELECT p_partkey AS k, p_partkey % 300 AS x, p_partkey * 7 % 300 AS y, p_partkey % 41 - 20 AS w, p_partkey % 31 - 15 AS h FROM part),
          n AS (SELECT *, least(x, x + w) AS x0, least(y, y + h) AS y0, greatest(x, x + w) AS x1, greatest(y, y + h) AS y1 FROM r), z AS (SELECT *, greatest(x0, 100) < least(x1, 260) AND greatest(y0, 80) < least(y1, 240) AS hit FROM n)
          SELECT k AS p_partkey, least(x0, 100) AS ux0, least(y0, 80) AS uy0, greatest(x1, 260) AS ux1, greatest(y1, 240) AS uy1, CASE WHEN hit THEN greatest(x0, 100) END AS cx0, CASE WHEN hit THEN greatest(y0, 80) END AS cy0,
            CASE WHEN hit THEN least(x1, 260) END AS cx1, CASE WHEN hit THEN least(y1, 240) END AS cy1, hit, x BETWEEN 100 AND 260 AND y BETWEEN 80 AND 240 AS inside FROM z""",
        "q43_match_targets": f"WITH {_spans(QUERY)}, {_TARGETS} SELECT * FROM tg",
        "q44_page_search_hits": f"""WITH {_spans(QUERY)}, {_TARGETS}, it AS (SELECT doc_id, page_index, size, 720 AS x0, 7188 - 120 * line_no AS y0, 720 + 60 * size AS x1, 7268 - 120 * line_no AS y1 FROM s WHERE size > 0)
          SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, count(*) AS n_items, CAST(sum(size) AS BIGINT) AS n_chars FROM it
          WHERE EXISTS (SELECT 1 FROM tg WHERE tg.doc_id = it.doc_id AND tg.page_index = it.page_index AND {_HIT.format('it', 'tg')}) GROUP BY ALL""",
        "q45_number_format": r"""WITH v AS (SELECT DISTINCT l_partkey, l_partkey * 125 - 40000 AS m FROM lineitem)
          SELECT l_partkey, CASE WHEN m < 0 THEN '-' ELSE '' END || CAST(abs(m) // 1000 AS VARCHAR) || CASE WHEN abs(m) % 1000 = 0 THEN '' ELSE rtrim('.' || lpad(CAST(abs(m) % 1000 AS VARCHAR), 3, '0'), '0') END AS number,
            '(a\(b\)\\' || CAST(l_partkey AS VARCHAR) || ')' AS literal FROM v""",
        "q46_aes_decrypt": "SELECT c_custkey, c_name AS name FROM customer",
        "q47_object_key": """SELECT p_partkey, substr(md5(unhex('0011223344' || lpad(printf('%X', p_partkey & 255), 2, '0') || lpad(printf('%X', (p_partkey >> 8) & 255), 2, '0') || lpad(printf('%X', (p_partkey >> 16) & 255), 2, '0') || '0000')), 1, 20) AS key FROM part""",
        "q39_filters_roundtrip": "SELECT doc_id, unnest(['FlateDecode', 'LZWDecode', 'ASCII85Decode', 'ASCIIHexDecode', 'RunLengthDecode', 'Paeth']) AS filter, true AS same FROM documents",
        "q40_pdf_roundtrip": f"""WITH {_spans(QUERY)}, c AS (SELECT doc_id, count(DISTINCT page_index) AS n FROM r GROUP BY ALL),
          g AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, page_index, line_no, unnest(range(CAST(first_col AS BIGINT), CAST(last_col AS BIGINT) + 1)) FROM r) GROUP BY ALL)
          SELECT d.doc_id, coalesce(c.n, 0) AS pages_touched, coalesce(g.n, 0) AS text_glyphs_removed, true AS saved, CAST(NULL AS VARCHAR) AS error FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id""",
        "q55_pdf_things": """WITH k AS (SELECT p_partkey, p_partkey % 2 = 1 AS notes, 20 * (p_partkey % 17) AS x, 25 * (p_partkey % 19) AS y FROM part),
          h AS (SELECT *, y < 420 + 6.8 AND y + 60 > 420 - 1.2 AS on_line, x < 140.5 AND x + 60 > 99.5 AND y < 230.5 AND y + 60 > 199.5 AS on_path, x < 250 AND x + 60 > 210 AND y < 340 AND y + 60 > 300 AS on_image,
            x <= 210 AND x + 60 >= 250 AND y <= 300 AND y + 60 >= 340 AS whole, x < 340 AND x + 60 > 300 AND y < 120 AND y + 60 > 100 AS on_note FROM k)
          SELECT p_partkey, CAST(CASE WHEN on_line THEN greatest(0, least(12, ceil((x + 60 - 72) / 6.0)) - greatest(0, floor((x - 72) / 6.0))) ELSE 0 END AS BIGINT) AS text_glyphs_removed, CAST(on_path AS BIGINT) AS path_paints_removed,
            CAST(on_image AND whole AS BIGINT) AS image_draws_removed, CAST(on_image AND NOT whole AS BIGINT) AS image_draws_masked, CAST(notes AND on_note AS BIGINT) AS annotations_removed, CAST(NULL AS VARCHAR) AS error FROM h""",
        "q49_pdf_search": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS x FROM documents),
          s AS (SELECT doc_id, n, x, string_split_regex(x, '(?i)the') AS parts FROM l WHERE regexp_matches(x, '(?i)the')),
          m AS (SELECT doc_id, n, x, k, CAST(list_sum(list_transform(parts[1:k], lambda z: length(z))) AS BIGINT) + 3 * (k - 1) AS c FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM s))
          SELECT doc_id, CAST(n // 50 AS BIGINT) AS page_index, CAST(row_number() OVER (PARTITION BY doc_id, n // 50 ORDER BY n, k) - 1 AS BIGINT) AS match_index, substr(x, c + 1, 3) AS text, CAST(1 AS BIGINT) AS n_quads,
            CAST(720 + 60 * c AS BIGINT) AS x0, CAST(7188 - 120 * (n % 50) AS BIGINT) AS y0, CAST(900 + 60 * c AS BIGINT) AS x1, CAST(7268 - 120 * (n % 50) AS BIGINT) AS y1 FROM m""",
        "q50_pdf_objects": """WITH p AS (SELECT doc_id, unnest(range(0, (coalesce(len(string_split(text, chr(10))), 1) + 49) // 50)) AS i FROM documents)
          SELECT doc_id, num, CAST(0 AS BIGINT) AS gen, 'value' AS kind, type FROM documents, (VALUES (CAST(1 AS BIGINT), 'Catalog'), (2, 'Pages'), (5, 'Font')) v(num, type)
          UNION ALL SELECT doc_id, CAST(20 + 2 * i AS BIGINT), 0, 'value', 'Page' FROM p UNION ALL SELECT doc_id, CAST(21 + 2 * i AS BIGINT), 0, 'stream', NULL FROM p""",
        "q51_plan_per_document": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE CAST(greatest(0, least(coalesce(length(string_split(text, chr(10))[doc_id % 4 + 1]), 0) - doc_id % 5, 10)) AS BIGINT) END AS text_glyphs_removed,
          CASE WHEN doc_id % 11 = 0 THEN 'UnsupportedOption' WHEN doc_id % 7 = 0 THEN 'InvalidPageIndex' END AS error FROM documents""",
        "q52_fonts_of_documents": f"""WITH {_base_char()}, c AS (SELECT event_id, user_id % 40 AS font, event_id % 256 AS code, event_id % 256 + user_id % 40 AS n, ['{"', '".join(encodings.NAMES)}'][user_id % 3 + 1] AS encoding FROM events)
          SELECT event_id, font, CAST(c.code AS BIGINT) AS code, encoding, CASE WHEN n % 7 = 0 THEN chr(CAST(945 + n % 20 AS INT)) WHEN n % 5 = 0 THEN chr(CAST(1040 + n % 30 AS INT)) ELSE coalesce(ch, chr(65533)) END AS ch,
            CAST(CASE WHEN c.code BETWEEN 32 AND 126 THEN 250 + n ELSE 600 END AS BIGINT) AS width FROM c LEFT JOIN enc USING (encoding, code)""",
        "q53_decrypt_documents": """SELECT r_regionkey, v, r, method, CASE WHEN r_regionkey % 3 < 2 THEN r_name END AS text, CASE WHEN r_regionkey % 3 = 2 THEN 'InvalidPassword' END AS error
          FROM region, (VALUES (1, 2, 'V2'), (2, 3, 'V2'), (4, 4, 'V2'), (4, 4, 'AESV2'), (5, 5, 'AESV3'), (5, 6, 'AESV3')) h(v, r, method)""",
        "q54_quad_transform": """WITH k AS (SELECT p_partkey, p_partkey % 4 AS q, p_partkey % 50 AS tx, p_partkey % 30 AS x, unnest(CASE WHEN p_partkey % 3 = 2 THEN [0, 1] ELSE [0] END) AS n FROM part)
          SELECT p_partkey, CAST(n AS BIGINT) AS n, CAST(tx + CASE q WHEN 0 THEN x WHEN 1 THEN -4 WHEN 2 THEN -x - 10 ELSE 0 END AS BIGINT) AS x0, CAST(5 + CASE q WHEN 0 THEN 0 WHEN 1 THEN x WHEN 2 THEN -4 ELSE -x - 10 END AS BIGINT) AS y0,
            CAST(tx + CASE q WHEN 0 THEN x + 10 WHEN 1 THEN 0 WHEN 2 THEN -x ELSE 4 END AS BIGINT) AS x1, CAST(5 + CASE q WHEN 0 THEN 4 WHEN 1 THEN x + 10 WHEN 2 THEN 0 ELSE -x END AS BIGINT) AS y1,
            CAST(tx + CASE q WHEN 0 THEN x WHEN 1 THEN 0 WHEN 2 THEN -x ELSE 0 END AS BIGINT) AS first_x FROM k""",
        "q48_conversation_search": f"WITH {_PAGES.replace('FROM documents', 'FROM (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')} SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, CAST((length(norm) - length(replace(norm, '{ONE}', ''))) // {len(ONE)} AS BIGINT) AS n_matches FROM i WHERE contains(norm, '{ONE}')",
    }
    both = f"WITH {_spans(ONE)}"
    other = _spans(QUERY)[len(_PAGES) + 1 :]
    for name in ("m", "k", "a", "s", "r"):  # the second query's steps, under names of their own
        other = other.replace(f"\n{name} AS (", f"\n{name}2 AS (").replace(f" FROM {name} JOIN", f" FROM {name}2 JOIN").replace(f" JOIN {name} ON", f" JOIN {name}2 ON").replace(f" {name}.", f" {name}2.").replace(f"SELECT {name}.", f"SELECT {name}2.")
    other = other.replace("FROM a2 JOIN s2 ON a2.doc_id = s2.doc_id", "FROM a2 JOIN s2 ON a2.doc_id = s2.doc_id")
    sql["q21_removed_count"] = f"""{both}, {other}, g AS (SELECT DISTINCT doc_id, page_index, line_no, unnest(range(CAST(first_col AS BIGINT), CAST(last_col AS BIGINT) + 1)) FROM (SELECT * FROM r UNION ALL SELECT * FROM r2))
      SELECT doc_id, count(*) AS glyphs_removed FROM g GROUP BY ALL"""
    return sql


_TARGETS = """tg AS (SELECT doc_id, CAST(page_index AS BIGINT) AS page_index, CAST(match_index AS BIGINT) AS target_index, 'quadGroup' AS kind, CAST(min(720 + 60 * first_col) AS BIGINT) AS x0, CAST(min(7188 - 120 * line_no) AS BIGINT) AS y0,
  CAST(max(780 + 60 * last_col) AS BIGINT) AS x1, CAST(max(7268 - 120 * line_no) AS BIGINT) AS y1 FROM r GROUP BY doc_id, page_index, match_index
  UNION ALL SELECT doc_id, 0, -1, 'rect', 700, 6950, 1650, 7250 FROM documents WHERE text IS NOT NULL)"""


def _replaced(column: str, patterns) -> str:
    for p, with_ in patterns:
        column = f"regexp_replace({column}, '{p}', '{with_}', 'g')"
    return column
