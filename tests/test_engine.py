"""Relational operators on hand-computed rows and against brute force."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import text as ft
from veilframe.functions.geometry import Matrix, Rect, page_transform, quad_bounds, rect_from_top_left
from veilframe.operators import graph, redact, sanitize, search, targets, textlayer, visual
from veilframe.operators.targets import Plan

TEXTS = ["The cat sat\non the  THE mat", "", None, "the\n\n\nthe", "a\tb c" + " " + "d", "\n".join(f"line {k} the" for k in range(120)), "thethethe", "ΣΑΣ the É", "日本 the\n𠀀 the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def norm(t):
    return re.sub(r"[\t-\r \x85   -     　]+", " ", t).lower()


def scan(t, q):
    """(page, position) of every match, by a plain scan."""
    out, lines = [], t.split("\n")
    for p in range(0, len(lines), 50):
        page, at = norm("\n".join(lines[p : p + 50])), 0
        while (at := page.find(q, at)) >= 0:
            out.append((p // 50, at))
            at += len(q)
    return out


@pytest.mark.parametrize("query", ["the", " THE  the ", "the line", "zzz", "a b", "t"])
def test_search_is_a_plain_scan(spark, docs, query):
    q = ft.normalise_query(query)
    index = search.index(textlayer.pages(docs))
    want = {(d, p, a) for d, t in enumerate(TEXTS) if t is not None for p, a in scan(t, q)}
    got = {(r.doc_id, r.page_index, r.start) for r in search.positions(index, query).collect()}
    assert got == want
    counts = {(r.doc_id, r.page_index): r.n_matches for r in search.count(index, query).collect()}
    assert sum(counts.values()) == len(want)


def test_empty_queries_match_nothing(docs):
    index = search.index(textlayer.pages(docs))
    for q in ("", "  \n"):
        assert search.count(index, q).count() == search.positions(index, q).count() == search.quads(index, q).count() == 0


def test_quads_cover_the_matched_characters(docs):
    index = search.index(textlayer.pages(docs))
    lines = {(d, k): x for d, t in enumerate(TEXTS) if t is not None for k, x in enumerate(t.split("\n"))}
    for q in ("the", "sat on", "the the"):
        found = {}
        for r in search.quads(index, q).orderBy("doc_id", "page_index", "match_index", "line_no").collect():
            part = lines[r.doc_id, r.page_index * 50 + r.line_no][r.first_col : r.last_col + 1]
            found.setdefault((r.doc_id, r.page_index, r.match_index), []).append(part)
            assert (r.x0, r.x1) == (720 + 60 * r.first_col, 780 + 60 * r.last_col) and r.y1 - r.y0 == 80
        assert found and all(norm(" ".join(v)) == q or norm("".join(v)) == q for v in found.values())


def test_lower_case_agrees_with_the_rule_by_character(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", F.lower("text").alias("low")).collect()
    assert all(r.low == "".join(c.lower() for c in r.text) for r in rows if r.text)


def test_items_and_page_count(docs):
    got = textlayer.items(textlayer.pages(docs)).collect()
    by_page = {}
    for d, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        for p in range(0, len(lines), 50):
            by_page[d, p // 50] = "\n".join(lines[p : p + 50])
    assert all(by_page[r.doc_id, r.page_index][r.char_start : r.char_end] == r.text for r in got)
    counts = {r.doc_id: r.n_pages for r in textlayer.page_count(docs).collect()}
    assert counts[2] == 0 and counts[1] == 1 and counts[5] == 3


@pytest.mark.parametrize("mode", redact.ALLOWED[:0] + ("strip", "erase", "redact"))
def test_text_redaction(docs, mode):
    for q in ("the", "the the"):
        pattern = re.compile(re.escape(q).replace(r"\ ", r"\s+"), re.I)
        fill = {"strip": "", "erase": " ", "redact": "█"}[mode]
        for r in docs.select("text", redact.text(F.col("text"), q, mode).alias("new")).collect():
            assert r.new == (None if r.text is None else pattern.sub(lambda m: fill * len(m[0]), r.text))


def test_removed_glyphs_count_once(spark):
    rows = [(1, 0, 0, 0, 4, 0), (1, 0, 0, 3, 6, 1), (1, 0, 0, 1, 2, 2), (1, 0, 1, 0, 0, 3), (2, 1, 0, 5, 5, 0)]
    spans = spark.createDataFrame(rows, "doc_id long, page_index long, line_no long, first_col long, last_col long, match_index long")
    assert {r.doc_id: r.glyphs_removed for r in redact.removed_count(spans, ["doc_id"]).collect()} == {1: 8, 2: 1}


boxes = st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6), st.integers(0, 6)).map(lambda b: (min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])))


@given(st.lists(st.tuples(st.integers(0, 2), boxes), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 2), boxes), min_size=1, max_size=6))
@settings(max_examples=12, deadline=None)
def test_box_joins_against_brute_force(spark, things, aims):
    schema = "page int, x0 int, y0 int, x1 int, y1 int"
    t = spark.createDataFrame([(p, *b) for p, b in things], schema)
    g = spark.createDataFrame([(p, *b) for p, b in aims], schema)
    meets = lambda a, b: max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])
    want = sorted((p, *b) for p, b in things if any(p == q and meets(b, c) for q, c in aims))
    assert sorted(map(tuple, targets.hits(t, g, ["page"]).collect())) == want
    assert sorted(map(tuple, targets.hits_by_cell(t, g, ["page"], 3).collect())) == want


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_geometry(spark):
    a = Rect.sized(10, 10, -4, 6)
    r = one(spark, n=F.array(a.x0, a.y0, a.x1, a.y1), touch=Rect.of(0, 0, 1, 1).intersects(Rect.of(1, 0, 2, 1)), edge=Rect.of(0, 0, 1, 1).contains(1, 1), clip=Rect.of(0, 0, 4, 4).clip(Rect.of(2, 2, 9, 9)).x1, none=Rect.of(0, 0, 1, 1).clip(Rect.of(2, 2, 9, 9)).x1)
    assert (r.n, r.touch, r.edge, r.clip, r.none) == ([6, 10, 10, 16], False, True, 4, None)
    m = Matrix.scale(2.0, 3.0).then(Matrix.rotate(90)).then(Matrix.translate(5.0, 7.0))
    x, y = m.point(1.0, 1.0)
    bx, by = m.inverse().point(x, y)
    q = quad_bounds(Rect.of(1, 2, 3, 4).quad())
    flat = Matrix.of(1.0, 1.0, 1.0, 1.0, 0.0, 0.0).inverse().a
    px, py = page_transform(Rect.of(10.0, 20.0, 110.0, 70.0), F.lit(90)).point(10.0, 20.0)
    top = rect_from_top_left(1, 2, 3, 4, 100)
    r = one(spark, x=x, y=y, bx=bx, by=by, q=F.array(q.x0, q.y0, q.x1, q.y1), flat=flat, px=px, py=py, top=top.y0)
    assert (r.x, r.y) == (2.0, 9.0) and (round(r.bx, 9), round(r.by, 9)) == (1, 1)
    assert (r.q, r.flat, r.px, r.py, r.top) == ([1, 2, 3, 4], None, 50.0, 0.0, 94)


def test_numbers_and_literals(spark):
    r = one(spark, a=ft.number(F.lit(1.5)), b=ft.number(F.lit(-0.0000001)), c=ft.number(F.lit(100.0)), d=ft.number(F.lit(0.12345), 4), e=ft.literal(F.lit("a(b)\\")))
    assert list(r) == ["1.5", "0", "100", "0.1235", "(a\\(b\\)\\\\)"]


def test_first_fit_keeps_its_anchor():
    # The anchor stays where the line opened; a glyph to the left opens another line.
    assert visual.cluster([100.0, 99.5, 99.1, 98.9], [10.0] * 4, [0.0, 10.0, 20.0, 30.0]) == [0, 0, 0, 1]
    assert visual.cluster([100.0, 100.0, 100.0], [10.0] * 3, [50.0, 60.0, 0.0]) == [0, 0, 1]
    rng = random.Random(5)
    for _ in range(200):
        g = sorted(((rng.choice([0, 0.3, 1, 2]) + 10 * rng.randint(0, 5), rng.choice([2, 8, 20]), rng.randint(0, 60)) for _ in range(30)), key=lambda x: (-x[0], x[2]))
        assert visual.cluster(*map(list, zip(*g))) == _plain_cluster(g)


def _plain_cluster(glyphs):
    lines, out = [], []
    for c, h, x in glyphs:
        k = next((k for k, (a, t, r) in enumerate(lines) if abs(c - a) + 1e-6 < 0.1 * max(t, h) and x + 1.0 >= r), None)
        if k is None:
            lines.append((c, max(h, 1.0), x))
            k = len(lines) - 1
        else:
            lines[k] = (lines[k][0], max(lines[k][1], h), x)
        out.append(k)
    return out


def test_merge_of_match_boxes():
    assert visual.merge([(0, 0, 5, 10), (6, 1, 9, 11), (30, 0, 35, 10), (0, -20, 5, -10)]) == [(0, 0, 9, 11), (30, 0, 35, 10), (0, -20, 5, -10)]


def test_page_tree_inheritance_and_cycles(spark):
    nodes = spark.createDataFrame([(0, None, 0), (1, 0, 90), (2, 1, None), (3, 9, 1), (9, 3, 1)], "node long, parent long, rotate long")
    found = {r.node: (r.depth, r.rotate, r.error) for r in graph.inherit(nodes, ["rotate"]).collect()}
    assert found == {0: (0, 0, None), 1: (1, 90, None), 2: (2, 90, None), 3: (None, 1, "Corrupt"), 9: (None, 1, "Corrupt")}


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=15), st.sets(st.integers(0, 9), min_size=1, max_size=3))
@settings(max_examples=6, deadline=None)
def test_reachability(spark, edges, roots):
    e = spark.createDataFrame(edges, "src long, dst long")
    seen, todo = set(roots), list(roots)
    while todo:
        n = todo.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                todo.append(b)
    assert {r.node for r in graph.reachable(e, spark.createDataFrame([(r,) for r in roots], "node long")).collect()} == seen


def test_hidden_sections(spark):
    ops = ["x", "H", "a", "B", "b", "E", "c", "E", "d", "B", "H", "e", "E", "f", "E", "E", "g"]
    df = spark.createDataFrame([(1, i, o) for i, o in enumerate(ops)], "page int, at int, op string")
    got = sanitize.hidden_sections(df, ["page"], ["at"], F.col("op") == "H", F.col("op") == "B", F.col("op") == "E").orderBy("at").collect()
    assert "".join(r.op for r in got if not r.hidden) == "xdBfEEg"


def test_plans(spark):
    assert Plan() == Plan.from_json({}) and Plan.from_json({"mode": "erase", "fillColor": {"r": 1, "g": 2, "b": 3}}).fill == (1, 2, 3)
    for bad in ({"mode": "blur"}, {"overlayText": "  "}, {"overlayText": "x", "mode": "strip"}):
        with pytest.raises(ValueError, match="UnsupportedOption"):
            Plan.from_json(bad)
    df = spark.createDataFrame([('{"targets":[{"kind":"rect","pageIndex":1,"x":1,"y":2,"width":3,"height":4}],"stripMetadata":true}',)], "json string")
    p = targets.parse_plans(df, "json").first().plan
    assert (p.mode, p.stripMetadata, p.removeIntersectingAnnotations, p.targets[0].pageIndex) == ("redact", True, True, 1)


def test_personal_data_and_pages(spark):
    r = one(spark, pii=sanitize.pii(F.lit('a.b@c.org 10.0.0.1 token = "ab12"')), html=sanitize.html(F.lit('<!-- x\n --><p>a<script src="y">z</script><style>q</style><meta charset="u"><b style="display: none">h</b></p>')))
    assert r.pii == '[EMAIL] [IP] token = "[SECRET]"' and r.html == "<p>a</p>"


def test_operators_outside_the_list(spark):
    ops = ["q", "sh", "BX", "sh", "EX", "EX", "d0", "BX", "BX", "EX", "zz", "EX", "zz"]
    df = spark.createDataFrame([(1, i, o) for i, o in enumerate(ops)], "page int, at int, op string")
    assert [r.at for r in redact.disallowed(df, ["page"], ["at"]).orderBy("at").collect()] == [1, 6, 12]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129, 5000])
def test_matches_of_one_endless_line(spark, n):
    df = spark.createDataFrame([(1, "xyAa" * n + "end")], "doc_id long, text string")
    got = search.positions(search.index(textlayer.pages(df)), "yaa").orderBy("match_index").collect()
    assert [(r.match_index, r.start) for r in got] == [(k, 4 * k + 1) for k in range(n)]


def test_hidden_sections_are_those_of_a_fold(spark):
    rng, rows = random.Random(4), []
    for page in range(6):
        rows += [(page, i, rng.choice([2, 2, 1, -1, -1, -1, 0])) for i in range(300)]
    want = {}
    for page in range(6):
        depth = begun = 0
        for _, i, k in (r for r in rows if r[0] == page):
            want[page, i] = begun > 0 or k == 2
            if k > 0:
                depth += 1
                begun = depth if k == 2 and not begun else begun
            elif k < 0:
                begun = 0 if begun == depth else begun
                depth = max(0, depth - 1)
    df = spark.createDataFrame(rows, "page int, i int, k int").repartition(3)
    got = sanitize.hidden_sections(df, ["page"], ["i"], F.col("k") == 2, F.col("k") == 1, F.col("k") == -1)
    assert {(r.page, r.i): r.hidden for r in got.collect()} == want
