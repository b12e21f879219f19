"""Pages read run by run: as glyph by glyph, without making glyphs; and documents dealt over all cores."""

from __future__ import annotations

import random

from veilframe.pdf import builder, layout, reader, redactor
from veilframe.plans import pdf_queries

WORDS = ["the", "th", "The", "la", "a(b)", "é", "", "  ", "th the"]


def _page(content: bytes) -> layout.Layout:
    return layout.layout(reader.build(builder.assemble([content])), 0)


def _shown(rnd: random.Random) -> bytes:
    lit = lambda s: b"<" + s.encode("cp1252").hex().encode() + b">"
    if rnd.random() < 0.5:
        return lit(" ".join(rnd.choices(WORDS, k=rnd.randint(0, 4)))) + b" Tj"
    return b"[" + b" ".join(rnd.choice([lit(rnd.choice(WORDS)), b"-600", b"300", b"-7.5"]) for _ in range(5)) + b"] TJ"


def test_runs_give_what_glyphs_give():
    rnd, ways = random.Random(3), set()
    for _ in range(300):
        ops = [b"BT /F1 10 Tf 12 TL 72 700 Td"]
        for _ in range(rnd.randint(1, 8)):
            ops.append(rnd.choice([_shown(rnd), _shown(rnd), b"T*", b"0 -12 Td", b"0.5 Tc", b"3 Tw", b"3 Tr", b"0 Tr", b"0 -0.4 Td", b"-30 0 Td", b"-1 Tc", b"0 Tc"]))
        found = _page(b"\n".join([*ops, b"ET"]))
        ways.add(layout._rows(found) is None)
        for q in ("the", "th the", " La "):
            same = lambda ms: [(m.text, m.quads) for m in ms]
            assert same(layout.search(found, q)) == same(layout._search_glyphs(found, q.strip().lower(), 0))
        boxes = [(x, 690.0, x + 20, 705.0) for x in (72.0, 90.5, 140.0)]
        met = [g for g in found.glyphs if any(layout.meets((g.box[0], g.box[1], max(g.box[2], g.box[0] + 1e-9), g.box[3]), b) for b in boxes)]
        assert found.hits(boxes) == met
    assert ways == {True, False}  # some pages are told by runs, some not


def test_a_page_makes_glyphs_only_where_it_is_hit():
    found = _page(b"BT /F1 10 Tf 12 TL 72 700 Td (" + b"words of a line, " * 20 + b") Tj T* (Find th the place) Tj ET")
    match = layout.search(found, "th the")
    assert [m.quads for m in match] == [[(102.0, 686.8, 138.0, 694.8)]]
    assert len(found.hits(match[0].quads)) == 6
    assert all(isinstance(p, layout.Run) for p in found.parts) and "glyphs" not in vars(found)


def test_a_plan_shares_nothing_with_its_document():
    doc = reader.build(builder.assemble([b"BT /F1 10 Tf 72 700 Td (Secret) Tj ET"] * 2))
    before = repr(doc.file)
    new, report = redactor.apply(doc, [redactor.Target(0, [(70, 690, 90, 710)])])
    assert report.text_glyphs_removed == 3 and repr(doc.file) == before and repr(new.file) != before


def test_few_files_are_dealt_over_all_cores(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions() < cores
    assert pdf_queries.q40_pdf_roundtrip(spark, sf).rdd.getNumPartitions() >= 2 * cores


def test_small_documents_of_one_file_are_dealt_over_all_cores(spark, sf):
    assert pdf_queries.q55_pdf_things(spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_plain_and_odd_syntax_are_read_alike():
    from veilframe.pdf.lexer import Lexer, serialise
    from veilframe.pdf.model import Name, Ref

    want = {"A": 1, "B": Ref(2, 0), "C": Name("D"), "E": [0, 0, 612, 792], "F": [Ref(3, 1), 4], "G": {"H": -1.5, "I": b"x"}, "J#": [], "K": None, "L": True}
    plain = b"<< /A 1 /B 2 0 R /C /D /E [0 0 612 792] /F [3 1 R 4] /G << /H -1.5 /I (x) >> /J#23 [] /K null /L true >>"
    odd = b"<</A%c\n1/B\t2\r0\x0cR/C/#44/E[ 0\x000 612 792 %]\n]/F[3 1 R 4]/G<</H -1.5/I<78>>>/J#23[]/K null/L true>>"
    assert Lexer(plain).value() == Lexer(odd).value() == Lexer(serialise(want)).value() == want
    assert Lexer(b"[3 1 4]", refs=False).value() == [3, 1, 4] and Lexer(b"<< /A 1 /B (R) >>", refs=False).value() == {"A": 1, "B": b"R"}
