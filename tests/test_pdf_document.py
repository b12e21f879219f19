"""Whole documents: build, open, look, redact, save, open again; and the bytes that must not be left."""

from __future__ import annotations

import hashlib

import pytest

from veilframe.pdf import builder, content, crypto, filters, fonts, layout, reader, writer
from veilframe.pdf.document import PdfDocument, search_targets
from veilframe.pdf.lexer import serialise
from veilframe.pdf.model import File, Name, PdfError, Ref, Stream

SIMPLE = b"BT /F1 24 Tf 72 700 Td (Secret Alpha) Tj 0 -32 Td (Beta Gamma) Tj ET"
RECT = {"kind": "rect", "pageIndex": 0, "x": 70, "y": 695, "width": 95, "height": 30}


def doc_of(contents, **more):
    return PdfDocument.open(writer.save(builder.assemble([contents] if isinstance(contents, bytes) else contents, **more)))


def decoded(data: bytes) -> bytes:
    """Every object of saved bytes with streams decoded: what a finder of leftovers would read."""
    file = reader.parse(data)
    return b"\n".join(serialise(v.dict) + filters.decode(v.data, v.dict, file.resolve) if isinstance(v, Stream) else serialise(v) for v in file.objects.values())


def image(w=32, h=32, n=3, **more):
    space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name(space)} | more, b"\xc8" * (w * h * n))


@pytest.mark.parametrize("form", ["classic", "stream"])
def test_extract_and_box(form):
    d = doc_of(SIMPLE, form=form)
    assert d.page_count() == 1 and d.page_size(0) == (612, 792)
    got = d.extract_text(0)
    assert got["text"] == "Secret Alpha\nBeta Gamma"
    assert [(i.text, i.char_start, i.char_end) for i in got["items"]] == [("Secret Alpha", 0, 12), ("Beta Gamma", 13, 23)]
    assert d._layout(0).glyphs[0].box == pytest.approx((72, 697.12, 86.4, 716.32))


@pytest.mark.parametrize("form", ["classic", "stream"])
@pytest.mark.parametrize("mode", ["strip", "erase", "redact"])
def test_modes(form, mode):
    d = doc_of(SIMPLE, form=form)
    before = d.search_text(0, "alpha")[0].quads
    report = d.apply_redactions({"targets": [RECT], "mode": mode})
    assert report.text_glyphs_removed == 7 and report.pages_touched == 1
    out = d.save()
    again = PdfDocument.open(out)
    assert again.search_text(0, "secret") == [] and again.search_text(0, "beta gamma")
    assert b"Secret" not in decoded(out)
    after = again.search_text(0, "alpha")[0].quads
    assert (after == [pytest.approx(b) for b in before]) is (mode != "strip")
    assert (b"re f" in decoded(out)) is (mode == "redact")


def test_search_rules():
    d = doc_of(b"BT /F1 12 Tf 72 700 Td (One  TWO) Tj 0 -20 Td (three) Tj ET")
    assert d.search_text(0, " two   THREE ")[0].text == "TWO\nthree"
    assert len(d.search_text(0, " two   THREE ")[0].quads) == 2
    assert d.search_text(0, "  ") == [] and d.search_text(0, "four") == []


def test_rows_that_are_dense():
    for step in (2.0, 1.0, 0.5):
        rows = b"".join(b"BT /F1 4 Tf 72 %g Td (Account) Tj ET\n" % (700 - k * step) for k in range(4))
        found = doc_of(rows).search_text(0, "account")
        assert len(found) == 4 and all(m.quads[0][3] - m.quads[0][1] < 7 for m in found)


def test_search_driven_and_multi_page():
    d = doc_of([b"BT /F1 20 Tf 72 700 Td (Page One Secret) Tj ET", b"BT /F1 20 Tf 72 700 Td (Page Two Public) Tj ET"])
    report = d.apply_redactions({"targets": search_targets(d.search_text(0, "secret"))})
    assert report.text_glyphs_removed == 6 and report.pages_touched == 1
    assert d.extract_text(1)["text"] == "Page Two Public"


def test_rotated_text_and_page():
    d = doc_of(b"BT /F1 18 Tf 0 1 -1 0 200 200 Tm (Up) Tj ET")
    b = d._layout(0).glyphs[0].box
    assert (b[0], b[2]) == pytest.approx((187.76, 202.16))
    turned = doc_of(b"BT /F1 18 Tf 0 -1 1 0 200 500 Tm (Secret) Tj ET", page={"Rotate": 90})
    assert turned.page_size(0) == (792, 612)
    report = turned.apply_redactions({"targets": search_targets(turned.search_text(0, "secret")), "overlayText": "x"})
    assert report.text_glyphs_removed == 6 and not turned.search_text(0, "secret")


def test_bad_targets_leave_the_document_alone():
    d = doc_of(SIMPLE)
    for t in ({**RECT, "pageIndex": 3}, {**RECT, "width": 0}, {**RECT, "x": 9000}, {"kind": "quadGroup", "pageIndex": 0, "quads": []}):
        with pytest.raises(PdfError):
            d.apply_redactions({"targets": [RECT, t]})
    with pytest.raises(ValueError, match="strip"):
        d.apply_redactions({"targets": [RECT], "mode": "strip", "overlayText": "x"})
    assert "Secret" in d.extract_text(0)["text"]


@pytest.mark.parametrize(
    ("encoding", "raw", "text"),
    [
        (Name("WinAnsiEncoding"), b"\xc9\xb0\x80\x92", "É°€’"), (Name("MacRomanEncoding"), b"\xd2x\xd3", "“x”"), (Name("StandardEncoding"), b"'`", "’‘"),
        ({"Differences": [64, Name("AE"), 123, Name("fi")]}, b"@ { nice", "Æ ﬁ nice"), ({"Differences": [1, Name("uni4E2D"), Name("eacute"), Name("nosuch")]}, b"\x01\x02\x03", "中é�"),
    ],
)
def test_simple_encodings(encoding, raw, text):
    d = doc_of(b"BT /F1 12 Tf 72 700 Td " + serialise(raw) + b" Tj ET", extra={5: builder.HELVETICA | {"Encoding": encoding}})
    assert d.extract_text(0)["text"] == text


def _type0(encoding, shown, cmap=None, dw=1000, w=None):
    below = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "DW": dw} | ({"W": w} if w else {})
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name(encoding), "DescendantFonts": [Ref(7)]} | ({"ToUnicode": Ref(8)} if cmap else {})
    return doc_of(b"BT /F1 20 Tf 72 700 Td " + shown + b" Tj ET", extra={5: font, 7: below} | ({8: Stream({}, cmap)} if cmap else {}))


def test_composite_fonts():
    cmap = b"2 beginbfchar <0001> <0053> <0002> <0065> endbfchar 1 beginbfrange <0003> <0005> <0063> endbfrange 1 beginbfrange <0010> <0011> [<0041> <00420043>] endbfrange"
    d = _type0("Identity-H", b"<000100020003000400100011>", cmap, 600, [1, [500], 3, 4, 700])
    assert d.extract_text(0)["text"] == "SecdABC"
    glyphs = d._layout(0).glyphs
    assert glyphs[0].box[2] - glyphs[0].box[0] == pytest.approx(10) and glyphs[2].box[2] - glyphs[2].box[0] == pytest.approx(14)
    assert d.apply_redactions({"targets": search_targets(d.search_text(0, "bc"))}).text_glyphs_removed == 1
    assert _type0("UniGB-UCS2-H", b"<4E2D6587>").extract_text(0)["text"] == "中文"
    wide = _type0("UniJIS-UTF16-H", b"<D840DC004E2D>")
    assert wide.extract_text(0)["text"] == "\U00020000中" and len(wide.search_text(0, "\U00020000中")[0].quads) == 1
    with pytest.raises(PdfError, match="Unsupported"):
        _type0("UniGB-UCS2-H", b"<4E2D>", w=[1, [500]]).extract_text(0)
    with pytest.raises(PdfError, match="Unsupported"):
        _type0("90ms-RKSJ-H", b"<4E2D>").extract_text(0)


@pytest.mark.parametrize("raw", [b"\xd8\x40", b"\xd8\x40\x4e\x2d", b"\x4e\x2d\xd8\x40", b"\x4e\x2d\x00"])
def test_half_a_pair_is_corrupt(raw):
    font = fonts.Font(composite=True, utf16=True, unicode_keys=True)
    with pytest.raises(PdfError, match="Corrupt"):
        font.decode(raw)


def test_pairs_have_no_key_in_to_unicode():
    font = fonts.Font(composite=True, utf16=True, unicode_keys=True, to_unicode={0x4E2D: "Z", 0xD840: "WRONG"})
    assert [(g[0], g[2], g[3]) for g in font.decode(bytes.fromhex("D840DC004E2DDC00"))] == [("\U00020000", 0, 4), ("Z", 4, 6), ("\ufffd", 6, 8)]
    assert [g[0] for g in fonts.Font(composite=True, unicode_keys=True).decode(b"\xd8\x40\xdc\x00")] == ["\ufffd"] * 2


@pytest.mark.parametrize("name", ["Identity-V", "UniJIS-UTF16-V", "UniGB-UCS2-V", "90ms-RKSJ-H", ""])
def test_encodings_that_are_refused(name):
    with pytest.raises(PdfError, match="Unsupported"):
        fonts.load(builder.assemble([]), {"Subtype": Name("Type0"), "Encoding": Name(name), "DescendantFonts": [{}]})



def test_widths_default_below_the_first_code():
    font = builder.HELVETICA | {"FirstChar": 66, "Widths": [1000, 250]}
    g = doc_of(b"BT /F1 10 Tf 72 700 Td (ABC) Tj ET", extra={5: font})._layout(0).glyphs
    assert [round(x.box[2] - x.box[0], 3) for x in g] == [6.0, 10.0, 2.5]


def test_font_from_graphics_state():
    d = doc_of(b"/G gs BT 72 700 Td (Secret) Tj ET", resources={"ExtGState": {"G": {"Font": [Ref(5), 24]}}})
    assert d.extract_text(0)["text"] == "Secret"


def test_shows_after_a_first_move_stay_on_a_line():
    assert doc_of(b"BT /F1 12 Tf 72 700 Td (ab) Tj (cd) Tj T* (ef) Tj ET").extract_text(0)["text"] == "abcd\nef"


def test_unbalanced_restore_and_form_matrix():
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 99, 99], "Matrix": [1, 0, 0, 1, 10, 20]}, b"Q BT /F1 10 Tf (x) Tj ET")
    d = doc_of(b"1 0 0 1 100 100 cm /X Do", resources={"XObject": {"X": Ref(9)}}, extra={9: form})
    assert d._layout(0).glyphs[0].box[:2] == pytest.approx((110, 118.8))


def test_erase_keeps_what_follows_in_place_with_spacing():
    d = doc_of(b"BT /F1 20 Tf 3 Tc 5 Tw 72 700 Td (ab cd) Tj ET")
    at = d.search_text(0, "cd")[0].quads
    d.apply_redactions({"targets": search_targets(d.search_text(0, "ab")), "mode": "erase"})
    assert d.search_text(0, "cd")[0].quads == [pytest.approx(b) for b in at]


def test_quote_operators_keep_their_other_effects():
    d = doc_of(b"BT /F1 12 Tf 14 TL 72 700 Td (one) ' 2 1 (two) \" (three) ' ET")
    assert d.extract_text(0)["text"] == "one\ntwo\nthree"
    d.apply_redactions({"targets": search_targets(d.search_text(0, "two")), "mode": "strip"})
    assert d.extract_text(0)["text"] == "one\nthree"
    assert d.search_text(0, "three")[0].quads[0][1] == pytest.approx(700 - 3 * 14 - 1.44)


def test_paths_are_neutralised_whole():
    d = doc_of(b"100 600 120 40 re f 10 10 5 5 re f 150 500 m 150 700 300 700 v S 400 400 m 410 410 l n")
    report = d.apply_redactions({"targets": [{**RECT, "x": 140, "y": 610, "width": 20, "height": 20}], "mode": "erase"})
    assert report.path_paints_removed == 2
    assert [o.op for o in content.parse(content.page_data(d._doc.file, d._doc.pages[0].dict["Contents"]))].count("f") == 1


def test_operators_outside_the_list():
    with pytest.raises(PdfError, match="Unsupported"):
        doc_of(SIMPLE + b" /S sh").apply_redactions({"targets": [RECT]})
    assert doc_of(SIMPLE + b" BX /S sh EX").apply_redactions({"targets": [RECT]}).text_glyphs_removed == 7


def test_inline_images_survive_unless_hit():
    raw = b" q 50 0 0 50 300 300 cm BI /W 2 /H 2 /BPC 8 /CS /G ID \x00EI\xff\x01\nEI Q"
    d = doc_of(SIMPLE + raw)
    assert d.apply_redactions({"targets": [RECT]}).image_draws_removed == 0
    assert b"\x00EI\xff\x01" in decoded(d.save())
    d = doc_of(SIMPLE + raw)
    assert d.apply_redactions({"targets": [{**RECT, "x": 310, "y": 310}]}).image_draws_removed == 1
    assert b"\x00EI\xff\x01" not in decoded(d.save())


class TestImages:
    DRAW = b"q 160 0 0 160 72 600 cm /Im Do Q"

    def doc(self, draw=DRAW, pic=None, pages=1, **more):
        return doc_of([draw] * pages, resources={"XObject": {"Im": Ref(9)}}, extra={9: pic or image()}, **more)

    def pixels(self, d, n=3):
        found = [v for v in d._doc.file.objects.values() if isinstance(v, Stream) and v.dict.get("Subtype") == "Image"]
        return [filters.decode(v.data, v.dict) for v in found]

    def test_part_is_painted_and_the_original_is_gone(self):
        d = self.doc()
        report = d.apply_redactions({"targets": [{**RECT, "x": 152, "y": 680, "width": 80, "height": 80}], "fillColor": {"r": 1, "g": 2, "b": 3}})
        assert (report.image_draws_masked, report.image_draws_removed) == (1, 0)
        (data,) = self.pixels(d)
        for y in range(32):
            for x in range(32):
                want = b"\x01\x02\x03" if x >= 16 and y < 16 else b"\xc8" * 3
                assert data[(y * 32 + x) * 3 :][:3] == want
        assert b"\xc8" * 32 * 32 * 3 not in decoded(d.save())

    def test_overlay_label_does_not_undo_it(self):
        d = self.doc()
        d.apply_redactions({"targets": [{**RECT, "x": 152, "y": 680, "width": 80, "height": 80}], "overlayText": "X"})
        assert b"\xc8" * 32 * 32 * 3 not in decoded(d.save()) and len(self.pixels(d)) == 1

    def test_full_cover_drops_the_draw_and_the_object(self):
        d = self.doc()
        assert d.apply_redactions({"targets": [{**RECT, "x": 0, "y": 500, "width": 400, "height": 290}]}).image_draws_removed == 1
        assert not self.pixels(d)

    def test_an_image_that_another_page_uses_stays(self):
        d = self.doc(pages=2)
        d.apply_redactions({"targets": [{**RECT, "x": 0, "y": 500, "width": 400, "height": 290}]})
        assert self.pixels(d) == [b"\xc8" * 32 * 32 * 3]
        assert len(d._layout(1).draws) == 1

    def test_only_the_draw_that_is_hit_changes(self):
        d = self.doc(self.DRAW + b" q 50 0 0 50 400 100 cm /Im Do Q", image(BitsPerComponent=4))
        report = d.apply_redactions({"targets": [{**RECT, "x": 152, "y": 680, "width": 80, "height": 80}]})
        assert report.image_draws_removed == 1 and report.warnings
        assert [x.ctm[0] for x in d._layout(0).draws] == [50]

    @pytest.mark.parametrize(("n", "pixel"), [(1, b"\x00"), (4, b"\x00\x00\x00\xff")])
    def test_other_colour_spaces(self, n, pixel):
        d = self.doc(pic=image(n=n))
        d.apply_redactions({"targets": [{**RECT, "x": 152, "y": 680, "width": 80, "height": 80}]})
        assert self.pixels(d)[0][16 * n :][:n] == pixel

    def test_jpeg_is_dropped_whole(self):
        d = self.doc(pic=image(Filter=Name("DCTDecode")))
        assert d.apply_redactions({"targets": [{**RECT, "x": 152, "y": 680, "width": 80, "height": 80}]}).image_draws_removed == 1


class TestForms:
    FORM = b"BT /F1 12 Tf 10 10 Td (Hidden Secret) Tj ET"

    def doc(self, draw, inner=FORM, indirect=False, more=None):
        form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 300, 100], "Resources": {"Font": {"F1": Ref(5)}}}, inner)
        table = {"X": Ref(9)} | (more or {})
        return doc_of(draw, resources={"XObject": Ref(12) if indirect else table}, extra={9: form} | ({12: table} if indirect else {}))

    @pytest.mark.parametrize("indirect", [False, True])
    def test_secret_is_gone_from_all_bytes(self, indirect):
        d = self.doc(b"q 1 0 0 1 72 600 cm /X Do Q", indirect=indirect)
        assert d.extract_text(0)["text"] == "Hidden Secret"
        report = d.apply_redactions({"targets": search_targets(d.search_text(0, "secret"))})
        assert (report.text_glyphs_removed, report.form_xobjects_rewritten) == (6, 1)
        out = d.save()
        assert b"Secret" not in decoded(out) and b"Hidden" in decoded(out)

    def test_a_form_drawn_twice_changes_where_it_is_hit(self):
        d = self.doc(b"q 1 0 0 1 72 600 cm /X Do Q q 1 0 0 1 72 300 cm /X Do Q")
        report = d.apply_redactions({"targets": [{**RECT, "x": 70, "y": 600, "width": 200, "height": 30}]})
        assert (report.text_glyphs_removed, report.form_xobjects_rewritten) == (13, 1)
        assert d.extract_text(0)["text"] == "Hidden Secret"
        assert d.search_text(0, "hidden")[0].quads[0][1] < 400

    def test_nested_forms_and_resources_of_the_drawer(self):
        inner = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 300, 100]}, self.FORM)
        outer = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 300, 100], "Resources": {"XObject": {"Y": Ref(10)}}}, b"q 1 0 0 1 5 5 cm /Y Do Q")
        d = doc_of(b"/X Do", resources={"XObject": {"X": Ref(9)}}, extra={9: outer, 10: inner})
        report = d.apply_redactions({"targets": search_targets(d.search_text(0, "secret"))})
        assert report.form_xobjects_rewritten == 2 and b"Secret" not in decoded(d.save())

    def test_a_form_that_draws_itself(self):
        assert self.doc(b"/X Do", self.FORM + b" /X Do", more={}).extract_text(0)["text"] == "Hidden Secret"


def test_annotations():
    link = {"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [70, 695, 250, 720]}
    extra = {10: link, 11: link | {"Rect": [10, 10, 20, 20]}, 12: {"Subtype": Name("Text"), "Contents": b"boxless"}, 13: {"Subtype": Name("FileAttachment"), "Rect": [10, 10, 20, 20]}, 14: {"Subtype": Name("Link")}}
    d = doc_of(SIMPLE, extra=extra, page={"Annots": [Ref(n) for n in extra]})
    assert d.apply_redactions({"targets": [RECT]}).annotations_removed == 3
    assert len(d._doc.pages[0].dict["Annots"]) == 2 and b"boxless" not in decoded(d.save())
    d = doc_of(SIMPLE, extra=extra, page={"Annots": [Ref(n) for n in extra]})
    assert d.apply_redactions({"targets": [RECT], "removeIntersectingAnnotations": False}).annotations_removed == 0


def test_metadata_and_attachments():
    file = builder.assemble([SIMPLE], extra={10: {"Producer": b"Fixture Generator"}, 11: Stream({"Type": Name("EmbeddedFile")}, b"attached"), 12: {"Type": Name("Filespec"), "EF": {"F": Ref(11)}}, 13: Stream({"Type": Name("Metadata")}, b"<x/>")}, catalog={"Names": {"EmbeddedFiles": {"Names": [b"a", Ref(12)]}, "Dests": {"Names": []}}, "Metadata": Ref(13)})
    file.trailer["Info"] = Ref(10)
    d = PdfDocument.open(writer.save(file))
    d.apply_redactions({"targets": [RECT], "stripMetadata": True, "stripAttachments": True})
    left = decoded(d.save())
    assert b"Fixture Generator" not in left and b"attached" not in left and b"<x/>" not in left
    assert "Dests" in d._doc.file.dict_of(d._doc.catalog["Names"])


class TestLayers:
    def doc(self, config, contents=b"/OC /P BDC BT /F1 12 Tf 72 600 Td (Hidden) Tj ET EMC " + SIMPLE, extra=None, resources=None):
        ocg = {"Type": Name("OCG"), "Name": b"L"}
        props = {"OCGs": [Ref(10), Ref(11)], "D": config}
        return doc_of(contents, extra={10: ocg, 11: ocg} | (extra or {}), catalog={"OCProperties": props}, resources={"Properties": {"P": Ref(10), "V": Ref(11)}} | (resources or {}))

    @pytest.mark.parametrize("config", [{"OFF": [Ref(10)]}, {"BaseState": Name("OFF"), "ON": [Ref(11)]}])
    def test_refused_then_stripped(self, config):
        with pytest.raises(PdfError, match="hidden layers"):
            self.doc(config).apply_redactions({"targets": [RECT]})
        d = self.doc(config)
        d.apply_redactions({"targets": [RECT], "sanitizeHiddenOcgs": True})
        assert b"Hidden" not in decoded(d.save()) and "Beta Gamma" in d.extract_text(0)["text"]
        d.apply_redactions({"targets": [RECT]})  # nothing is hidden now

    def test_nested_sections_and_forms(self):
        form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 9, 9], "Resources": {"Properties": {"P": Ref(10)}, "Font": {"F1": Ref(5)}}}, b"/OC /P BDC BT /F1 9 Tf (Within) Tj ET EMC")
        text = b"/OC /V BDC /OC /P BDC /Q BMC BT /F1 9 Tf (Deep) Tj ET EMC EMC BT /F1 9 Tf (Shown) Tj ET EMC /X Do "
        d = self.doc({"OFF": [Ref(10)]}, text + SIMPLE, {9: form}, {"XObject": {"X": Ref(9)}})
        d.apply_redactions({"targets": [RECT], "sanitizeHiddenOcgs": True})
        left = decoded(d.save())
        assert b"Deep" not in left and b"Within" not in left and b"Shown" in left


def test_overlay_label_colour_and_one_per_target():
    d = doc_of(SIMPLE)
    d.apply_redactions({"targets": [RECT], "fillColor": {"r": 255, "g": 255, "b": 255}, "overlayText": "a(b"})
    data = content.page_data(d._doc.file, d._doc.pages[0].dict["Contents"])
    assert data.count(b"(a\\(b) Tj") == 1 and b"0 0 0 rg" in data


class TestReading:
    def two(self):
        file = builder.assemble([b"BT /F1 12 Tf 72 700 Td (Old Secret) Tj ET"])
        raw = writer.save(file)
        prev = int(raw.rpartition(b"startxref\n")[2].split()[0])
        body = b"BT /F1 12 Tf 72 700 Td (Updated Secret) Tj ET"
        at = len(raw)
        raw += b"21 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(body), body)
        start = len(raw)
        return raw + b"xref\n21 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Size 22 /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, prev, start)

    def test_the_newest_revision_wins_and_the_old_is_not_written(self):
        d = PdfDocument.open(self.two())
        assert d.extract_text(0)["text"] == "Updated Secret"
        assert b"Old Secret" not in d.save()

    def test_a_freed_object_is_gone(self):
        raw = self.two()
        raw = raw.replace(b"00000 n \ntrailer\n<< /Root 1 0 R /Size 22 /Prev", b"00001 f \ntrailer\n<< /Root 1 0 R /Size 22 /Prev")
        assert PdfDocument.open(raw).extract_text(0)["text"] == ""

    def test_wrong_lengths_and_indirect_lengths(self):
        file = builder.assemble([SIMPLE])
        raw = writer.save(file)
        for wrong in (b"/Length 3", b"/Length 9999", b"/Length 77 0 R"):
            bad = raw.replace(b"/Length %d" % len(SIMPLE), wrong.ljust(len(b"/Length %d" % len(SIMPLE))))
            if len(bad) == len(raw):
                assert PdfDocument.open(bad).extract_text(0)["text"].startswith("Secret")

    @pytest.mark.parametrize("raw", [b"", b"%PDF-1.4\n", b"%PDF-1.4\nstartxref\n99999\n", b"%PDF-1.4\nstartxref\n0\n", b"nonsense" * 9])
    def test_broken_files_are_errors(self, raw):
        with pytest.raises(PdfError):
            PdfDocument.open(raw)

    def test_page_tree_rules(self):
        file = builder.assemble([SIMPLE])
        file.objects[Ref(2)]["Kids"] = [Ref(2)]
        with pytest.raises(PdfError, match="circle"):
            reader.build(file)
        file = builder.assemble([SIMPLE])
        file.objects[Ref(2)] |= {"Rotate": 270, "MediaBox": [100, 50, 0, 0]}
        for k in ("MediaBox",):
            file.objects[Ref(20)].pop(k)
        page = reader.build(file).pages[0]
        assert page.rotate == 270 and page.media == (0, 0, 100, 50) and page.size == (50, 100)

    @pytest.mark.parametrize("form", ["classic", "stream"])
    def test_a_save_is_read_back_alike(self, form):
        file = builder.assemble([SIMPLE] * 150, form=form)
        again = reader.parse(writer.save(file))
        strip = lambda v: ({k: x for k, x in v.dict.items() if k != "Length"}, v.data) if isinstance(v, Stream) else v
        assert again.form == form and {r: strip(v) for r, v in again.objects.items()} == {r: strip(v) for r, v in file.objects.items()}


def encrypted(v, r, method, user=b"user", owner=b"owner"):
    """The simple document under the standard handler."""
    file = builder.assemble([SIMPLE], extra={10: {"Title": b"Sealed Title"}})
    file.trailer |= {"Info": Ref(10), "ID": [b"0123456789abcdef"] * 2}
    ident, p = b"0123456789abcdef", -44
    if v < 5:
        size = 5 if v == 1 else 16
        k = crypto.owner_key(owner, r, size)
        o = (user + crypto.PAD)[:32]
        for i in range(1 if r == 2 else 20):
            o = crypto.rc4(bytes(b ^ i for b in k), o)
        key = crypto.file_key(user, o, p, ident, r, size, True)
        enc = {"Filter": Name("Standard"), "V": v, "R": r, "O": o, "U": crypto.user_entry(key, ident, r).ljust(32, b"\0"), "P": p, "Length": size * 8}
    else:
        key = bytes(range(32))
        salt = b"saltsaltkeysaltk"
        u = crypto.hash_2b(user, salt[:8], b"", r) + salt
        o = crypto.hash_2b(owner, salt[:8], u[:48], r) + salt
        wrap = lambda pw, more: crypto.cbc_encrypt(crypto.hash_2b(pw, salt[8:], more, r), b"\0" * 16, key)
        enc = {"Filter": Name("Standard"), "V": 5, "R": r, "O": o, "U": u, "UE": wrap(user, b""), "OE": wrap(owner, u[:48]), "P": p}
    if v >= 4:
        enc |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    return _seal(file, enc, crypto.Handler(key, method, method))


def _seal(file, enc, handler):
    def seal(raw, ref):
        if handler.strings == "AESV3":
            return crypto.seal(handler.key, b"i" * 16, raw)
        material = handler.key + ref.num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if handler.strings == "AESV2" else b"")
        key = hashlib.md5(material).digest()[: min(16, len(handler.key) + 5)]
        return crypto.seal(key, b"i" * 16, raw) if handler.strings == "AESV2" else crypto.rc4(key, raw)

    for ref, v in list(file.objects.items()):
        if isinstance(v, Stream):
            file.objects[ref] = Stream(v.dict, seal(v.data, ref))
        elif ref == Ref(10):
            file.objects[ref] = {"Title": seal(v["Title"], ref)}
    file.objects[Ref(30)] = enc
    trailer = dict(file.trailer) | {"Encrypt": Ref(30)}
    raw = writer.save(file)
    return raw.replace(b"trailer\n<< ", b"trailer\n<< /Encrypt 30 0 R ") if trailer else raw


@pytest.mark.parametrize(("v", "r", "method"), [(1, 2, "V2"), (2, 3, "V2"), (4, 4, "V2"), (4, 4, "AESV2"), (5, 5, "AESV3"), (5, 6, "AESV3")])
def test_passwords(v, r, method):
    raw = encrypted(v, r, method)
    for password in ("user", "owner"):
        d = PdfDocument.open_with_password(raw, password)
        assert d.extract_text(0)["text"] == "Secret Alpha\nBeta Gamma"
        assert d._doc.file.objects[Ref(10)] == {"Title": b"Sealed Title"}
        out = d.save()
        assert b"Encrypt" not in out and PdfDocument.open(out).page_count() == 1
    with pytest.raises(PdfError, match="InvalidPassword"):
        PdfDocument.open_with_password(raw, "wrong")
    with pytest.raises(PdfError, match="InvalidPassword"):
        PdfDocument.open(raw)
    assert PdfDocument.open(encrypted(v, r, method, user=b"")).page_count() == 1


def _der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + head + body


def _int(v):
    return _der(2, v.to_bytes(v.bit_length() // 8 + 1))


@pytest.mark.parametrize(("v", "sub", "method"), [(2, "adbe.pkcs7.s4", "V2"), (4, "adbe.pkcs7.s5", "AESV2"), (5, "adbe.pkcs7.s5", "AESV3")])
def test_certificates(v, sub, method):
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    private = _der(0x30, _int(0), _int(n), _int(e), _int(d), _int(p), _int(q))
    issuer = _der(0x30, _der(0x31, b"issuer"))
    algorithm = _der(0x30, _der(6, bytes.fromhex("2a864886f70d010101")), _der(5))
    cert = _der(0x30, _der(0x30, _der(0xA0, _int(2)), _int(77), algorithm, issuer, _der(0x30), _der(0x30), _der(0x30)), algorithm)
    seed, secret, iv = b"s" * 20 + b"\xff\xff\xff\xfc", b"c" * 16, b"v" * 16
    size = (n.bit_length() + 7) // 8
    padded = b"\0\x02" + b"\x01" * (size - 3 - len(secret)) + b"\0" + secret
    wrapped = pow(int.from_bytes(padded), e, n).to_bytes(size)
    recipient = _der(0x30, _int(0), _der(0x30, issuer, _int(77)), algorithm, _der(4, wrapped))
    sealed = crypto.seal(secret, iv, seed)[16:]
    box = _der(0x30, _der(6, b"x"), _der(0x30, _der(6, bytes.fromhex("608648016503040102")), _der(4, iv)), _der(0x80, sealed))
    blob = _der(0x30, _der(6, b"y"), _der(0xA0, _der(0x30, _int(0), _der(0x31, recipient), box)))
    digest = (hashlib.sha256 if v == 5 else hashlib.sha1)(seed[:20] + blob).digest()
    key = digest[: 32 if v == 5 else 16]
    enc = {"Filter": Name("Adobe.PubSec"), "SubFilter": Name(sub), "V": v, "Length": 128}
    own = {"Recipients": [blob]}
    enc |= own if v < 4 else {"CF": {"DefaultCryptFilter": {"CFM": Name(method)} | own}, "StmF": Name("DefaultCryptFilter"), "StrF": Name("DefaultCryptFilter")}
    raw = _seal(builder.assemble([SIMPLE], extra={10: {"Title": b"t"}}), enc, crypto.Handler(key, method, method))
    assert PdfDocument.open_with_certificate(raw, cert, private).extract_text(0)["text"] == "Secret Alpha\nBeta Gamma"
    with pytest.raises(PdfError, match="InvalidPassword"):
        PdfDocument.open_with_certificate(raw, cert.replace(b"issuer", b"other!"), private)
    with pytest.raises(PdfError, match="InvalidPassword"):
        PdfDocument.open(raw)


def test_oaep():
    p, q, e = (1 << 521) - 1, (1 << 607) - 1, 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    size, message, seed = (n.bit_length() + 7) // 8, b"hello", b"r" * 20
    db = hashlib.sha1(b"").digest() + b"\0" * (size - len(message) - 42) + b"\x01" + message
    masked = crypto._xor(db, crypto._mask(seed, len(db)))
    m = b"\0" + crypto._xor(seed, crypto._mask(masked, 20)) + masked
    assert crypto.rsa_decrypt((n, d), pow(int.from_bytes(m), e, n).to_bytes(size), True) == message
