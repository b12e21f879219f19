"""Documents in Spark: relations, errors as rows, redaction, SQL table function, arrival stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.pdf import builder
from veilframe.sources import pdf
from veilframe.streaming import arrival


def _folder(tmp_path):
    (tmp_path / "a.pdf").write_bytes(builder.from_text("Hello the Secret\nsecond line"))
    (tmp_path / "b.pdf").write_bytes(builder.from_text("the other", form="stream"))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nonsense")
    (tmp_path / "note.txt").write_text("not a document")
    return str(tmp_path)


def test_relations_and_error_rows(spark, tmp_path):
    files = pdf.files(spark, _folder(tmp_path)).cache()
    pages = {r.path.rpartition("/")[2]: r for r in pdf.pages(files).collect()}
    assert pages["a.pdf"].text == "Hello the Secret\nsecond line" and pages["a.pdf"].width == 612
    assert pages["broken.pdf"].error.code == "Parse" and pages["broken.pdf"].text is None
    assert pdf.glyphs(files).where("error is null").count() == len("Hello the Secretsecond linethe other")
    types = {r[0] for r in pdf.objects(files).select(F.try_variant_get("value", "$.Type['$n']", "string")).collect()}
    assert {"Catalog", "Pages", "Page", "Font"} <= types
    assert pdf.operations(files).where("operator = 'Tj'").count() == 3
    assert pdf.search(files, ["the", "secret second"]).where("match_index is not null").count() == 4


def test_redact_and_write(spark, tmp_path):
    files = pdf.files(spark, _folder(tmp_path))
    done = pdf.redact(files, {"mode": "redact", "overlayText": "x"}, ["secret"]).cache()
    rows = {r.path.rpartition("/")[2]: r for r in done.collect()}
    assert rows["a.pdf"].report.text_glyphs_removed == 6 and rows["b.pdf"].report.pages_touched == 0
    assert rows["broken.pdf"].pdf is None and rows["broken.pdf"].error.code == "Parse"
    out = str(tmp_path / "out")
    assert pdf.write_files(done, f"file://{out}").count() == 2
    assert pdf.search(pdf.files(spark, out), ["secret"]).where("match_index is not null").count() == 0


def test_table_function(spark, tmp_path):
    pdf.register(spark)
    pdf.files(spark, _folder(tmp_path)).createOrReplaceTempView("pdf_files")
    got = spark.sql("SELECT path, count(*) AS n FROM pdf_files, LATERAL pdf_glyphs(content) WHERE ch = 'e' GROUP BY path").collect()
    assert sorted(r.n for r in got) == [2, 6]
    bad = spark.sql("SELECT path, error FROM pdf_files, LATERAL pdf_glyphs(content) WHERE error IS NOT NULL").collect()
    assert [(r.path.rpartition("/")[2], r.error) for r in bad] == [("broken.pdf", "Parse")]


def test_a_plan_of_each_document(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(n, builder.from_text("Secret Alpha\nSecret Beta")) for n in "abcde"], "path string, content binary")
    rect = '{"kind": "rect", "pageIndex": %d, "x": 70, "y": 715, "width": 39, "height": 10}'
    plans = [("a", '{"mode": "strip", "targets": [%s]}' % (rect % 0)), ("b", '{"targets": [%s]}' % (rect % 7)), ("c", '{"mode": "burn"}'), ("d", "[1]")]
    done = pdf.redact(pdf.with_plans(docs, spark.createDataFrame(plans, "path string, plan string")), None, ["beta"])
    got = {r.path: (r.report and r.report.text_glyphs_removed, r.error and r.error.code) for r in done.collect()}
    assert got == {"a": (11, None), "b": (None, "InvalidPageIndex"), "c": (None, "UnsupportedOption"), "d": (None, "UnsupportedOption"), "e": (4, None)}
    text = pdf.pages(done.where("path = 'a'").select("path", F.col("pdf").alias("content"))).first().text
    assert text.split() == ["Alpha", "Secret"]


def test_arrival_stream_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _folder(src)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    arrival.pages_to(spark, str(src), table, state).awaitTermination(60)
    assert spark.read.parquet(table).count() == 3
    (src / "c.pdf").write_bytes(builder.from_text("late"))
    arrival.pages_to(spark, str(src), table, state).awaitTermination(60)
    assert sorted(r.text or "" for r in spark.read.parquet(table).collect()) == ["", "Hello the Secret\nsecond line", "late", "the other"]


def test_what_was_redacted_is_not_found_again(spark, sf):
    from pyspark.sql import functions as F

    from veilframe.plans import pdf_queries

    docs = pdf_queries.made(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    done = pdf.redact(docs, {"mode": "redact"}, ["the"])
    assert done.select(F.sum("report.text_glyphs_removed")).first()[0] > 0
    assert pdf.search(done.select("path", F.col("pdf").alias("content")), ["the"]).where("match_index is not null").count() == 0


def test_saved_bytes_are_read_again(spark):
    made = spark.createDataFrame([("a", builder.from_text("Find th the place\n" + "line\n" * 60)), ("b", builder.from_text("nothing", form="stream")), ("c", b"%PDF-1.4 nonsense")], "path string, content binary")
    rows = {r.path: r for r in pdf.redact(made, {"mode": "redact"}, ["th the"], reopen=True).collect()}
    assert tuple(rows["a"].reopened) == (2, 0, 11 + 60 * 4, 6, 0) and rows["a"].report.text_glyphs_removed == 6
    assert tuple(rows["b"].reopened) == (1, 0, 7, 0, 0)
    assert rows["c"].reopened is None and rows["c"].error.code == "Parse"


def test_reading_again_tells_what_was_not_redacted():
    from veilframe.pdf import reader, redactor

    raw = builder.from_text("Find th the place\n" + "line\n" * 60)
    doc, target = reader.open_pdf(raw), redactor.Target(0, [(102.0, 718.8, 138.0, 726.8)])
    assert pdf._reopened(doc, [target], raw) == {"pages": 2, "pages_lost": 0, "glyphs": 257, "glyphs_lost": 0, "glyphs_under_targets": 6}
    other = builder.from_text("Find place")
    assert pdf._reopened(doc, [target], other) == {"pages": 1, "pages_lost": 1, "glyphs": 10, "glyphs_lost": 247, "glyphs_under_targets": 5}


def test_roundtrip_is_not_saved_where_the_saved_bytes_are_short(spark, sf, monkeypatch):
    from veilframe.plans import pdf_queries

    good, plain = pdf_queries.q40_pdf_roundtrip(spark, sf), pdf.redact
    assert good.where("not saved").count() == 0
    lost = F.col("reopened").withField("glyphs_lost", F.col("reopened.glyphs_lost") + 1)
    monkeypatch.setattr(pdf, "redact", lambda *a, **k: plain(*a, **k).withColumn("reopened", lost))
    assert pdf_queries.q40_pdf_roundtrip(spark, sf).where("saved").count() == 0
