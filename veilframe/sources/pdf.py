"""PDF files as relations: one crossing into Python and one out of it.

Every function takes a frame with ``path`` and ``content`` (what ``files`` or any table
of bytes gives) and returns long-form rows. A document that cannot be read is a row with
``error`` set; a job never fails for it, and a document with an error has no output bytes.
A column ``password`` (string, may be null) opens encrypted documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql.functions import udtf

ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_BOX = [("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())]

PAGES = pa.schema([
    ("path", pa.string()), ("page_index", pa.int64()), ("width", pa.float64()), ("height", pa.float64()), ("rotate", pa.int64()), ("text", pa.string()),
    ("items", pa.list_(pa.struct([("text", pa.string()), *_BOX, ("char_start", pa.int64()), ("char_end", pa.int64())]))), ("error", ERROR),
])
GLYPHS = pa.schema([
    ("path", pa.string()), ("page_index", pa.int64()), ("glyph_index", pa.int64()), ("ch", pa.string()), *_BOX, ("stream", pa.list_(pa.int64())),
    ("operation_index", pa.int64()), ("operand_index", pa.int64()), ("element_index", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("visible", pa.bool_()), ("error", ERROR),
])
OBJECTS = pa.schema([("path", pa.string()), ("num", pa.int64()), ("gen", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("data", pa.binary()), ("error", ERROR)])
OPERATIONS = pa.schema([("path", pa.string()), ("page_index", pa.int64()), ("op_index", pa.int64()), ("operator", pa.string()), ("operands", pa.string()), ("error", ERROR)])
MATCHES = pa.schema([("path", pa.string()), ("page_index", pa.int64()), ("query", pa.string()), ("match_index", pa.int64()), ("text", pa.string()), ("quads", pa.list_(pa.struct(_BOX))), ("error", ERROR)])
REPORT = pa.struct([(k, pa.int64()) for k in ("pages_touched", "text_glyphs_removed", "path_paints_removed", "image_draws_removed", "image_draws_masked", "annotations_removed", "form_xobjects_rewritten")] + [("warnings", pa.list_(pa.string()))])
REDACTED = pa.schema([("path", pa.string()), ("pdf", pa.binary()), ("report", REPORT), ("error", ERROR)])
REOPENED = pa.struct([(k, pa.int64()) for k in ("pages", "pages_lost", "glyphs", "glyphs_lost", "glyphs_under_targets")])
#: Rows, and bytes of documents, after which a batch is passed on: one per small document costs more than its reading.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the PDF files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def _jsonable(v: Any) -> Any:
    """A value for VARIANT: strings as {"$b": base64}, references as {"$r": [number, generation]}, names as {"$n": name}."""
    import base64

    from veilframe.pdf.model import Name, Ref, Stream

    if isinstance(v, Name):
        return {"$n": v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")}
    if isinstance(v, bytes):
        return {"$b": base64.b64encode(v).decode()}
    if isinstance(v, Ref):
        return {"$r": list(v)}
    if isinstance(v, Stream):
        return _jsonable(v.dict)
    if isinstance(v, (list, tuple)):
        return [_jsonable(x) for x in v]
    if isinstance(v, dict):
        return {k.encode("utf-8", "surrogateescape").decode("utf-8", "replace"): _jsonable(x) for k, x in v.items()}
    return v


def _opened(content: bytes, password: str | None, certificate: tuple[bytes, bytes] | None):
    from veilframe.pdf import reader

    return reader.open_pdf(content, password or b"", certificate)


def _each(df: DataFrame, schema: pa.Schema, rows: Callable[..., Iterator[dict]], certificate: tuple[bytes, bytes] | None = None, plans: bool = False) -> DataFrame:
    """``rows(path, document)`` of every document, or one row with the error; ``plans``: and what its column ``plan`` says."""
    key = df.sparkSession.sparkContext.broadcast(certificate)  # never a column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from veilframe.pdf.model import PdfError

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, password, plan = (batch.column(k)[i].as_py() for k in range(4))
                try:
                    if content is None:
                        raise PdfError("Parse", "no content")
                    doc = _opened(content, password, key.value)
                    out = list(rows(path, doc, plan) if plans else rows(path, doc))
                except PdfError as e:
                    out = [{"path": path, "error": {"code": e.code, "message": e.message}}]
                except Exception as e:  # noqa: BLE001  a broken file must not end the job
                    out = [{"path": path, "error": {"code": "Corrupt", "message": f"{type(e).__name__}: {e}"}}]
                held += out
                size += len(content or b"")
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    more = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("password", "plan")]
    return df.select("path", "content", *more).mapInArrow(run, _ddl(schema))


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def _layouts(doc):
    """(page index, layout or error) of every page; a page that fails leaves the others."""
    from veilframe.pdf import layout
    from veilframe.pdf.model import PdfError

    for i in range(len(doc.pages)):
        try:
            yield i, layout.layout(doc, i), None
        except PdfError as e:
            yield i, None, {"code": e.code, "message": e.message}


def _box(b: tuple) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, b)))


def pages(df: DataFrame, certificate: tuple[bytes, bytes] | None = None) -> DataFrame:
    """Size, text and items of every page."""

    def rows(path: str, doc) -> Iterator[dict]:
        for i, found, error in _layouts(doc):
            w, h = doc.pages[i].size
            base = {"path": path, "page_index": i, "width": float(w), "height": float(h), "rotate": doc.pages[i].rotate, "error": error}
            if found:
                base |= {"text": found.page_text, "items": [{"text": t.text, **_box(t.box), "char_start": t.char_start, "char_end": t.char_end} for t in found.items]}
            yield base

    return _each(df, PAGES, rows, certificate)


def glyphs(df: DataFrame, certificate: tuple[bytes, bytes] | None = None) -> DataFrame:
    """Every character with its box and the bytes it comes from."""

    def rows(path: str, doc) -> Iterator[dict]:
        for i, found, error in _layouts(doc):
            if error:
                yield {"path": path, "page_index": i, "error": error}
            for k, g in enumerate(found.glyphs if found else ()):
                yield {"path": path, "page_index": i, "glyph_index": k, "ch": g.ch, **_box(g.box), "stream": list(g.path), "operation_index": g.op, "operand_index": g.operand,
                       "element_index": g.element, "byte_start": g.start, "byte_end": g.end, "visible": g.visible}

    return _each(df, GLYPHS, rows, certificate)


def objects(df: DataFrame, certificate: tuple[bytes, bytes] | None = None) -> DataFrame:
    """The object table; ``value`` becomes VARIANT, ``data`` is a stream's undecoded bytes."""
    from veilframe.pdf.model import Stream

    def rows(path: str, doc) -> Iterator[dict]:
        for ref, v in sorted(doc.file.objects.items()):
            stream = isinstance(v, Stream)
            yield {"path": path, "num": ref.num, "gen": ref.gen, "kind": "stream" if stream else "value", "value": json.dumps(_jsonable(v)), "data": v.data if stream else None}

    return _each(df, OBJECTS, rows, certificate).withColumn("value", F.parse_json("value"))


def operations(df: DataFrame, certificate: tuple[bytes, bytes] | None = None) -> DataFrame:
    """The operators of every page's content."""

    def rows(path: str, doc) -> Iterator[dict]:
        from veilframe.pdf import content

        for i, p in enumerate(doc.pages):
            for k, o in enumerate(content.parse(content.page_data(doc.file, p.dict.get("Contents")))):
                yield {"path": path, "page_index": i, "op_index": k, "operator": o.op, "operands": json.dumps(_jsonable(o.args))}

    return _each(df, OPERATIONS, rows, certificate).withColumn("operands", F.parse_json("operands"))


def search(df: DataFrame, queries: list[str], certificate: tuple[bytes, bytes] | None = None) -> DataFrame:
    """Matches of each query on every page, with their boxes."""

    def rows(path: str, doc) -> Iterator[dict]:
        from veilframe.pdf import layout

        for i, found, error in _layouts(doc):
            if error:
                yield {"path": path, "page_index": i, "error": error}
                continue
            for q in queries:
                for k, m in enumerate(layout.search(found, q, i)):
                    yield {"path": path, "page_index": i, "query": q, "match_index": k, "text": m.text, "quads": [_box(b) for b in m.quads]}

    return _each(df, MATCHES, rows, certificate)


def with_plans(df: DataFrame, plans: DataFrame) -> DataFrame:
    """``df`` with the ``plan`` (JSON) that ``plans`` (path, plan; a row a path) has for each document, or null."""
    return df.join(plans.select("path", "plan"), "path", "left")


def _reopened(doc, targets: list, data: bytes) -> dict:
    """What a reader finds in saved bytes, against the document ``doc`` they were made of."""
    from veilframe.pdf import layout, reader

    again = reader.open_pdf(data)
    before = sum(layout.layout(doc, i).codes for i in range(len(doc.pages)))
    glyphs = under = 0
    for i in range(len(again.pages)):
        page = layout.layout(again, i)
        glyphs += page.codes
        # Kerns are written in six places, so what stands beside a target may reach it by a hair.
        inner = [(a + 0.01, b + 0.01, c - 0.01, d - 0.01) for t in targets if t.page == i for a, b, c, d in t.quads]
        under += len(page.hits(inner)) if inner else 0
    return {"pages": len(again.pages), "pages_lost": len(doc.pages) - len(again.pages), "glyphs": glyphs, "glyphs_lost": before - glyphs, "glyphs_under_targets": under}


def redact(df: DataFrame, plan: dict | None = None, queries: list[str] = (), certificate: tuple[bytes, bytes] | None = None, reopen: bool = False) -> DataFrame:
    """Rewritten bytes and report of every document: its plan's targets and all matches of ``queries``.

    A column ``plan`` (JSON, may be null) has a document's own plan, instead of ``plan``. A plan that is
    not valid is an error of its document alone. With ``reopen`` the saved bytes are read again, every page of
    them, and ``reopened`` says what is there: an overlay's label counts among its glyphs, and what strip mode
    closes up may come to lie under a target. Bytes that cannot be read are an error.
    """

    def rows(path: str, doc, own: str | None) -> Iterator[dict]:
        from veilframe.operators.targets import Plan
        from veilframe.pdf import layout, redactor, writer
        from veilframe.pdf.model import PdfError

        try:
            plan = json.loads(own) if own is not None else common_plan
            options = Plan.from_json(plan)
        except (ValueError, AttributeError) as e:
            raise PdfError("UnsupportedOption", f"plan: {e}") from e
        found = []
        for i in range(len(doc.pages) if queries else 0):  # a page is laid out once for all queries
            page = layout.layout(doc, i)
            found += [m for q in queries for m in layout.search(page, q, i)]
        # What search finds is redacted wherever it lies, off the visible page too.
        targets = redactor.targets_of(plan.get("targets") or [], doc) + [redactor.Target(m.page, m.quads) for m in found]
        new, report = redactor.apply(doc, targets, options)
        row = {"path": path, "pdf": writer.save(new.file), "report": vars(report)}
        yield row | {"reopened": _reopened(doc, targets, row["pdf"])} if reopen else row

    common_plan = plan or {}
    return _each(df, REDACTED.append(pa.field("reopened", REOPENED)) if reopen else REDACTED, rows, certificate, plans=True)


def write_files(redacted: DataFrame, folder: str) -> DataFrame:
    """Writes ``pdf`` of each row under ``folder`` (any file system Arrow opens), named by the digest of its path; returns path, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            written = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{base}/{hashlib.sha256(path.encode()).hexdigest()[:32]}.pdf"
                with system.open_output_stream(name) as out:
                    out.write(data)
                written.append(name)
            yield pa.record_batch([batch.column(0), pa.array(written, pa.string())], names=["path", "written"])

    return redacted.where("pdf is not null").select("path", "pdf").mapInArrow(run, "path string, written string")


class _PdfGlyphs:
    """Glyphs of a document; where it, or a page of it, cannot be read, a row with ``error`` says so."""

    def eval(self, content: bytes, password: str = None):
        from veilframe.pdf.model import PdfError

        none = (None,) * 6
        try:
            if content is None:
                raise PdfError("Parse", "no content")
            for i, found, error in _layouts(_opened(bytes(content), password, None)):
                if error:
                    yield i, None, *none, error["code"]
                for k, g in enumerate(found.glyphs if found else ()):
                    yield i, k, g.ch, *map(float, g.box), g.visible, None
        except PdfError as e:
            yield None, None, *none, e.code
        except Exception:  # noqa: BLE001  a broken file must not end the job
            yield None, None, *none, "Corrupt"


def glyphs_udtf() -> UserDefinedTableFunction:
    returns = "page_index int, glyph_index int, ch string, x0 double, y0 double, x1 double, y1 double, visible boolean, error string"
    return udtf(_PdfGlyphs, returnType=returns, useArrow=True)


def register(spark: SparkSession) -> None:
    """SQL: ``SELECT ... FROM files, LATERAL pdf_glyphs(content, password)``; the password may be left out."""
    spark.udtf.register("pdf_glyphs", glyphs_udtf())
