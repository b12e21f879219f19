"""The library's face for one document: open, look, search, redact, save."""

from __future__ import annotations

from veilframe.operators.targets import Plan
from veilframe.pdf import layout, reader, redactor, writer


class PdfDocument:
    """Extraction is kept per page until a plan is applied."""

    def __init__(self, doc: reader.Document):
        self._doc, self._pages = doc, {}

    @classmethod
    def open(cls, data: bytes) -> PdfDocument:
        return cls(reader.open_pdf(data))

    @classmethod
    def open_with_password(cls, data: bytes, password: bytes | str) -> PdfDocument:
        return cls(reader.open_pdf(data, password))

    @classmethod
    def open_with_certificate(cls, data: bytes, certificate: bytes, key: bytes) -> PdfDocument:
        return cls(reader.open_pdf(data, b"", (certificate, key)))

    def page_count(self) -> int:
        return len(self._doc.pages)

    def page_size(self, page: int) -> tuple[float, float]:
        return self._doc.page(page).size

    def _layout(self, page: int) -> layout.Layout:
        if page not in self._pages:
            self._pages[page] = layout.layout(self._doc, page)
        return self._pages[page]

    def extract_text(self, page: int) -> dict:
        found = self._layout(page)
        return {"page_index": page, "text": found.page_text, "items": found.items}

    def search_text(self, page: int, query: str) -> list[layout.Match]:
        return layout.search(self._layout(page), query, page)

    def apply_redactions(self, plan: dict) -> redactor.Report:
        """Applies a plan's JSON. On failure the document stays as it was."""
        targets = redactor.targets_of(plan.get("targets") or [], self._doc)
        self._doc, report = redactor.apply(self._doc, targets, Plan.from_json(plan))
        self._pages = {}
        return report

    def save(self) -> bytes:
        return writer.save(self._doc.file)


def search_targets(matches: list[layout.Match]) -> list[dict]:
    """Matches as quad-group targets of a plan."""
    corner = lambda b: [{"x": x, "y": y} for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]
    return [{"kind": "quadGroup", "pageIndex": m.page, "quads": [corner(q) for q in m.quads]} for m in matches]
