"""Content streams: operations and back."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from veilframe.pdf import filters
from veilframe.pdf.lexer import Lexer, serialise
from veilframe.pdf.model import File, Name, PdfError, Stream

_INLINE_END = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ]|$)")


@dataclass
class Operation:
    """An operator with its operands. An inline image is BI with its dictionary and data."""

    op: str
    args: list[Any]


# What most content is made of: a plain string, number or name and then white space, or an operator alone. Whatever else
# there is, or might be, the lexer reads.
_COMMON = re.compile(
    rb"[\0\t\n\x0c\r ]*(?:\(([^()\\\r]*)\)|([+-]?\d+(?:\.\d*)?)(?=[\0\t\n\x0c\r ])|/([A-Za-z0-9]+)(?=[\0\t\n\x0c\r ])|(?!true|false|null|BI)([A-Za-z*'\"][A-Za-z0-9*'\"]*)(?=[\0\t\n\x0c\r ]|$))"
)


def parse(data: bytes) -> list[Operation]:
    lex, out, args = Lexer(data, refs=False), [], []
    common = _COMMON.match
    while True:
        while m := common(data, lex.pos):
            lex.pos, kind, token = m.end(), m.lastindex, m[m.lastindex]
            if kind == 1:
                args.append(token)
            elif kind == 2:
                args.append(float(token) if b"." in token else int(token))
            elif kind == 3:
                args.append(Name(token.decode()))
            else:
                out.append(Operation(token.decode(), args))
                args = []
        lex.skip()
        if lex.pos >= len(data):
            if args:
                raise PdfError("Parse", "operands without an operator")
            return out
        if lex.at_operand():
            args.append(lex.value())
            continue
        op = lex.word().decode("latin-1")
        if not op:
            raise lex.fail("an operator is missing")
        if op == "BI":
            args = list(_inline(lex))
        out.append(Operation(op, args))
        args = []


def _inline(lex: Lexer) -> tuple[dict, bytes]:
    d: dict = {}
    while True:
        lex.skip()
        if lex.data.startswith(b"ID", lex.pos):
            lex.pos += 3
            break
        key = lex.value()
        if not isinstance(key, Name):
            raise lex.fail("a key of an inline image is not a name")
        d[str(key)] = lex.value()
    m = _INLINE_END.search(lex.data, max(0, lex.pos - 1))
    if not m:
        raise lex.fail("an inline image does not end")
    body = lex.data[lex.pos : m.start()]
    lex.pos = m.end()
    return d, body


def write(ops: list[Operation]) -> bytes:
    out = []
    for o in ops:
        if o.op == "BI":
            d = b" ".join(serialise(Name(k)) + b" " + serialise(v) for k, v in o.args[0].items())
            out.append(b"BI " + d + b" ID " + o.args[1] + b"\nEI")
        else:
            out.append(b" ".join([*map(serialise, o.args), o.op.encode("latin-1")]))
    return b"\n".join(out) + b"\n"


def page_data(file: File, contents: Any) -> bytes:
    """A page's content streams, decoded, one behind another."""
    v = file.resolve(contents)
    parts = v if isinstance(v, list) else [] if v is None else [v]
    out = []
    for p in parts:
        s = file.resolve(p)
        if not isinstance(s, Stream):
            raise PdfError("Corrupt", "a content stream is no stream")
        out.append(filters.decode(s.data, s.dict, file.resolve))
    return b"\n".join(out)
