"""Tokens of PDF syntax, by regular expressions over the bytes."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

from veilframe.pdf.model import Name, PdfError, Ref

_REGULAR = rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]"
_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_NAME = re.compile(rb"/(" + _REGULAR + rb"*)")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)(?!" + _REGULAR + rb")")
_REF = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?!" + _REGULAR + rb")")
_CONSTANT = re.compile(rb"(?:true|false|null)(?!" + _REGULAR + rb")")
_WORD = re.compile(_REGULAR + rb"+")
_HEX = re.compile(rb"<([0-9A-Fa-f\0\t\n\x0c\r ]*)>")
# What most values are, each with the white space before it; whatever else there is, the methods below read.
_GAP = rb"[\0\t\n\x0c\r ]"
_SIMPLE = rb"/([A-Za-z0-9]+)(?!" + _REGULAR + rb")|([+-]?\d+(?:\.\d*)?)(?!" + _REGULAR + rb")|\(([^()\\\r]*)\)|(<<)|(\[)"
_COMMON = {refs: re.compile(_GAP + rb"*(?:" + (rb"(\d+)" + _GAP + rb"+(\d+)" + _GAP + rb"+R(?!" + _REGULAR + rb")|" if refs else rb"(?!)()()|") + _SIMPLE + rb")") for refs in (True, False)}
_KEY = re.compile(_GAP + rb"*(?:/([A-Za-z0-9]+)(?!" + _REGULAR + rb")|>>)")
_PAIR = re.compile(_GAP + rb"*/([A-Za-z0-9]+)" + _GAP + rb"+(?:(\d+)" + _GAP + rb"+(\d+)" + _GAP + rb"+R(?!" + _REGULAR + rb")|/([A-Za-z0-9]+)(?!" + _REGULAR + rb")|(\d+)(?=[ \n\r]*[/>]))")
_WHOLE = re.compile(_GAP + rb"*\[((?:[ \n\r]*\d+)(?:[ \n\r]+\d+)*)[ \n\r]*\]")
_CLOSE = re.compile(_GAP + rb"*\]")
_INTEGER = re.compile(_GAP + rb"*(\d+)(?!" + _REGULAR + rb")")
_PLAIN = re.compile(rb"[^()\\\r]+")
_BRACKETS = re.compile(rb"([\\()])")
_PRINTABLE = re.compile(rb"[ -~]*")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Nesting of arrays and dictionaries beyond which a file is refused.
MAX_NESTING = 200


class Lexer:
    def __init__(self, data: bytes, pos: int = 0, refs: bool = True):
        self.data, self.pos, self.refs, self.level = data, pos, refs, 0
        self.common = _COMMON[refs].match

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def fail(self, what: str) -> PdfError:
        return PdfError("Parse", f"{what} at byte {self.pos}")

    def word(self) -> bytes:
        """The next run of regular characters, perhaps none."""
        self.skip()
        m = _WORD.match(self.data, self.pos)
        if not m:
            return b""
        self.pos = m.end()
        return m[0]

    def expect(self, word: bytes) -> None:
        at = self.pos
        if self.word() != word:
            self.pos = at
            raise self.fail(f"{word.decode()} is missing")

    def integer(self) -> int:
        if m := _INTEGER.match(self.data, self.pos):
            self.pos = m.end()
            return int(m[1])
        w = self.word()
        if not w.isdigit():
            raise self.fail("a whole number is missing")
        return int(w)

    def at_operand(self) -> bool:
        self.skip()
        d = self.data[self.pos : self.pos + 1]
        return d in (b"/", b"(", b"<", b"[") or bool(_NUMBER.match(self.data, self.pos)) or bool(_CONSTANT.match(self.data, self.pos))

    def value(self) -> Any:
        if m := self.common(self.data, self.pos):
            kind = m.lastindex
            if kind < 6:
                self.pos = m.end()
                if kind == 2:
                    return Ref(int(m[1]), int(m[2]))
                if kind == 3:
                    return _known(m[3])
                if kind == 4:
                    return float(m[4]) if b"." in m[4] else int(m[4])
                return m[5]
            self.pos = m.start(kind)
            if kind == 7 and (m := _WHOLE.match(self.data, self.pos)):
                self.pos = m.end()
                return [*map(int, m[1].split())]
            return self._nested(self._dict if kind == 6 else self._array)
        self.skip()
        data, pos = self.data, self.pos
        lead = data[pos : pos + 1]
        if lead == b"/":
            m = _NAME.match(data, pos)
            self.pos = m.end()
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[1])
            return Name(raw.decode("utf-8", "surrogateescape"))
        if lead == b"(":
            return self._literal()
        if data[pos : pos + 2] == b"<<":
            return self._nested(self._dict)
        if lead == b"<":
            m = _HEX.match(data, pos)
            if not m:
                raise self.fail("a hexadecimal string is broken")
            self.pos = m.end()
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", m[1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if lead == b"[":
            return self._nested(self._array)
        if self.refs and (m := _REF.match(data, pos)):
            self.pos = m.end()
            return Ref(int(m[1]), int(m[2]))
        if m := _NUMBER.match(data, pos):
            self.pos = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        w = self.word()
        if w in (b"true", b"false"):
            return w == b"true"
        if w == b"null":
            return None
        self.pos = pos
        raise self.fail("a value is missing")

    def _nested(self, read) -> Any:
        self.level += 1
        if self.level > MAX_NESTING:
            raise self.fail("values are nested too deeply")
        out = read()
        self.level -= 1
        return out

    def _array(self) -> list:
        self.pos += 1
        out = []
        while True:
            if m := _CLOSE.match(self.data, self.pos):
                self.pos = m.end()
                return out
            self.skip()  # a comment
            if self.data[self.pos : self.pos + 1] == b"]":
                self.pos += 1
                return out
            out.append(self.value())

    def _dict(self) -> dict:
        self.pos += 2
        out: dict = {}
        refs = self.refs
        while True:
            if refs and (m := _PAIR.match(self.data, self.pos)):
                self.pos, kind = m.end(), m.lastindex
                out[m[1].decode()] = Ref(int(m[2]), int(m[3])) if kind == 3 else _known(m[4]) if kind == 4 else int(m[5])
                continue
            if m := _KEY.match(self.data, self.pos):
                self.pos = m.end()
                if m[1] is None:
                    return out
                out[m[1].decode()] = self.value()
                continue
            self.skip()
            if self.data[self.pos : self.pos + 2] == b">>":
                self.pos += 2
                return out
            key = self.value()
            if not isinstance(key, Name):
                raise self.fail("a key is not a name")
            out[str(key)] = self.value()

    def _literal(self) -> bytes:
        data, pos, depth, out = self.data, self.pos + 1, 1, []
        while True:
            if m := _PLAIN.match(data, pos):
                out.append(m[0])
                pos = m.end()
            c = data[pos : pos + 1]
            pos += 1
            if not c:
                raise self.fail("a string does not end")
            if c == b"(":
                depth += 1
                out.append(c)
            elif c == b")":
                depth -= 1
                if not depth:
                    self.pos = pos
                    return b"".join(out)
                out.append(c)
            elif c == b"\r":
                pos += data[pos : pos + 1] == b"\n"
                out.append(b"\n")
            elif m := _OCTAL.match(data, pos):
                out.append(bytes([int(m[0], 8) & 255]))
                pos = m.end()
            else:
                e = data[pos : pos + 1]
                pos += 1
                if e == b"\r":
                    pos += data[pos : pos + 1] == b"\n"
                elif e != b"\n":
                    out.append(_ESCAPES.get(e, e))


def number_text(v: float, places: int = 6) -> str:
    """A number without trailing zeros."""
    if isinstance(v, int):
        return str(v)
    s = f"{v:.{places}f}".rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


@lru_cache(4096)
def _known(raw: bytes) -> Name:
    """A name without escapes."""
    return Name(raw.decode())


@lru_cache(4096)
def _name(v: str) -> bytes:
    raw = v.encode("utf-8", "surrogateescape")
    return b"/" + re.sub(rb"[^!\"$&'*-.0-;=?-Z\\^-z|~]", lambda m: b"#%02X" % m[0][0], raw)


def serialise(v: Any) -> bytes:
    """PDF syntax of a value."""
    kind = type(v)
    if kind is Name:
        return _name(v)
    if kind is Ref:
        return b"%d %d R" % v
    if kind is int:
        return b"%d" % v
    if kind is dict:
        return b"<< " + b" ".join([_name(k) + b" " + serialise(v[k]) for k in sorted(v)]) + b" >>"
    if isinstance(v, (bytes, bytearray)):
        if _PRINTABLE.fullmatch(v):
            return b"(" + _BRACKETS.sub(rb"\\\1", bytes(v)) + b")"
        return b"<" + bytes(v).hex().upper().encode() + b">"
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, (int, float)):
        return number_text(v).encode()
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialise, v)) + b"]"
    raise PdfError("Unsupported", f"{kind.__name__} has no syntax")
