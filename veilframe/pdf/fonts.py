"""Fonts: from the bytes of a shown string to characters and widths."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from typing import Any

from veilframe.functions.encodings import table
from veilframe.pdf import filters
from veilframe.pdf.model import File, Name, PdfError, Stream, as_int, as_number

#: Width of a simple font's code, and of a composite font's CID, where none is given.
DEFAULT_SIMPLE, DEFAULT_CID = 600.0, 1000.0
UNKNOWN = "�"

#: Names of signs that no rule below gives.
_SIGNS = dict(
    pair.split("=")
    for pair in (
        "space=0020 exclam=0021 quotedbl=0022 numbersign=0023 dollar=0024 percent=0025 ampersand=0026 quotesingle=0027 parenleft=0028 parenright=0029 asterisk=002A plus=002B comma=002C hyphen=002D "
        "period=002E slash=002F zero=0030 one=0031 two=0032 three=0033 four=0034 five=0035 six=0036 seven=0037 eight=0038 nine=0039 colon=003A semicolon=003B less=003C equal=003D greater=003E question=003F "
        "at=0040 bracketleft=005B backslash=005C bracketright=005D asciicircum=005E underscore=005F grave=0060 braceleft=007B bar=007C braceright=007D asciitilde=007E exclamdown=00A1 cent=00A2 sterling=00A3 "
        "currency=00A4 yen=00A5 brokenbar=00A6 section=00A7 dieresis=00A8 copyright=00A9 ordfeminine=00AA guillemotleft=00AB logicalnot=00AC registered=00AE macron=00AF degree=00B0 plusminus=00B1 "
        "twosuperior=00B2 threesuperior=00B3 acute=00B4 mu=00B5 paragraph=00B6 periodcentered=00B7 cedilla=00B8 onesuperior=00B9 ordmasculine=00BA guillemotright=00BB onequarter=00BC onehalf=00BD "
        "threequarters=00BE questiondown=00BF AE=00C6 Eth=00D0 multiply=00D7 Oslash=00D8 Thorn=00DE germandbls=00DF ae=00E6 eth=00F0 divide=00F7 oslash=00F8 thorn=00FE dotlessi=0131 Lslash=0141 lslash=0142 "
        "OE=0152 oe=0153 florin=0192 circumflex=02C6 caron=02C7 breve=02D8 dotaccent=02D9 ring=02DA ogonek=02DB tilde=02DC hungarumlaut=02DD endash=2013 emdash=2014 quoteleft=2018 quoteright=2019 "
        "quotesinglbase=201A quotedblleft=201C quotedblright=201D quotedblbase=201E dagger=2020 daggerdbl=2021 bullet=2022 ellipsis=2026 perthousand=2030 guilsinglleft=2039 guilsinglright=203A fraction=2044 "
        "Euro=20AC trademark=2122 minus=2212 ff=FB00 fi=FB01 fl=FB02 ffi=FB03 ffl=FB04"
    ).split()
)
#: Accents as the second part of a letter's name.
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
#: Encodings of composite fonts whose codes are two bytes: CIDs, or the units of UCS-2 or UTF-16. Lines that run down the
#: page are not laid out, so encodings for them are refused rather than laid out across it.
_IDENTITY = ("Identity-H",)
_UNICODE = re.compile(r"Uni(?:GB|JIS|CNS|KS)-(UCS2|UTF16)-H")


def glyph_char(name: str) -> str | None:
    """The character of a glyph name: one letter, a sign, a letter with an accent, or its code in hexadecimal."""
    if name in _SIGNS:
        return chr(int(_SIGNS[name], 16))
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if (accent := _ACCENTS.get(name[1:])) and name[0].isalpha():
        c = unicodedata.normalize("NFC", name[0] + accent)
        return c if len(c) == 1 else None
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        code = int(m[1] or m[2], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    return None


@dataclass
class Font:
    composite: bool = False
    base: dict[int, str] = field(default_factory=dict)
    differences: dict[int, str | None] = field(default_factory=dict)
    to_unicode: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    default: float = DEFAULT_SIMPLE
    utf16: bool = False
    unicode_keys: bool = False
    name: str = "StandardEncoding"  # of the base encoding
    _signs: str | None = field(default=None, repr=False, compare=False)

    def decode(self, raw: bytes) -> list[tuple[str, float, int, int]]:
        """(characters, width, first byte, byte after) of each glyph of a shown string."""
        return self._wide(raw) if self.composite else [(self._char(b), self.widths.get(b, self.default), i, i + 1) for i, b in enumerate(raw)]

    def plain(self, raw: bytes) -> tuple[str, list[float] | float] | None:
        """The characters of a simple font's string and their widths (one for all where all are the same); None where a byte is not one character."""
        if self.composite:
            return None
        if self._signs is None:
            self._signs = _signs(self._char) if self.differences or self.to_unicode or self.base is not _base(self.name) else _base_signs(self.name)
        if not self._signs:
            return None
        text = codecs.charmap_decode(raw, "strict", self._signs)[0] if "\ufffe" not in self._signs else "".join([self._signs[b] for b in raw])
        return text, [self.widths.get(b, self.default) for b in raw] if self.widths else self.default

    def _char(self, b: int) -> str:
        if b in self.to_unicode:
            return self.to_unicode[b]
        if b in self.differences:
            return self.differences[b] or UNKNOWN
        return self.base.get(b, UNKNOWN)

    def _wide(self, raw: bytes) -> list[tuple[str, float, int, int]]:
        out, i = [], 0
        while i + 1 < len(raw):
            code, n = raw[i] << 8 | raw[i + 1], 2
            if self.utf16 and 0xD800 <= code < 0xDC00:  # the first half of a pair, which ToUnicode has no key for
                if not (i + 3 < len(raw) and 0xDC <= raw[i + 2] < 0xE0):
                    raise PdfError("Corrupt", "half a UTF-16 pair")
                ch, n = raw[i : i + 4].decode("utf-16-be"), 4
            elif self.unicode_keys:
                ch = UNKNOWN if 0xD800 <= code < 0xE000 else self.to_unicode.get(code) or chr(code)
            else:
                ch = self.to_unicode.get(code) or (chr(code) if 32 <= code < 127 else UNKNOWN)
            out.append((ch, self.widths.get(code, self.default), i, i + n))
            i += n
        if i < len(raw):
            raise PdfError("Corrupt", "a string of two-byte codes has an odd byte")
        return out


@cache
def _base(name: str) -> dict[int, str]:
    """The one table of a base encoding; fonts read it and never change it."""
    return table(name)


def _signs(char: Callable[[int], str]) -> str:
    """The characters of all bytes, empty where one of them is not just one."""
    chars = [char(b) for b in range(256)]
    return "".join(chars) if all(len(c) == 1 for c in chars) else ""


@cache
def _base_signs(name: str) -> str:
    return _signs(lambda b: _base(name).get(b, UNKNOWN))


def load(file: File, value: Any) -> Font:
    d = file.dict_of(value)
    kind = d.get("Subtype")
    if kind in ("Type1", "TrueType", "MMType1"):
        font = _simple(file, d)
    elif kind == "Type0":
        font = _composite(file, d)
    else:
        raise PdfError("Unsupported", f"font type {kind}")
    cmap = file.resolve(d.get("ToUnicode"))
    if isinstance(cmap, Stream):
        font.to_unicode = parse_cmap(filters.decode(cmap.data, cmap.dict, file.resolve))
    return font


def _simple(file: File, d: dict) -> Font:
    enc = file.resolve(d.get("Encoding"))
    name = enc if isinstance(enc, Name) else enc.get("BaseEncoding") if isinstance(enc, dict) else None
    if name is not None and name not in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding"):
        raise PdfError("Unsupported", f"encoding {name}")
    base = str(name) if name else "StandardEncoding"
    font = Font(base=_base(base), name=base)
    if isinstance(enc, dict):
        code = 0
        for x in file.resolve(enc.get("Differences")) or []:
            x = file.resolve(x)
            if isinstance(x, Name):
                font.differences[code] = glyph_char(str(x))
                code += 1
            elif (n := as_int(x)) is not None:
                code = n
    first, widths = as_int(file.resolve(d.get("FirstChar")), 0), file.resolve(d.get("Widths")) or []
    for k, w in enumerate(widths):  # codes below the first have the default, like those above the last
        if (n := as_number(file.resolve(w))) is not None:
            font.widths[first + k] = n
    return font


def _composite(file: File, d: dict) -> Font:
    enc = file.resolve(d.get("Encoding"))
    m = _UNICODE.fullmatch(str(enc))
    if enc not in _IDENTITY and not m:
        raise PdfError("Unsupported", f"composite encoding {enc}")
    kids = file.resolve(d.get("DescendantFonts")) or []
    if not kids:
        raise PdfError("Corrupt", "a composite font has no descendant")
    below = file.dict_of(kids[0])
    font = Font(composite=True, default=as_number(file.resolve(below.get("DW")), DEFAULT_CID), utf16=bool(m) and m[1] == "UTF16", unicode_keys=bool(m))
    w = [file.resolve(x) for x in file.resolve(below.get("W")) or []]
    if w and m:
        raise PdfError("Unsupported", "CID widths with codes that are not CIDs")
    i = 0
    while i + 1 < len(w):
        first = as_int(w[i], 0)
        if isinstance(w[i + 1], list):
            for k, x in enumerate(w[i + 1]):
                font.widths[first + k] = as_number(file.resolve(x), font.default)
            i += 2
        elif i + 2 < len(w):
            last = min(as_int(w[i + 1], 0), 0xFFFF)
            font.widths |= dict.fromkeys(range(first, last + 1), as_number(w[i + 2], font.default))
            i += 3
        else:
            raise PdfError("Corrupt", "CID widths are cut short")
    return font


_SECTION = re.compile(rb"begin(bfchar|bfrange)(.*?)end\1", re.S)
_CHAR = re.compile(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>")
_RANGE = re.compile(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[([^\]]*)\])")


def _hex(raw: bytes) -> bytes:
    s = re.sub(rb"\s", b"", raw)
    return bytes.fromhex((s + b"0" * (len(s) % 2)).decode())


def parse_cmap(data: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map; codes of over two bytes are left out."""
    out: dict[int, str] = {}
    text = lambda raw: raw.decode("utf-16-be", "replace")
    for m in _SECTION.finditer(data):
        if m[1] == b"bfchar":
            for c in _CHAR.finditer(m[2]):
                if len(k := _hex(c[1])) <= 2:
                    out[int.from_bytes(k)] = text(_hex(c[2]))
            continue
        for r in _RANGE.finditer(m[2]):
            a, b = _hex(r[1]), _hex(r[2])
            if len(a) > 2 or len(b) > 2:
                continue
            lo, hi = int.from_bytes(a), int.from_bytes(b)
            if r[4] is not None:
                for k, x in zip(range(lo, hi + 1), re.findall(rb"<([0-9A-Fa-f\s]*)>", r[4])):
                    out[k] = text(_hex(x))
                continue
            to = _hex(r[3])
            for k in range(lo, hi + 1):  # the last unit counts up
                n = int.from_bytes(to[-2:]) + k - lo
                out[k] = text(to[:-2] + (n & 0xFFFF).to_bytes(2))
    return out
