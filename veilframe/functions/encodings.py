"""Simple font encodings: byte to character.

The Windows and Macintosh tables are those of the platform's codecs; the standard one
is ASCII with the letters and signs that PostScript's table puts elsewhere.
"""

from __future__ import annotations

NAMES = ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding")

#: Where the standard encoding differs from ASCII, and its upper half (Adobe's published table).
STANDARD = {
    0x27: 0x2019, 0x60: 0x2018, 0xA1: 0xA1, 0xA2: 0xA2, 0xA3: 0xA3, 0xA4: 0x2044, 0xA5: 0xA5, 0xA6: 0x192, 0xA7: 0xA7, 0xA8: 0xA4, 0xA9: 0x27, 0xAA: 0x201C,
    0xAB: 0xAB, 0xAC: 0x2039, 0xAD: 0x203A, 0xAE: 0xFB01, 0xAF: 0xFB02, 0xB1: 0x2013, 0xB2: 0x2020, 0xB3: 0x2021, 0xB4: 0xB7, 0xB6: 0xB6, 0xB7: 0x2022, 0xB8: 0x201A,
    0xB9: 0x201E, 0xBA: 0x201D, 0xBB: 0xBB, 0xBC: 0x2026, 0xBD: 0x2030, 0xBF: 0xBF, 0xC1: 0x60, 0xC2: 0xB4, 0xC3: 0x2C6, 0xC4: 0x2DC, 0xC5: 0xAF, 0xC6: 0x2D8,
    0xC7: 0x2D9, 0xC8: 0xA8, 0xCA: 0x2DA, 0xCB: 0xB8, 0xCD: 0x2DD, 0xCE: 0x2DB, 0xCF: 0x2C7, 0xD0: 0x2014, 0xE1: 0xC6, 0xE3: 0xAA, 0xE8: 0x141, 0xE9: 0xD8,
    0xEA: 0x152, 0xEB: 0xBA, 0xF1: 0xE6, 0xF5: 0x131, 0xF8: 0x142, 0xF9: 0xF8, 0xFA: 0x153, 0xFB: 0xDF,
}


def table(name: str) -> dict[int, str]:
    """Printable characters of an encoding."""
    if name == "StandardEncoding":
        return {b: chr(b) for b in range(32, 127)} | {b: chr(c) for b, c in STANDARD.items()}
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}[name]
    out = {}
    for b in range(32, 256):
        ch = bytes([b]).decode(codec, "ignore")
        if ch and (ch.isprintable() or ch in "\xa0\xad") and b != 127:
            out[b] = ch
    return out
