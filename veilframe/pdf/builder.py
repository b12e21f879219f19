"""Small documents from lines of text, for output of plain tables as PDF and for tests."""

from __future__ import annotations

import zlib
from typing import Any

from veilframe.pdf import crypto, writer
from veilframe.pdf.lexer import serialise
from veilframe.pdf.model import File, Name, Ref, Stream

HELVETICA = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


def assemble(contents: list[bytes], resources: dict | None = None, extra: dict[int, Any] | None = None, page: dict | None = None, catalog: dict | None = None, form: str = "classic") -> File:
    """A file with a page per content stream. Objects: 1 catalog, 2 page tree, 5 font, ``extra`` by number, pages from 20."""
    file = File("1.4" if form == "classic" else "1.5", form=form)
    kids = []
    file.objects[Ref(5)] = dict(HELVETICA)
    res = {"Font": {"F1": Ref(5)}} | (resources or {})
    for i, c in enumerate(contents):
        file.objects[Ref(21 + 2 * i)] = Stream({"Length": len(c)}, c)
        file.objects[Ref(20 + 2 * i)] = {"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, 612, 792], "Resources": res, "Contents": Ref(21 + 2 * i)} | (page or {})
        kids.append(Ref(20 + 2 * i))
    file.objects[Ref(1)] = {"Type": Name("Catalog"), "Pages": Ref(2)} | (catalog or {})
    file.objects[Ref(2)] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    for num, v in (extra or {}).items():
        file.objects[Ref(num)] = v
    file.trailer = {"Root": Ref(1)}
    return file


def from_text(text: str, lines: int = 50, form: str = "classic") -> bytes:
    """The text layer's pages as a document: line n at (72, 720 - 12 n) in size 10. What WinAnsi lacks is a question mark."""
    rows = text.split("\n")
    contents = []
    for a in range(0, len(rows), lines):
        ops = [b"BT /F1 10 Tf 12 TL 72 720 Td"]
        for k, row in enumerate(rows[a : a + lines]):
            raw = row.encode("cp1252", "replace")
            ops += [b"T*"] * (k > 0) + ([serialise(raw) + b" Tj"] if raw else [])
        contents.append(b"\n".join([*ops, b"ET\n"]))
    file = assemble(contents, form=form)
    for ref, v in file.objects.items():
        if isinstance(v, Stream):
            file.objects[ref] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(v.data))
    return writer.save(file)


def encrypt(file: File, v: int, r: int, method: str, user: bytes, owner: bytes) -> bytes:
    """A classic file under the standard handler, for tests of reading: streams are encrypted, not strings."""
    ident, p = b"0123456789abcdef", -44
    if v < 5:
        size = 5 if v == 1 else 16
        k, o = crypto.owner_key(owner, r, size), (user + crypto.PAD)[:32]
        for i in range(1 if r == 2 else 20):
            o = crypto.rc4(bytes(b ^ i for b in k), o)
        key = crypto.file_key(user, o, p, ident, r, size, True)
        d = {"O": o, "U": crypto.user_entry(key, ident, r).ljust(32, b"\0"), "Length": size * 8}
    else:
        key, salt = bytes(range(32)), b"saltsaltkeysaltk"
        u = crypto.hash_2b(user, salt[:8], b"", r) + salt
        o = crypto.hash_2b(owner, salt[:8], u[:48], r) + salt
        wrap = lambda word, more: crypto.cbc_encrypt(crypto.hash_2b(word, salt[8:], more, r), b"\0" * 16, key)
        d = {"O": o, "U": u, "UE": wrap(user, b""), "OE": wrap(owner, u[:48])}
    d |= {"Filter": Name("Standard"), "V": v, "R": r, "P": p}
    if v >= 4:
        d |= {"CF": {"StdCF": {"CFM": Name(method)}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    for ref, x in list(file.objects.items()):
        if isinstance(x, Stream):
            own = key if method == "AESV3" else crypto.object_key(key, ref, method)
            file.objects[ref] = Stream(x.dict, crypto.rc4(own, x.data) if method == "V2" else crypto.seal(own, b"i" * 16, x.data))
    file.objects[Ref(30)] = d
    file.trailer |= {"ID": [ident] * 2}
    return writer.save(file).replace(b"trailer\n<< ", b"trailer\n<< /Encrypt 30 0 R ")
