"""Whole rewrites of an object table, in the form of cross-reference it came with."""

from __future__ import annotations

import zlib
from typing import Any

from veilframe.pdf.lexer import serialise
from veilframe.pdf.model import File, Name, Ref, Stream

#: Objects in one object stream, at most.
CHUNK = 100
_MARK = b"%\xe2\xe3\xcf\xd3\n"


def save(file: File) -> bytes:
    return _streams(file) if file.form == "stream" else _classic(file)


def _body(ref: Ref, v: Any) -> bytes:
    if isinstance(v, Stream):
        d = serialise(v.dict | {"Length": len(v.data)})
        return b"%d %d obj\n%s\nstream\n%s\nendstream\nendobj\n" % (*ref, d, v.data)
    return b"%d %d obj\n%s\nendobj\n" % (*ref, serialise(v))


def _trailer(file: File) -> dict:
    return {k: v for k, v in file.trailer.items() if k not in ("Prev", "XRefStm", "Encrypt", "Size")}


def _classic(file: File) -> bytes:
    out = bytearray(b"%%PDF-%s\n%s" % (file.version.encode(), _MARK))
    at: dict[int, tuple[int, int]] = {}
    for ref in sorted(file.objects):
        at[ref.num] = (len(out), ref.gen)
        out += _body(ref, file.objects[ref])
    size, start = max(at, default=0) + 1, len(out)
    out += b"xref\n0 %d\n" % size
    free = [n for n in range(size) if n not in at]
    following = dict(zip(free, free[1:] + [0]))
    for n in range(size):
        out += b"%010d %05d n \n" % at[n] if n in at else b"%010d %05d f \n" % (following[n], 65535 if n == 0 else 1)
    out += b"trailer\n%s\nstartxref\n%d\n%%%%EOF\n" % (serialise(_trailer(file) | {"Size": size}), start)
    return bytes(out)


def _streams(file: File) -> bytes:
    version = max(file.version, "1.5")
    out = bytearray(b"%%PDF-%s\n%s" % (version.encode(), _MARK))
    rows: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    loose = [r for r in sorted(file.objects) if not isinstance(file.objects[r], Stream) and r.gen == 0]
    for ref in sorted(set(file.objects) - set(loose)):
        rows[ref.num] = (1, len(out), ref.gen)
        out += _body(ref, file.objects[ref])
    num = max((r.num for r in file.objects), default=0) + 1
    for k in range(0, len(loose), CHUNK):
        part, head, body = loose[k : k + CHUNK], [], b""
        for i, ref in enumerate(part):
            head.append(b"%d %d" % (ref.num, len(body)))
            body += serialise(file.objects[ref]) + b"\n"
            rows[ref.num] = (2, num, i)
        front = b" ".join(head) + b"\n"
        rows[num] = (1, len(out), 0)
        box = {"Type": Name("ObjStm"), "N": len(part), "First": len(front), "Filter": Name("FlateDecode")}
        out += _body(Ref(num), Stream(box, zlib.compress(front + body)))
        num += 1
    start = rows_at = len(out)
    rows[num] = (1, rows_at, 0)
    every = [rows.get(n, (0, 0, 0)) for n in range(num + 1)]
    w = [1, *(max(1, (max(r[k] for r in every).bit_length() + 7) // 8) for k in (1, 2))]
    data = b"".join(v.to_bytes(n) for r in every for v, n in zip(r, w))
    d = _trailer(file) | {"Type": Name("XRef"), "Size": num + 1, "W": w, "Filter": Name("FlateDecode")}
    out += _body(Ref(num), Stream(d, zlib.compress(data)))
    out += b"startxref\n%d\n%%%%EOF\n" % start
    return bytes(out)
