"""Baseline JPEG pictures to samples, so that a part of one can be painted over.

Sequential pictures of 8 bits with Huffman codes (what cameras and scanners mostly write);
progressive and arithmetic-coded ones are refused. Entropy decoding goes symbol by symbol;
the inverse cosine transform, scaling up and colours are array operations over all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from veilframe.pdf.model import PdfError

#: Pixels of a picture that is decoded, at most.
MAX_PIXELS = 1 << 27


def _corrupt(what: str) -> PdfError:
    return PdfError("Corrupt", f"JPEG: {what}")


def _zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient: along the diagonals, turning at each end."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


_ORDER = _zigzag()
_WAVES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@dataclass
class _Part:
    """A colour component: sampling factors, its quantisation table and its coefficients."""

    ident: int
    across: int
    down: int
    table: int
    wide: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits that may come next: length of the code they begin with, and its symbol (0: no code)."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            if code >= 1 << bits:
                raise _corrupt("too many codes")
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
            code += 1
        at += n
        code <<= 1
    return out.tolist()


class _Reader:
    """Coefficients of the blocks of one restart interval, in turn."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.acc, self.n = raw.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def block(self, dc: list[int], ac: list[int], before: int) -> list[int]:
        out, k, raw, at, acc, n = [0] * 64, 0, self.raw, self.at, self.acc, self.n
        while k < 64:
            if n < 48:
                acc = (acc & ((1 << n) - 1)) << 64 | int.from_bytes(raw[at : at + 8].ljust(8, b"\0"))
                at, n = at + 8, n + 64
            look = (ac if k else dc)[acc >> (n - 16) & 0xFFFF]
            n -= look >> 8
            symbol = look & 0xFF
            if not look:
                raise _corrupt("an unknown code")
            size = symbol & 15 if k else symbol
            if k:
                if not size and symbol != 0xF0:
                    break  # the rest is zero
                k += symbol >> 4
            if size:
                n -= size
                v = acc >> n & ((1 << size) - 1)
                if k > 63 or size > 15:
                    raise _corrupt("a block has too many coefficients")
                out[k] = v if v >> (size - 1) else v - (1 << size) + 1
            k += 1
        if at * 8 - n > len(raw) * 8:
            raise _corrupt("the data end early")
        out[0] += before
        self.at, self.acc, self.n = at, acc, n
        return out


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded bytes of a scan, cut at restart marks, and where the next marker is."""
    out, begin = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[begin:]], len(data)
        mark = data[at + 1]
        if 0xD0 <= mark <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        elif mark not in (0, 0xFF):
            return [*out, data[begin:at]], at
        at += 1 if mark == 0xFF else 2


def decode(data: bytes, transform: int | None = None) -> np.ndarray:
    """Samples (height, width, components); ``transform``: whether colours are differences, unless the picture itself says."""
    tables: dict[int, np.ndarray] = {}
    codes: dict[int, list[int]] = {}
    parts: list[_Part] = []
    width = height = restart = 0
    at = data.find(b"\xff\xd8") + 2
    if at < 2:
        raise _corrupt("no picture")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xD9:
            break
        if mark in (0, 1, 0xFF) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                step = 2 if body[0] >> 4 else 1
                if len(body) < 1 + 64 * step:
                    raise _corrupt("a quantisation table is cut short")
                tables[body[0] & 15] = np.frombuffer(body, ">u2" if step == 2 else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * step :]
        elif mark == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise PdfError("Unsupported", "JPEG: not of 8 bits")
            height, width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            parts = [_Part(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            if not parts or not width or not height or width * height > MAX_PIXELS or not all(0 < p.across < 5 and 0 < p.down < 5 for p in parts):
                raise _corrupt("its size")
            most = max(p.across for p in parts), max(p.down for p in parts)
            cells = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
            for p in parts:
                p.blocks = np.zeros((cells[1] * p.down, cells[0] * p.across, 64), np.int32)
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8:
            raise PdfError("Unsupported", "JPEG: neither baseline nor sequential")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2])
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            transform = body[11]
        elif mark == 0xDA:
            if not parts:
                raise _corrupt("a scan before its frame")
            runs, at = _intervals(data, at)
            _scan(body, runs, parts, codes, restart, (width, height), most, cells)
    if not parts:
        raise _corrupt("no frame")
    planes = []
    for p in parts:
        if p.table not in tables:
            raise _corrupt("no quantisation table")
        whole = np.zeros(p.blocks.shape, np.float64)
        whole[:, :, _ORDER] = p.blocks * tables[p.table]
        rows, across = p.blocks.shape[:2]
        square = np.einsum("ux,abuv,vy->abxy", _WAVES, whole.reshape(rows, across, 8, 8), _WAVES, optimize=True)
        plane = square.transpose(0, 2, 1, 3).reshape(rows * 8, across * 8) + 128
        planes.append(plane[np.arange(height) * p.down // most[1]][:, np.arange(width) * p.across // most[0]])
    return _colours(planes, transform)


def _scan(head: bytes, runs: list[bytes], parts: list[_Part], codes: dict, restart: int, size: tuple[int, int], most: tuple[int, int], cells: tuple[int, int]) -> None:
    chosen = []
    for i in range(1, 1 + 2 * head[0], 2):
        part = next((p for p in parts if p.ident == head[i]), None)
        pair = codes.get(head[i + 1] >> 4), codes.get(16 | head[i + 1] & 15)
        if part is None or None in pair:
            raise _corrupt("a scan without its tables")
        chosen.append((part, *pair))
    if len(chosen) == 1:  # block by block, without those that only fill up a cell
        p = chosen[0][0]
        wide, high = (-(-(-(-size[k] * (p.across, p.down)[k] // most[k])) // 8) for k in (0, 1))
        units = [[(0, y, x)] for y in range(high) for x in range(wide)]
    else:
        units = [
            [(j, cy * p.down + y, cx * p.across + x) for j, (p, _, _) in enumerate(chosen) for y in range(p.down) for x in range(p.across)]
            for cy in range(cells[1]) for cx in range(cells[0])
        ]
    per = restart or len(units)
    for k, a in enumerate(range(0, len(units), per)):
        if k >= len(runs):
            raise _corrupt("a restart interval is missing")
        reader, before = _Reader(runs[k]), [0] * len(chosen)
        for unit in units[a : a + per]:
            for j, y, x in unit:
                part, dc, ac = chosen[j]
                block = reader.block(dc, ac, before[j])
                before[j] = block[0]
                part.blocks[y, x] = block


def _colours(planes: list[np.ndarray], transform: int | None) -> np.ndarray:
    if len(planes) == 3 and transform != 0 or len(planes) == 4 and transform == 2:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        rgb = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
        planes = rgb if len(planes) == 3 else [*(255 - c for c in rgb), planes[3]]
    return np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)
