"""The picture decoder against pictures that a plain encoder makes here, and redaction of a part of one."""

from __future__ import annotations

import numpy as np
import pytest

from veilframe.pdf import filters, jpeg
from veilframe.pdf.model import Name, PdfError, Stream
from test_pdf_document import RECT, TestImages, image

WAVES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def zigzag():
    out, y, x, up = [], 0, 0, True
    while len(out) < 64:
        out.append((y, x))
        if up:
            y, x, up = (y + 1, x, False) if x == 7 else (y, x + 1, False) if y == 0 else (y - 1, x + 1, True)
        else:
            y, x, up = (y, x + 1, True) if y == 7 else (y + 1, x, True) if x == 0 else (y + 1, x - 1, False)
    return out


def test_the_order_of_coefficients():
    assert [(k // 8, k % 8) for k in jpeg._ORDER.tolist()] == zigzag()


def segment(mark, body):
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2) + body


def encode(planes, factors, width, height, quant=1, restart=0, adobe=None, single=False):
    """Planes (of whole cells) as a baseline picture; every code has 8 bits."""
    symbols = bytes(sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0} | set(range(12))))
    most = max(f[0] for f in factors), max(f[1] for f in factors)
    cells = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    out = b"\xff\xd8" + (segment(0xEE, b"Adobe" + b"\0" * 6 + bytes([adobe])) if adobe is not None else b"")
    out += segment(0xDB, b"\0" + bytes([quant]) * 64)
    out += segment(0xC0, b"\x08" + height.to_bytes(2) + width.to_bytes(2) + bytes([len(planes)]) + b"".join(bytes([i + 1, f[0] << 4 | f[1], 0]) for i, f in enumerate(factors)))
    for k in (0x00, 0x10):
        out += segment(0xC4, bytes([k]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols)
    out += segment(0xDD, restart.to_bytes(2)) if restart else b""

    def blocks(i, y, x, before):
        f = WAVES @ (planes[i][8 * y : 8 * y + 8, 8 * x : 8 * x + 8].astype(float) - 128) @ WAVES.T
        c = [int(np.rint(f[a, b] / quant)) for a, b in zigzag()]
        diff, bits, run = c[0] - before, "", 0
        code = lambda s: f"{symbols.index(s):08b}"
        size = lambda v: abs(v).bit_length()
        value = lambda v: f"{v if v > 0 else v + (1 << size(v)) - 1:0{size(v)}b}" if v else ""
        bits += code(size(diff)) + value(diff)
        for v in c[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + code(0xF0), run - 16
            bits, run = bits + code(run << 4 | size(v)) + value(v), 0
        return bits + (code(0) if run else ""), c[0]

    def scan(chosen, units):
        data = segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([i + 1, 0]) for i in chosen) + b"\0\x3f\0")
        for k, a in enumerate(range(0, len(units), restart or len(units))):
            bits, before = "", dict.fromkeys(chosen, 0)
            for i, y, x in (b for u in units[a : a + (restart or len(units))] for b in u):
                more, before[i] = blocks(i, y, x, before[i])
                bits += more
            bits += "1" * (-len(bits) % 8)
            raw = int(bits, 2).to_bytes(len(bits) // 8)
            data += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + raw.replace(b"\xff", b"\xff\x00")
        return data

    if single:  # a scan for each component
        for i, f in enumerate(factors):
            wide, high = -(-(-(-width * f[0] // most[0])) // 8), -(-(-(-height * f[1] // most[1])) // 8)
            out += scan([i], [[(i, y, x)] for y in range(high) for x in range(wide)])
    else:
        every = list(range(len(planes)))
        out += scan(every, [[(i, cy * factors[i][1] + y, cx * factors[i][0] + x) for i in every for y in range(factors[i][1]) for x in range(factors[i][0])] for cy in range(cells[1]) for cx in range(cells[0])])
    return out + b"\xff\xd9"


def smooth(rng, high, wide):
    y, x = np.mgrid[:high, :wide]
    return np.clip(128 + 90 * np.sin(x / rng.uniform(3, 9)) * np.cos(y / rng.uniform(3, 9)) + rng.normal(0, 6, (high, wide)), 0, 255).round()


@pytest.mark.parametrize(("width", "height", "restart"), [(8, 8, 0), (17, 23, 0), (40, 9, 2), (33, 33, 1)])
def test_grey(width, height, restart):
    rng = np.random.default_rng(width)
    plane = smooth(rng, -(-height // 8) * 8, -(-width // 8) * 8)
    got = jpeg.decode(encode([plane], [(1, 1)], width, height, restart=restart))
    assert got.shape == (height, width, 1) and np.abs(got[:, :, 0] - plane[:height, :width]).max() <= 1
    coarse = jpeg.decode(encode([plane], [(1, 1)], width, height, quant=12))
    assert 0 < np.abs(coarse[:, :, 0] - plane[:height, :width]).mean() < 8


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("factor", [(1, 1), (2, 1), (2, 2)])
def test_colours_and_sampling(factor, single):
    rng, width, height = np.random.default_rng(7), 37, 29
    wide, high = -(-width // 16) * 16, -(-height // 16) * 16
    planes = [smooth(rng, high, wide), smooth(rng, high // factor[1], wide // factor[0]), smooth(rng, high // factor[1], wide // factor[0])]
    raw = encode(planes, [factor, (1, 1), (1, 1)], width, height, single=single)
    y, b, r = (np.repeat(np.repeat(p, factor[1] if k else 1, 0), factor[0] if k else 1, 1)[:height, :width] for k, p in enumerate(planes))
    want = np.clip(np.stack([y + 1.402 * (r - 128), y - 0.344136 * (b - 128) - 0.714136 * (r - 128), y + 1.772 * (b - 128)], axis=2), 0, 255)
    assert np.abs(jpeg.decode(raw) - want).max() <= 4
    plain = jpeg.decode(encode(planes, [factor, (1, 1), (1, 1)], width, height, adobe=0))
    assert np.abs(plain - np.stack([y, b, r], axis=2)).max() <= 1 and (jpeg.decode(raw, 0) == plain).all()


def test_four_components():
    planes = [smooth(np.random.default_rng(k), 16, 16) for k in range(4)]
    got = jpeg.decode(encode(planes, [(1, 1)] * 4, 16, 16, adobe=2))
    assert got.shape == (16, 16, 4) and np.abs(got[:, :, 3] - planes[3]).max() <= 1


def test_broken_pictures_are_errors():
    raw = encode([smooth(np.random.default_rng(1), 32, 32)], [(1, 1)], 32, 32)
    for bad in (b"", b"\xff\xd8\xff\xd9", raw[:60], raw[:-200], raw.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(PdfError):
            jpeg.decode(bad)


def test_a_part_of_a_picture_is_painted_and_the_rest_stays():
    planes = [smooth(np.random.default_rng(k), 32, 32) for k in range(3)]
    raw = encode(planes, [(1, 1)] * 3, 32, 32)
    pic = image(Filter=Name("DCTDecode"))
    d = TestImages().doc(pic=Stream(pic.dict, raw))
    report = d.apply_redactions({"targets": [{**RECT, "x": 152, "y": 680, "width": 80, "height": 80}], "fillColor": {"r": 1, "g": 2, "b": 3}})
    assert (report.image_draws_masked, report.image_draws_removed, report.warnings) == (1, 0, [])
    (data,) = TestImages().pixels(d)
    got, want = np.frombuffer(data, np.uint8).reshape(32, 32, 3), jpeg.decode(raw)
    assert (got[:16, 16:] == [1, 2, 3]).all() and (got[16:] == want[16:]).all() and (got[:, :16] == want[:, :16]).all()
    assert raw not in d.save() and filters.names({"Filter": Name("DCTDecode")}) == ["DCTDecode"]
