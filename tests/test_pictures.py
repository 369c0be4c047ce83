"""Pictures written here by plain rules and read back; broken ones are null."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from folioflow.sources import pictures


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def written(rows, w, h, bits, color, step, rng, palette=b"", interlaced=0):
    """rows: bytes of each row (of each pass); every row behind a filter of its own, one byte after the other."""
    out = bytearray()
    for part in rows:
        above = bytes(len(part[0])) if part else b""
        for row in part:
            kind = int(rng.integers(0, 5))
            out.append(kind)
            for i, value in enumerate(row):
                a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
                out.append((value - guess) % 256)
            above = row
    head = struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, interlaced)
    packed = zlib.compress(bytes(out))
    half = len(packed) // 2
    return pictures.PNG_MARK + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


def packed(row, bits):
    text = "".join(format(int(x), f"0{bits}b") for x in row)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


@pytest.mark.parametrize(("color", "bits"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 2), (3, 8), (4, 8), (6, 8), (6, 16)])
@pytest.mark.parametrize("interlaced", [0, 1])
def test_png(color, bits, interlaced):
    rng = np.random.default_rng(color * 100 + bits)
    n, step = pictures.CHANNELS[color], max(1, pictures.CHANNELS[color] * bits // 8)
    for w, h in ((1, 1), (7, 5), (13, 21)):
        v = rng.integers(0, 1 << bits, (h, w, n))
        passes = pictures.PASSES if interlaced else ((0, 1, 0, 1),)
        parts = [v[y0::dy, x0::dx] for x0, dx, y0, dy in passes]
        palette = rng.integers(0, 256, (1 << bits, 3)) if color == 3 else None
        data = written([[packed(r.ravel(), bits) for r in p] for p in parts if p.size], w, h, bits, color, step, rng, bytes(palette.ravel().tolist()) if color == 3 else b"", interlaced)
        rgb = palette[v[:, :, 0]] / 255 if color == 3 else v[:, :, [0, 0, 0] if n < 3 else [0, 1, 2]] / ((1 << bits) - 1)
        assert np.allclose(pictures.decoded(data), 0.299 * rgb[:, :, 0] + 0.587 * rgb[:, :, 1] + 0.114 * rgb[:, :, 2])


@pytest.mark.parametrize("bits", [1, 4, 8, 24, 32])
@pytest.mark.parametrize("up", [True, False])
def test_bmp(bits, up):
    rng = np.random.default_rng(bits)
    w, h = 9, 4
    if bits > 8:
        v = rng.integers(0, 256, (h, w, bits // 8))
        rows, palette, bgr = [bytes(r.ravel().tolist()) for r in v], b"", v
    else:
        colors, index = rng.integers(0, 256, (1 << bits, 4)), rng.integers(0, 1 << bits, (h, w))
        rows, palette, bgr = [packed(r, bits) for r in index], bytes(colors.ravel().tolist()), colors[index]
    rows = [r + bytes(-len(r) % 4) for r in rows]
    data = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + len(palette)) + struct.pack("<IiiHHIIiiII", 40, w, h if up else -h, 1, bits, 0, 0, 0, 0, 0, 0) + palette + b"".join(rows[::-1] if up else rows)
    assert np.allclose(pictures.decoded(data), (0.299 * bgr[:, :, 2] + 0.587 * bgr[:, :, 1] + 0.114 * bgr[:, :, 0]) / 255)
    assert pictures.decoded(data[:-1]) is None


def test_broken_files_are_null(spark):
    rng = np.random.default_rng(1)
    good = written([[bytes(rng.integers(0, 256, 12).tolist()) for _ in range(9)]], 12, 9, 8, 0, 1, rng)
    for n in range(len(good)):
        assert pictures.decoded(good[:n]) is None
        hurt = bytearray(good)
        hurt[n] ^= 0x55
        assert pictures.decoded(bytes(hurt)) is None
    for _ in range(300):
        noise = rng.bytes(200)
        assert pictures.decoded(pictures.PNG_MARK + noise) is None
        pictures.decoded(b"BM" + noise)
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(good[:-20])), (5, bytearray(b"GIF89a" + bytes(20))), (None, bytearray(good))]
    got = pictures.decode(spark.createDataFrame(rows, "id bigint, content binary"), "id").collect()
    assert sorted((r.id or 0, r.w, r.h, r.px and len(r.px)) for r in got if r.px) == [(0, 12, 9, 108), (1, 12, 9, 108)] and len(got) == 6
    assert pictures.decode(spark.createDataFrame([], "id bigint, content binary"), "id").count() == 0


def test_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "a.png").write_bytes(written([[b"\x00\xff", b"\xff\x00"]], 2, 2, 8, 0, 1, rng))
    (tmp_path / "b.png").write_bytes(b"nothing")
    got = {r.path[-5:]: r.px for r in pictures.read_pictures(spark, str(tmp_path)).collect()}
    assert got == {"a.png": [0.0, 1.0, 1.0, 0.0], "b.png": None}
