"""PNG and BMP files as gray rasters; whatever is broken, cut off or of another kind is null instead of an error.

A PNG byte is told from those left of it, above it and above to the left, so bytes of one diagonal (x + y) do not need each
other: a picture is undone diagonal by diagonal, all rows at once whatever their filters are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shipping import shipped
from .files import MIN_IMAGE_BYTES

# The formats' marks, channels by PNG color type, the passes of interlaced pictures (first and step of x and y), weights of red, green and blue.
PNG_MARK, BMP_MARK = b"\x89PNG\r\n\x1a\n", b"BM"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2))
LUMA = np.array([0.299, 0.587, 0.114])
MOST_PIXELS = 1 << 28


class Broken(ValueError):
    """The file is not a picture that can be read."""


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows (height, bytes) behind their filters (one for each row); step: bytes of a pixel."""
    if len(kinds) and kinds.max() > 4:
        raise Broken("unknown filter")
    h, n = len(rows), rows.shape[1] // step
    left = rows.reshape(h, n, step).astype(np.int16)
    out = np.zeros((h + 1, n + 1, step), np.int16)
    for d in range(h + n - 1):
        y = np.arange(max(0, d - n + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        nearest = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(a), a, b, (a + b) >> 1, nearest])
        out[y + 1, x + 1] = (left[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, -1).astype(np.uint8)


def samples(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """(height, width, channels) numbers of 1 to 16 bits each."""
    if bits == 16:
        return rows.view(">u2").reshape(len(rows), width, channels).astype(int)
    if bits == 8:
        return rows.reshape(len(rows), width, channels)
    ones = np.unpackbits(rows, axis=1)[:, : width * bits].reshape(len(rows), width, 1, bits)
    return ones @ (1 << np.arange(bits)[::-1])


def gray(v: np.ndarray, most: int) -> np.ndarray:
    """0 to 1 from gray or color samples; a channel of opacity (the second or fourth) does not count."""
    x = v / most
    return x[:, :, :3] @ LUMA if v.shape[2] > 2 else x[:, :, 0]


def colored(index: np.ndarray, palette: np.ndarray) -> np.ndarray:
    if index.size and index.max() >= len(palette):
        raise Broken("no such color")
    return gray(palette[index], 255)


def png(data: bytes) -> np.ndarray:
    at, head, palette, packed, ended = len(PNG_MARK), None, np.zeros((0, 3), np.uint8), [], False
    while not ended:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise Broken("checksum")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if head is None:
        raise Broken("no header")
    w, h, bits, color, _, _, interlaced = head
    allowed = {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(color, (8, 16))
    if color not in CHANNELS or bits not in allowed or not 0 < w * h <= MOST_PIXELS or interlaced > 1:
        raise Broken("header")
    channels = CHANNELS[color]
    parts = [(len(range(x0, w, dx)), len(range(y0, h, dy)), x0, dx, y0, dy) for x0, dx, y0, dy in (PASSES if interlaced else ((0, 1, 0, 1),))]
    parts = [(pw, ph, 1 + (pw * channels * bits + 7) // 8, *place) for pw, ph, *place in parts if pw and ph]
    length = sum(ph * n for _, ph, n, *_ in parts)
    flat = zlib.decompressobj().decompress(b"".join(packed), length)
    if len(flat) != length:
        raise Broken("cut off")
    out, begin = np.zeros((h, w)), 0
    for pw, ph, n, x0, dx, y0, dy in parts:
        rows = np.frombuffer(flat, np.uint8, ph * n, begin).reshape(ph, n)
        begin += ph * n
        v = samples(unfiltered(rows[:, 0], rows[:, 1:], max(1, channels * bits // 8)), pw, channels, bits)
        out[y0::dy, x0::dx] = colored(v[:, :, 0], palette) if color == 3 else gray(v, (1 << bits) - 1)
    return out


def bmp(data: bytes) -> np.ndarray:
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    up, h = h > 0, abs(h)
    if head < 40 or w <= 0 or not 0 < w * h <= MOST_PIXELS or packed or bits not in (1, 4, 8, 24, 32):
        raise Broken("header")
    n = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, h * n, start).reshape(h, n)[:: -1 if up else 1]
    if bits > 8:
        return gray(rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1], 255)
    colors = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colors, 14 + head).reshape(-1, 4)[:, 2::-1]
    return colored(samples(rows[:, : w if bits == 8 else n], w, 1, bits)[:, :, 0], palette)


def decoded(data: bytes | None) -> np.ndarray | None:
    """Gray values 0 to 1 of a PNG or BMP file (height, width); None where it cannot be read, for whatever reason."""
    if data is None or len(data) < MIN_IMAGE_BYTES:
        return None
    try:
        return png(data) if data.startswith(PNG_MARK) else bmp(data) if data.startswith(BMP_MARK) else None
    except (ValueError, struct.error, zlib.error, OverflowError):
        return None


def decode(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, w, h, px) of files by their content, one row each; w, h and px are null where it cannot be read: null, short, cut off,
    wrong checksum, unknown kind, compressed BMP, over MOST_PIXELS. One picture at a time is unpacked in a task."""
    kept = files.select(key, F.col(content).alias("_content"))
    schema = f"{kept.schema[key].name} {kept.schema[key].dataType.simpleString()}, w int, h int, px array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                v = decoded(batch.column(1)[k].as_py())
                h, w = v.shape if v is not None else (None, None)
                px = pa.array([None if v is None else v.ravel()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([w], pa.int32()), pa.array([h], pa.int32()), px], [key, "w", "h", "px"])

    return shipped(kept).mapInArrow(run, schema)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as (path, w, h, px), for the operators on rasters; unreadable ones have nulls."""
    return decode(spark.read.format("binaryFile").load(path), "path")
