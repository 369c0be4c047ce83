"""Gray rasters: local means, conditioning, thresholds, tilt, ruling lines and document corners.

A raster is a row (img_id, w, h, px), px an array of w*h values from 0 to 1, row by row. Each is
worked on by itself with numpy in Arrow batches; one raster is in memory at a time. What is wider than an
analysis width (640 for means, 500 for tilt, 480 for corners, 900 for lines) is measured on a smaller copy, and
places found there are mapped back. Averages stay doubles; they are not rounded to levels in between.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Quad
from .shipping import shipped

# The rules' constants.
MEAN_RATIO, MEAN_RADIUS, MIN_LOCAL, CLIP_SHARE, MIN_RANGE, DARK_BIAS = 0.06, 3, 0.02, 0.02, 16, 0.90
SKEW_MAX, SKEW_STEP, SKEW_DARK, SKEW_PIXELS, SKEW_ROTATE = 4.0, 0.5, 0.8, 50, 0.75
LINE_BIAS, LINE_RADIUS, LINE_COVER, LINE_MERGE, LINE_MOST, LINE_MARGIN_X, LINE_MARGIN_Y, LINE_MIN = 0.92, 4, 0.55, 6, 40, 0.06, 0.10, 40
#: Windows up to this radius are added up pixel by pixel, wider ones by an integral image.
ADDED_RADIUS = 8
MEAN_WIDTH, SKEW_WIDTH, QUAD_WIDTH, LINE_WIDTH = 640, 500, 480, 900
QUAD_MIN, QUAD_SHARE_LOW, QUAD_SHARE_HIGH = 32, 0.35, 0.97


def nearest(x):
    """Nearest whole number, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def integral(v: np.ndarray) -> np.ndarray:
    out = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
    out[1:, 1:] = v.cumsum(axis=0).cumsum(axis=1)
    return out


def _added(v: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the columns around each column, from left to right; what lies outside adds nothing."""
    wide = np.pad(v, ((0, 0), (radius, radius)))
    out = np.zeros(v.shape)
    for k in range(2 * radius + 1):
        out += wide[:, k : k + v.shape[1]]
    return out


def local_mean(v: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the square around each pixel, clipped to the image. Levels of equal windows have equal means where windows are
    added up by themselves: rows first, each from left to right, then downwards. An integral image rounds with all that lies before."""
    h, w = v.shape
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius, h - 1) + 1
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius, w - 1) + 1
    if radius <= ADDED_RADIUS:
        return _added(_added(v, radius).T, radius).T / np.outer(y1 - y0, x1 - x0)
    s = integral(v)
    return (s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)]) / np.outer(y1 - y0, x1 - x0)


def _averaged(v: np.ndarray, n: int) -> np.ndarray:
    """Rows of v averaged down to n: each takes len(v) / n of them, the ones at its ends in part. A part of a row is the
    way between two of its prefix sums."""
    sums = np.zeros((len(v) + 1, v.shape[1]))
    v.cumsum(axis=0, out=sums[1:])
    edges = np.arange(n + 1) * (len(v) / n)
    whole = np.minimum(edges.astype(int), len(v) - 1)
    at = sums[whole] + v[whole] * (edges - whole)[:, None]
    return np.diff(at, axis=0) * (n / len(v))


def shrink(v: np.ndarray, width: int) -> np.ndarray:
    """Area means at a width, the height in proportion (1 at least); what is not wider stays."""
    h, w = v.shape
    if w <= width:
        return v
    return _averaged(_averaged(v, max(1, int(nearest(h * width / w)))).T, width).T


def thin(v: np.ndarray, width: int) -> np.ndarray:
    """Every pixel that a smaller grid's corners fall into; what is not wider stays."""
    h, w = v.shape
    if w <= width:
        return v
    rows = max(1, int(nearest(h * width / w)))
    return v[np.ix_(np.arange(rows) * h // rows, np.arange(width) * w // width)]


def mean_map(v: np.ndarray, width: int = MEAN_WIDTH) -> np.ndarray:
    """Mean around each pixel; wide images look theirs up in the map of their shrunken copy."""
    small = shrink(v, width)
    means = local_mean(small, max(MEAN_RADIUS, int(nearest(min(small.shape) * MEAN_RATIO))))
    if small is v:
        return means
    y, x = (np.minimum(nearest(np.arange(n) * (width / v.shape[1])), m - 1).astype(int) for n, m in zip(v.shape, small.shape, strict=True))
    return means[np.ix_(y, x)]


def levels(v: np.ndarray) -> np.ndarray:
    return np.clip(nearest(v * 255), 0, 255)


def flatten_light(v: np.ndarray) -> np.ndarray:
    """Levels relative to the local mean; small images stay."""
    if min(v.shape) < 8:
        return levels(v)
    return nearest(np.clip(v / np.maximum(mean_map(v), MIN_LOCAL) * 255, 0, 255))


def stretch(v: np.ndarray) -> np.ndarray:
    """Levels spread between the clipped ends of the histogram; almost flat images stay."""
    counts = np.bincount(levels(v).astype(int).ravel(), minlength=256)
    clip = math.floor(v.size * CLIP_SHARE)
    low = int(np.argmax(counts.cumsum() > clip))
    high = 255 - int(np.argmax(counts[::-1].cumsum() > clip))
    if high - low < MIN_RANGE:
        return levels(v)
    return nearest(np.clip((v * 255 - low) * (255.0 / (high - low)), 0, 255))


def median3(v: np.ndarray) -> np.ndarray:
    """Median of the clipped 3 x 3 window, the upper one of an even number; tiny images stay."""
    x = levels(v)
    if min(v.shape) < 3:
        return x
    h, w = x.shape
    wide = np.full((h + 2, w + 2), np.inf)
    wide[1:-1, 1:-1] = x
    stack = np.sort(np.stack([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]), axis=0)
    known = np.isfinite(stack).sum(axis=0)
    return np.take_along_axis(stack, (known // 2)[None], axis=0)[0]


def threshold(v: np.ndarray) -> np.ndarray:
    """Black where clearly darker than the neighbourhood, else white; small images stay."""
    return levels(v) if min(v.shape) < 8 else np.where(v < mean_map(v) * DARK_BIAS, 0.0, 255.0)


def handwriting(v: np.ndarray) -> np.ndarray:
    """Light flattened, then contrast stretched."""
    return stretch(flatten_light(v) / 255)


def binary(v: np.ndarray, enhanced: bool = False) -> np.ndarray:
    """Noise removed, then thresholded, behind the handwriting profile unless that was done."""
    return threshold(median3(v if enhanced else handwriting(v) / 255) / 255)


def otsu(v: np.ndarray) -> float:
    """Last level of the dark class over 255, for the largest variance between classes."""
    counts = np.bincount(levels(v).astype(int).ravel(), minlength=256).astype(float)
    dark = counts.cumsum()
    light = v.size - dark
    weighted = (np.arange(256) * counts).cumsum()
    use = (dark > 0) & (light > 0)
    if not use.any():
        return 127 / 255
    between = np.full(256, -1.0)
    a, b = weighted[use] / dark[use], (weighted[-1] - weighted[use]) / light[use]
    between[use] = dark[use] * light[use] * (a - b) * (a - b)
    return (int(between.argmax()) if between.max() > 0 else 127) / 255


def skew(v: np.ndarray, width: int = SKEW_WIDTH) -> float:
    """Tilt of text lines in degrees: the angle whose row profile is sharpest, the first of equals."""
    v = thin(v, width)
    h, w = v.shape
    if min(h, w) < 8:
        return 0.0
    y, x = np.nonzero(v < v.sum() / v.size * SKEW_DARK)
    if len(x) < SKEW_PIXELS:
        return 0.0
    best, top = 0.0, -1.0
    for k in range(int(SKEW_MAX / SKEW_STEP) * 2 + 1):
        angle = -SKEW_MAX + k * SKEW_STEP
        rows = nearest(y - x * math.tan(angle * math.pi / 180)).astype(int)
        score = float((np.unique(rows, return_counts=True)[1] ** 2).sum())
        if score > top:
            best, top = angle, score
    return best


def _merged(places: np.ndarray) -> list[float]:
    """Neighbouring candidates as one line at their mean."""
    if not len(places):
        return []
    return [float(g.sum()) / len(g) for g in np.split(places, np.flatnonzero(np.diff(places) > LINE_MERGE) + 1)]


def _longest_runs(mask: np.ndarray) -> np.ndarray:
    """Longest run of marked pixels in each row."""
    run, best = np.zeros(len(mask), int), np.zeros(len(mask), int)
    for column in mask.T:
        run = np.where(column, run + 1, 0)
        best = np.maximum(best, run)
    return best


def ruling_lines(v: np.ndarray, box: tuple[float, float, float, float], width: int = LINE_WIDTH) -> tuple[list[float], list[float]]:
    """Horizontal and vertical ruling lines around a box (left, top, right, bottom)."""
    mx, my = (box[2] - box[0]) * LINE_MARGIN_X, (box[3] - box[1]) * LINE_MARGIN_Y
    left, top = max(0, math.floor(box[0] - mx)), max(0, math.floor(box[1] - my))
    right, bottom = min(v.shape[1], math.ceil(box[2] + mx)), min(v.shape[0], math.ceil(box[3] + my))
    if right - left < LINE_MIN or bottom - top < LINE_MIN:
        return [], []
    part = shrink(v[top:bottom, left:right], width)
    h, w = part.shape
    scale = w / (right - left)
    mask = part < local_mean(part, max(LINE_RADIUS, int(nearest(min(h, w) * MEAN_RATIO)))) * LINE_BIAS
    rows = _merged(np.flatnonzero(_longest_runs(mask) >= int(nearest(w * LINE_COVER))))
    cols = _merged(np.flatnonzero(_longest_runs(mask.T) >= int(nearest(h * LINE_COVER))))
    if len(rows) > LINE_MOST or len(cols) > LINE_MOST:
        return [], []
    return [top + y / scale for y in rows], [left + x / scale for x in cols]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the rows' runs of marked pixels, as places in rows one pixel wider than the mask,
    so that no run goes on in the next row."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int8)
    wide[:, :-1] = mask
    steps = np.diff(wide.ravel(), prepend=0)
    return np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)


def run_labels(starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For each run the first run of its 4-connected component: runs that overlap one of the row above take the
    lesser label, both ways, until no two of them differ."""
    low = np.searchsorted(ends, starts - width, side="right")
    n = np.maximum(np.searchsorted(starts, ends - width, side="left") - low, 0)
    below = np.repeat(np.arange(len(starts)), n)
    above = np.arange(n.sum()) + np.repeat(low - (n.cumsum() - n), n)
    label = np.arange(len(starts))
    while (label[above] != label[below]).any():
        least = np.minimum(label[above], label[below])
        np.minimum.at(label, label[above], least)
        np.minimum.at(label, label[below], least)
        while (label[label] != label).any():
            label = label[label]
    return label


def _met_first(mask: np.ndarray, start: tuple[int, int], sought: list[set[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Of each set of pixels (x, y) the one that a depth-first walk comes to first, the walk ending once all are known.
    Fixed by the rule for equal corners: of the neighbours put aside the newest goes first, put aside left, right, up, down."""
    w = mask.shape[1] + 2
    free = bytearray(np.pad(mask, 1).astype(np.uint8).tobytes())
    wanted: dict[int, list[int]] = {}
    for k, places in enumerate(sought):
        for x, y in places:
            wanted.setdefault((y + 1) * w + x + 1, []).append(k)
    met: dict[int, tuple[int, int]] = {}
    aside = [(start[1] + 1) * w + start[0] + 1]
    free[aside[0]] = 0
    while len(met) < len(sought):
        at = aside.pop()
        for k in wanted.get(at, ()):
            met.setdefault(k, (at % w - 1, at // w - 1))
        news = [to for to in (at - 1, at + 1, at - w, at + w) if free[to]]
        for to in news:
            free[to] = 0
        aside += news
    return [met[k] for k in range(len(sought))]


def largest_component(mask: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Pixels of the largest 4-connected component, the first of equals, and its corners: least and
    greatest x + y and x - y (top left, top right, bottom right, bottom left). An empty mask has 0 and none.
    Corners lie at ends of runs; only where several are equal the component is walked, until they are told apart."""
    starts, ends = runs(mask)
    if not len(starts):
        return 0, []
    width = mask.shape[1] + 1
    label = run_labels(starts, ends, width)
    sizes = np.bincount(label, ends - starts)
    own = label == sizes.argmax()
    y, left, right = starts[own] // width, starts[own] % width, ends[own] % width - 1
    sought = []
    for x, far in ((left, -left - y), (right, right - y), (right, right + y), (left, y - left)):
        best = far == far.max()
        sought.append(set(zip(x[best].tolist(), y[best].tolist(), strict=True)))
    if all(len(places) == 1 for places in sought):
        return int(sizes.max()), [min(places) for places in sought]
    return int(sizes.max()), _met_first(mask, (int(left[0]), int(y[0])), sought)


def document_quad(v: np.ndarray, width: int = QUAD_WIDTH) -> list[tuple[float, float]] | None:
    """Corners of the bright page, unless bright pixels or their largest component are too few or
    too many. Plausibility is a rule over columns (functions.geometry)."""
    scale = min(1.0, width / v.shape[1])
    v = shrink(v, width)
    if min(v.shape) < QUAD_MIN:
        return None
    bright = v > otsu(v)
    if not v.size * QUAD_SHARE_LOW <= bright.sum() <= v.size * QUAD_SHARE_HIGH:
        return None
    n, corners = largest_component(bright)
    return [(x / scale, y / scale) for x, y in corners] if n >= v.size * QUAD_SHARE_LOW else None


def bilinear(v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels; places outside count as the nearest border."""
    h, w = v.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(0, w - 2)), np.minimum(y.astype(int), max(0, h - 2))
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), x - x0, y - y0
    return (v[y0, x0] * (1 - fx) + v[y0, x1] * fx) * (1 - fy) + (v[y1, x0] * (1 - fx) + v[y1, x1] * fx) * fy


def warp(v: np.ndarray, corners: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The quadrilateral (clockwise from the top left) as an upright image: the perspective map that takes the image's corner
    pixels to its corners, undone by looking every pixel up. Corners of which three lie on a line have no such map: an error."""
    system, known = [], []
    for (u, t), (x, y) in zip([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], corners, strict=True):
        system += [[u, t, 1, 0, 0, 0, -u * x, -t * x], [0, 0, 0, u, t, 1, -u * y, -t * y]]
        known += [x, y]
    a = np.append(np.linalg.solve(np.array(system, float), known), 1.0).reshape(3, 3)
    t, u = np.mgrid[0:height, 0:width]
    x, y, z = np.tensordot(a, np.stack([u, t, np.ones_like(u)]), 1)
    return bilinear(v, x / z, y / z)


def untilt(v: np.ndarray, degrees: float) -> np.ndarray:
    """Turned so that rows which fall by an angle come level, on a canvas that holds all of it; what the image does not cover is white."""
    h, w = v.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    width, height = (math.ceil(a * c + b * abs(s) - 1e-9) for a, b in ((w, h), (h, w)))
    y, x = np.mgrid[0:height, 0:width]
    x, y = x - (width - 1) / 2, y - (height - 1) / 2
    x, y = (w - 1) / 2 + x * c - y * s, (h - 1) / 2 + x * s + y * c
    return np.where((x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1), bilinear(v, x, y), 1.0)


def upright(v: np.ndarray) -> np.ndarray:
    """Levels of the handwriting profile, turned where text lines are clearly tilted."""
    out = handwriting(v)
    tilt = skew(out / 255)
    return nearest(untilt(out / 255, tilt) * 255) if abs(tilt) >= SKEW_ROTATE else out


RASTER = "img_id bigint, w int, h int, px array<double>"
CORNERS = [f"{a}{k}" for k in range(4) for a in "xy"]


def _map(rasters: DataFrame, schema: str, row: Callable[[dict, np.ndarray], dict]) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names if n != "px"}
                out.append(r | row(r, batch.column("px")[k].values.to_numpy(zero_copy_only=False).reshape(r["h"], r["w"])))
            types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], types[f.split()[1]]) for n, f in zip(names, schema.split(", "), strict=True)], names)

    return shipped(rasters).mapInArrow(run, schema)


def filtered(rasters: DataFrame, step: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rasters with px replaced by a step's result (levels 0 to 255, or means)."""

    def row(r: dict, v: np.ndarray) -> dict:
        out = step(v)
        return {"px": out.ravel(), "w": out.shape[1], "h": out.shape[0]}

    return _map(rasters, RASTER, row)


def measured(rasters: DataFrame, name: str, measure: Callable[[np.ndarray], float]) -> DataFrame:
    """img_id and one number per raster."""
    return _map(rasters, f"img_id bigint, {name} double", lambda r, v: {name: float(measure(v))})


def lines(rasters: DataFrame) -> DataFrame:
    """Ruling lines of rasters that carry the box x0, y0, x1, y1 of their words."""

    def row(r: dict, v: np.ndarray) -> dict:
        h, x = ruling_lines(v, (r["x0"], r["y0"], r["x1"], r["y1"]))
        return {"horizontal": h, "vertical": x}

    return _map(rasters, "img_id bigint, horizontal array<double>, vertical array<double>", row)


def quads(rasters: DataFrame) -> DataFrame:
    """Corners x0, y0 (top left) to x3, y3 (bottom left), clockwise, of rasters with a page; others go."""
    return _cornered(rasters, "img_id bigint, w int, h int").where("x0 is not null")


def _cornered(rasters: DataFrame, schema: str) -> DataFrame:
    def row(r: dict, v: np.ndarray) -> dict:
        corners = document_quad(v)
        return dict(zip(CORNERS, [float(c) for xy in corners for c in xy] if corners else [None] * 8, strict=True)) | {"px": v.ravel()}

    return _map(rasters, ", ".join([schema, *(f"{c} double" for c in CORNERS)]), row)


def bright_components(rasters: DataFrame) -> DataFrame:
    """img_id, pixels n and corners x0, y0 to x3, y3 of the largest bright component; none: 0 and null corners."""

    def row(r: dict, v: np.ndarray) -> dict:
        n, corners = largest_component(v > otsu(v))
        return {"n": n} | dict(zip(CORNERS, [float(c) for xy in corners for c in xy] or [None] * 8, strict=True))

    return _map(rasters, ", ".join(["img_id bigint, n bigint", *(f"{c} double" for c in CORNERS)]), row)


def warped(rasters: DataFrame) -> DataFrame:
    """Rasters that carry corners x0 to y3 and a target_width and target_height, warped to that size; without a target they stay."""

    def row(r: dict, v: np.ndarray) -> dict:
        if r["target_width"] is not None:
            v = warp(v, [(r[f"x{k}"], r[f"y{k}"]) for k in range(4)], r["target_width"], r["target_height"])
        return {"px": v.ravel(), "w": v.shape[1], "h": v.shape[0]}

    return _map(rasters, RASTER, row)


def rectified(rasters: DataFrame) -> DataFrame:
    """Rasters with a plausible page that does not fill them anyway cut to it and straightened; others stay. No shuffle."""
    quad = Quad(*[(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(4)])
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    sure = quad.plausible(w, h) & ~quad.nearly_full(w, h)
    sizes = dict(zip(("target_width", "target_height"), (F.when(sure, size) for size in quad.target_size(w, h)), strict=True))
    return warped(_cornered(rasters, RASTER).withColumns(sizes))


def handwriting_pages(rasters: DataFrame) -> DataFrame:
    """The handwriting profile whole: rectified, light flattened, contrast stretched, turned level (levels 0 to 255)."""
    return filtered(rectified(rasters), upright)
