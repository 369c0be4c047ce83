"""Sizes, quadrilaterals and small numeric rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page raster limits and quadrilateral rules.
DPI, LONGEST, SHORTEST, PAGE_W, PAGE_H = 200.0, 2400.0, 1400.0, 595.0, 842.0
QUAD_SIDE, QUAD_RATIO, QUAD_MIN_ASPECT, QUAD_MAX_ASPECT, QUAD_FILL, FULL_FRAME = 0.3, 2.0, 0.35, 3.0, 0.55, 0.02


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def whole(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(x).cast("bigint")


def page_render_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Raster size of a page given in points."""
    w = F.when(width <= 0, F.lit(PAGE_W)).otherwise(width)
    h = F.when(height <= 0, F.lit(PAGE_H)).otherwise(height)
    longest = F.greatest(w, h)
    scale = F.lit(DPI / 72.0)
    scale = F.when(longest * scale > LONGEST, F.lit(LONGEST) / longest).when(longest * scale < SHORTEST, F.lit(SHORTEST) / longest).otherwise(scale)
    return F.greatest(whole(w * scale), F.lit(1)), F.greatest(whole(h * scale), F.lit(1))


def progress(completed: Column, total: Column) -> tuple[Column, Column]:
    """Fraction in 0 to 1, and percent."""
    fraction = F.when(total <= 0, F.lit(0.0)).otherwise(clamp(completed / F.when(total > 0, total), 0.0, 1.0))
    return fraction, whole(fraction * 100)


def fitted_size(width: Column, height: Column, longest: float = 1754.0) -> tuple[Column, Column]:
    """An image's size within a longest side, never enlarged."""
    scale = F.when(F.greatest(width, height) > longest, F.lit(longest) / F.greatest(width, height)).otherwise(F.lit(1.0))
    return F.greatest(whole(width * scale), F.lit(1)), F.greatest(whole(height * scale), F.lit(1))


class Quad:
    """A quadrilateral of eight columns, corners clockwise from the top left."""

    def __init__(self, tl: tuple[Column, Column], tr: tuple[Column, Column], br: tuple[Column, Column], bl: tuple[Column, Column]) -> None:
        self.corners = tl, tr, br, bl
        self.tl, self.tr, self.br, self.bl = self.corners
        dist = lambda a, b: F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))
        self.top, self.bottom = dist(self.tl, self.tr), dist(self.bl, self.br)
        self.left, self.right = dist(self.tl, self.bl), dist(self.tr, self.br)
        self.width, self.height = (self.top + self.bottom) / 2, (self.left + self.right) / 2

    def area(self) -> Column:
        total = F.lit(0.0)
        for a, b in zip(self.corners, self.corners[1:] + self.corners[:1], strict=True):
            total = total + (a[0] * b[1] - b[0] * a[1])
        return F.abs(total) / 2

    def plausible(self, image_width: Column, image_height: Column) -> Column:
        """Long sides, similar opposite sides, a page's aspect, and most of the bounding box."""
        xs, ys = [c[0] for c in self.corners], [c[1] for c in self.corners]
        box_w, box_h = F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)
        ratio = lambda a, b: (a <= b * QUAD_RATIO) & (b <= a * QUAD_RATIO)
        aspect = self.width / F.greatest(self.height, F.lit(1.0))
        return (
            (self.top >= image_width * QUAD_SIDE) & (self.bottom >= image_width * QUAD_SIDE) & (self.left >= image_height * QUAD_SIDE) & (self.right >= image_height * QUAD_SIDE)
            & ratio(self.top, self.bottom) & ratio(self.left, self.right) & (aspect >= QUAD_MIN_ASPECT) & (aspect <= QUAD_MAX_ASPECT)
            & (box_w > 0) & (box_h > 0) & (self.area() >= box_w * box_h * QUAD_FILL)
        )

    def nearly_full(self, image_width: Column, image_height: Column) -> Column:
        slack = F.least(image_width, image_height) * FULL_FRAME
        near = lambda x, target: F.abs(x - target) <= slack
        right, low = image_width - 1, image_height - 1
        zero = F.lit(0.0)
        wanted = (zero, zero), (right, zero), (right, low), (zero, low)
        out = F.lit(True)
        for (x, y), (u, v) in zip(self.corners, wanted, strict=True):
            out = out & near(x, u) & near(y, v)
        return out

    def target_size(self, image_width: Column, image_height: Column) -> tuple[Column, Column]:
        """Size of the rectified image."""
        return F.least(F.greatest(whole(self.width), F.lit(32)), image_width.cast("bigint")), F.least(F.greatest(whole(self.height), F.lit(32)), image_height.cast("bigint"))
