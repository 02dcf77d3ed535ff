"""Sizes, boxes and selections as column expressions; what can't be drawn is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the widest margin around a selection, in pixels.
MAX_PADDING = 64


def _finite(*xs: Column) -> Column:
    good = F.lit(True)
    for x in xs:
        good = good & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return good


def unit_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box in pixels as shares of its image; null if it is empty, or not inside the image."""
    good = _finite(left, top, right, bottom, width, height) & (width > 0) & (height > 0) & (left >= 0) & (top >= 0) & (right <= width) & (bottom <= height) & (left < right) & (top < bottom)
    return F.when(good, F.struct(F.try_divide(left, width).alias("left"), F.try_divide(top, height).alias("top"), F.try_divide(right, width).alias("right"), F.try_divide(bottom, height).alias("bottom")))


def selection(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The rectangle between two corners, in any order, cut to the page, as shares of it; null without area."""
    within = lambda x, most: F.greatest(F.lit(0.0), F.least(most, x))
    good = _finite(x1, y1, x2, y2, width, height) & (width > 0) & (height > 0)
    left, right = within(F.least(x1, x2), width), within(F.greatest(x1, x2), width)
    top, bottom = within(F.least(y1, y2), height), within(F.greatest(y1, y2), height)
    return F.when(good, unit_box(left, top, right, bottom, width, height))


def selection_pixels(box: Column, width: Column, height: Column, padding: int = 0) -> Column:
    """Whole pixels that a selection touches, with a margin: struct(x, y, width, height)."""
    if not 0 <= padding <= MAX_PADDING:
        raise ValueError(f"padding is 0 to {MAX_PADDING}")
    low = lambda share, size: F.greatest(F.lit(0), F.floor(share * size) - padding)
    high = lambda share, size: F.least(size, F.ceil(share * size) + padding)
    x, y = low(box["left"], width), low(box["top"], height)
    return F.when(box.isNotNull(), F.struct(x.alias("x"), y.alias("y"), (high(box["right"], width) - x).alias("width"), (high(box["bottom"], height) - y).alias("height")))


def _pixels(width: Column, height: Column, scale: Column) -> tuple[Column, Column]:
    return tuple(F.greatest(F.lit(1), F.ceil(x * scale)) for x in (width, height))


def render_size(width: Column, height: Column, scale: float, max_pixels: int) -> Column:
    """Pixels of a page at a scale, or at the largest below it that keeps the budget: struct(width, height, scale).

    Sides are rounded up; where that breaks the budget, the scale shrinks once more. Null if that isn't enough."""
    first = F.least(F.lit(float(scale)), F.sqrt(F.try_divide(F.lit(float(max_pixels)), width * height)))
    w, h = _pixels(width, height, first)
    again = first * (F.sqrt(F.lit(float(max_pixels)) / (w * h)) * 0.999999)
    used = F.when(w * h > max_pixels, again).otherwise(first)
    w, h = _pixels(width, height, used)
    good = _finite(width, height) & (width > 0) & (height > 0) & (w * h <= max_pixels)
    return F.when(good, F.struct(w.alias("width"), h.alias("height"), used.alias("scale")))


def live_scale(w1: Column, h1: Column, w2: Column, h2: Column, scale: float, max_pixels: int, retained: int = 0) -> Column:
    """The scale at which both pages and two surfaces as large as their union keep within the live pixels."""
    if not 0 <= retained < max_pixels:
        raise ValueError("retained surfaces exceed the live pixels")
    area = (w1 * h1 + w2 * h2) * 2 + F.greatest(w1, w2) * F.greatest(h1, h2) * 2
    return F.when(_finite(w1, h1, w2, h2) & (F.least(w1, h1, w2, h2) > 0), F.least(F.lit(float(scale)), F.sqrt(F.try_divide(F.lit(float(max_pixels - retained)), area))))


def fit_size(width: Column, height: Column, max_width: int = 0, max_height: int = 0) -> Column:
    """The size of an image made to fit, never larger than it is; a bound of 0 is none: struct(width, height)."""
    scale = F.lit(1.0)
    for side, most in ((width, max_width), (height, max_height)):
        if most > 0:
            scale = F.least(scale, F.try_divide(F.lit(float(most)), side))
    side = lambda x: F.when(scale < 1, F.greatest(F.lit(1), F.floor(x * scale + 0.5))).otherwise(x)
    return F.when((width > 0) & (height > 0), F.struct(side(width).cast("long").alias("width"), side(height).cast("long").alias("height")))
