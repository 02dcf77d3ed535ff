"""Page alignment by fingerprints, and pixel differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 0.75
MAX_CELLS = 1_000_000
PAIRS = "pair_id long, seq long, a_ord long, b_ord long"


def fingerprint_distance(a: Column, b: Column) -> Column:
    """Mean of min(1, difference / 255); 1 for different lengths."""
    parts = F.zip_with(a, b, lambda x, y: F.least(F.abs(x - y) / 255.0, F.lit(1.0)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(1.0)


def page_distance(a: str, b: str) -> Column:
    """Of two page structs (fingerprint, text_fp, width, height): the above, half more for each of other text (null
    says nothing) and other size."""
    c = lambda s, f: F.col(f"{s}.{f}")
    text = F.when(c(a, "text_fp").isNotNull() & c(b, "text_fp").isNotNull() & (c(a, "text_fp") != c(b, "text_fp")), 0.5).otherwise(0.0)
    size = F.when((F.abs(c(a, "width") - c(b, "width")) > 0.01) | (F.abs(c(a, "height") - c(b, "height")) > 0.01), 0.5).otherwise(0.0)
    return fingerprint_distance(c(a, "fingerprint"), c(b, "fingerprint")) + text + size


def align_costs(cost: np.ndarray, gap: float = GAP) -> list[tuple[int | None, int | None]]:
    """Cheapest global alignment; of equal choices a match goes before a removal, and that before an insertion."""
    n, m = cost.shape
    best = np.zeros((n + 1, m + 1))
    best[n, :] = gap * np.arange(m, -1, -1)
    best[:, m] = gap * np.arange(n, -1, -1)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = min(cost[i, j] + best[i + 1, j + 1], gap + best[i + 1, j], gap + best[i, j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and best[i, j] == cost[i, j] + best[i + 1, j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i, j] == gap + best[i + 1, j]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def distances(a: list, b: list) -> np.ndarray:
    """All page distances of two sides; pages are (fingerprint, text_fp, width, height)."""
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            f, g = np.asarray(x["fingerprint"], float), np.asarray(y["fingerprint"], float)
            d = float(np.minimum(np.abs(f - g) / 255, 1).mean()) if len(f) == len(g) and len(f) else 1.0
            if x["text_fp"] is not None and y["text_fp"] is not None and x["text_fp"] != y["text_fp"]:
                d += 0.5
            if abs(x["width"] - y["width"]) > 0.01 or abs(x["height"] - y["height"]) > 0.01:
                d += 0.5
            out[i, j] = d
    return out


def align(pairs: DataFrame, max_cells: int = MAX_CELLS, gap: float = GAP) -> DataFrame:
    """pairs(pair_id, a, b: arrays of page structs in order) to matched places; pairs of too many cells by place."""
    cells = (F.size("a").cast("long") + 1) * (F.size("b") + 1)

    def run(batches):
        for pdf in batches:
            rows = []
            for p, a, b in zip(pdf["pair_id"], pdf["a"], pdf["b"], strict=True):
                rows += [(p, k, i, j) for k, (i, j) in enumerate(align_costs(distances(list(a), list(b)), gap))]
            out = pd.DataFrame(rows, columns=["pair_id", "seq", "a_ord", "b_ord"])
            yield out.astype({"a_ord": "Int64", "b_ord": "Int64"})

    large = pairs.filter(cells > max_cells)
    n, m = F.size("a"), F.size("b")
    by_place = large.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(n, m) - 1))).select("pair_id", F.col("k").cast("long").alias("seq"), F.when(F.col("k") < n, F.col("k")).cast("long").alias("a_ord"), F.when(F.col("k") < m, F.col("k")).cast("long").alias("b_ord"))
    return pairs.filter(cells <= max_cells).mapInPandas(run, PAIRS).unionByName(by_place)


def _on_slope(image: np.ndarray, contrast: float) -> np.ndarray:
    """Pixels with a darker and a lighter neighbour, both by more than the contrast: those of a smoothed edge."""
    light = image[..., :3] @ np.array([0.299, 0.587, 0.114])
    h, w = light.shape
    around = np.pad(light, 1, constant_values=np.nan)
    near = np.stack([around[y : y + h, x : x + w] for y in range(3) for x in range(3) if (y, x) != (1, 1)])
    return (near < light - contrast).any(0) & (near > light + contrast).any(0)


def _covered(extent: tuple[float, float] | None, h: int, w: int) -> np.ndarray:
    """The share of each pixel that a page of this width and height covers."""
    width, height = extent or (w, h)
    return np.outer(np.clip(height - np.arange(h), 0, 1), np.clip(width - np.arange(w), 0, 1))


def changed_pixels(a: np.ndarray, b: np.ndarray, threshold: float = 0, tolerance: float = 0, extents: tuple = (None, None)) -> np.ndarray:
    """Changed pixels of two RGBA images (height, width, 4) over the union of both.

    A pixel changes if a channel differs by more than the threshold, unless it differs by no more than the tolerance
    and lies on an edge's slope in either image. What one image alone covers, or the extents (width, height of the
    pages inside their images) cover differently, is changed.
    """
    if not (0 <= threshold <= 255 and 0 <= tolerance <= 255):
        raise ValueError("threshold and tolerance are 0 to 255")
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    changed = np.ones((h, w), bool)
    y, x = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    gap = np.abs(a[:y, :x].astype(int) - b[:y, :x]).max(2, initial=0)
    differs = gap > threshold
    if tolerance:
        contrast = max(1, threshold)
        differs &= ~((gap <= tolerance) & (_on_slope(a, contrast)[:y, :x] | _on_slope(b, contrast)[:y, :x]))
    shares = [_covered(e, *image.shape[:2])[:y, :x] for e, image in zip(extents, (a, b), strict=True)]
    changed[:y, :x] = differs | (np.abs(shares[0] - shares[1]) > 1e-9)
    return changed


def pixel_diff(a: np.ndarray, b: np.ndarray, threshold: float = 16, **more) -> tuple[int, tuple[int, int, int, int] | None]:
    """The number of changed_pixels and their bounds (x0, y0, x1, y1)."""
    at = np.argwhere(changed_pixels(a, b, threshold, **more))
    return len(at), (int(at[:, 1].min()), int(at[:, 0].min()), int(at[:, 1].max()) + 1, int(at[:, 0].max()) + 1) if len(at) else None


def heatmap(changed: np.ndarray) -> np.ndarray:
    """Changed pixels in opaque red, all else transparent."""
    return changed[..., None] * np.array([255, 0, 0, 255], np.uint8)


def gray_fingerprint(image: np.ndarray, size: int = 8) -> list[int]:
    """Mean brightness of size x size cells of an RGBA image over white."""
    alpha = image[..., 3:].astype(float) / 255
    over = image[..., :3] * alpha + 255 * (1 - alpha)
    gray = over @ np.array([0.299, 0.587, 0.114])
    rows = np.array_split(np.arange(gray.shape[0]), size) if gray.shape[0] >= size else [[min(k * gray.shape[0] // size, gray.shape[0] - 1)] for k in range(size)]
    cols = np.array_split(np.arange(gray.shape[1]), size) if gray.shape[1] >= size else [[min(k * gray.shape[1] // size, gray.shape[1] - 1)] for k in range(size)]
    return [int(gray[np.ix_(r, c)].mean() + 0.5) for r in rows for c in cols]


def box_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (height, width, channels) of bytes at another size: each pixel is the whole-number mean of its block."""
    for axis, new in ((0, height), (1, width)):
        if new < 1 or image.shape[axis] < 1:
            raise ValueError("images have at least one pixel")
    sums, cells = image.astype(np.int64), 1
    for axis, new in ((0, height), (1, width)):
        old = image.shape[axis]
        low = np.arange(new) * old // new
        high = np.minimum(np.maximum(np.arange(1, new + 1) * old // new, low + 1), old)
        running = np.insert(np.cumsum(sums, axis), 0, 0, axis)
        sums = running.take(high, axis) - running.take(low, axis)
        cells = np.multiply.outer(cells, high - low)
    return (sums // cells[..., None]).astype(np.uint8)
