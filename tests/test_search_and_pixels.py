import numpy as np
import pytest

from foliospark.operators import search
from foliospark.operators.align import changed_pixels, heatmap, pixel_diff


def test_patterns_are_found_at_their_first_place(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x😀abcab", 0), (2, None, 0), (3, "", 0), (4, "cab", 0), (4, "cab", 0)], "doc_id long, text string, item_id int")
    patterns = spark.createDataFrame([("p", "ab"), ("q", "ab"), ("r", "cab"), ("s", ""), ("t", None), ("u", "zz")], "item_id string, pattern string")
    got = sorted(map(tuple, search.find_patterns(docs, patterns).collect()))
    assert got == sorted([(1, "p", 3), (1, "q", 3), (1, "r", 5), *[(4, "p", 2), (4, "q", 2), (4, "r", 1)] * 2])
    assert search.find_patterns(docs, patterns.limit(0)).count() == 0 == search.find_patterns(docs.limit(0), patterns).count()
    monkeypatch.setattr(search, "MAX_PATTERNS", 2)
    with pytest.raises(ValueError, match="at most 2"):
        search.find_patterns(docs, patterns)


def test_smoothed_edges_and_extents():
    def model(a, b, threshold, tolerance):
        def light(p):
            return p[0] * 0.299 + p[1] * 0.587 + p[2] * 0.114

        def slope(i, y, x):
            near = [light(i[v, u].astype(float)) for v in range(max(0, y - 1), min(len(i), y + 2)) for u in range(max(0, x - 1), min(len(i[0]), x + 2)) if (v, u) != (y, x)]
            here, least = light(i[y, x].astype(float)), max(1, threshold)
            return min(near) < here - least and max(near) > here + least

        gap = np.abs(a.astype(int) - b).max(2)
        return [[bool(gap[y, x] > threshold and not (tolerance and gap[y, x] <= tolerance and (slope(a, y, x) or slope(b, y, x)))) for x in range(a.shape[1])] for y in range(a.shape[0])]

    random = np.random.default_rng(3)
    a = random.integers(0, 256, (9, 7, 4), dtype=np.uint8)
    b = np.clip(a.astype(int) + random.integers(-40, 41, a.shape), 0, 255).astype(np.uint8)
    for threshold, tolerance in ((0, 0), (16, 0), (16, 32), (60, 255), (0, 255)):
        assert changed_pixels(a, b, threshold, tolerance).tolist() == model(a, b, threshold, tolerance)
    assert pixel_diff(a, a, extents=((7, 9), (6.5, 9))) == (9, (6, 0, 7, 9))
    red = heatmap(changed_pixels(a, a[:8]))
    assert red.dtype == np.uint8 and red[8].tolist() == [[255, 0, 0, 255]] * 7 and not red[:8].any()
