import numpy as np
from pyspark.sql import functions as F

from foliospark.functions import geometry, names, ranges
from foliospark.operators.align import box_resize


def test_boxes_that_cant_be_drawn_are_null(spark):
    rows = [(0.0, 0.0, 5.0, 5.0), (5.0, 0.0, 5.0, 5.0), (-1.0, 0.0, 5.0, 5.0), (0.0, 0.0, 11.0, 5.0), (0.0, float("nan"), 5.0, 5.0), (None, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "l double, t double, r double, b double")
    edges = [F.col(c) for c in "ltrb"]
    got = df.select(geometry.unit_box(*edges, F.lit(10.0), F.lit(20.0)).alias("u"), geometry.selection(*edges, F.lit(10.0), F.lit(20.0)).alias("s")).collect()
    assert [tuple(r.u) if r.u else None for r in got] == [(0.0, 0.0, 0.5, 0.25)] + [None] * 5
    assert [r.s is not None for r in got] == [True, False, True, True, False, False]


def test_scales_keep_the_budget(spark):
    df = spark.createDataFrame([(612.0, 792.0), (1.0, 1e9), (3000.0, 3000.0), (0.0, 5.0)], "w double, h double")
    got = [r.s for r in df.select(geometry.render_size(F.col("w"), F.col("h"), 2.0, 1_000_000).alias("s")).collect()]
    assert got[3] is None and all(s is None or s.width * s.height <= 1_000_000 for s in got) and got[0].scale < 2
    live = df.limit(1).select(geometry.live_scale(F.col("w"), F.col("h"), F.col("w"), F.col("h"), 4.0, 612 * 792 * 6).alias("k")).first().k
    assert live == 1.0
    fit = [r.s for r in df.select(geometry.fit_size(F.col("w"), F.col("h"), 300, 0).alias("s")).collect()]
    assert [s and tuple(s) for s in fit] == [(300, 388), (1, 10**9), (300, 300), None]


def test_names_of_a_transfer_are_distinct_and_fit(spark):
    long = "é" * 120 + ".json"
    got = names.distinct_names(["a.txt", "a.txt", "a (2).txt", "a.txt", ".rc", ".rc", long, long])
    assert got[:7] == ["a.txt", "a (2).txt", "a (2) (2).txt", "a (3).txt", ".rc", ".rc (2)", long]
    assert len(set(got)) == 8 and all(len(n.encode()) <= 255 for n in got)
    assert names.cut_bytes("aé", 2) == "a"
    files = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (2, 0, "a/b"), (3, 0, None)], "transfer long, file_no long, name string")
    assert {(r.transfer, r.file_no): r.safe_name for r in names.transfer_names(files).collect()} == {(1, 0): "x", (1, 1): "x (2)", (2, 0): None, (3, 0): None}


def test_page_states(spark):
    df = spark.range(1).select(F.array(*map(F.lit, (1, 2, 3))).alias("o"))
    moved = df.select(*[ranges.moved(F.col("o"), F.lit(p), F.lit(t)).alias(f"m{k}") for k, (p, t) in enumerate([(1, 2), (3, 0), (4, 0), (1, 3), (1, -1)])]).first()
    assert list(moved) == [[2, 3, 1], [3, 1, 2], [1, 2, 3], [1, 2, 3], [1, 2, 3]]
    pick = df.select(ranges.selected(F.col("o"), F.lit(5), F.lit(9)).alias("a"), ranges.selected(F.col("o"), F.lit(2), F.lit(9), False).alias("b"), ranges.selected(F.col("o"), F.lit(10), F.lit(9)).alias("c")).first()
    assert list(pick) == [[1, 2, 3, 5], [1, 3], [1, 2, 3]]


def test_numbers_and_units(spark):
    df = spark.createDataFrame([(1e21,), (0.1,), (5.0,), (None,), (1e-7,)], "x double")
    assert [r.s for r in df.select(names.shortest_number("x").alias("s")).collect()] == ["1000000000000000000000", "0.1", "5", None, "0.0000001"]
    data = spark.createDataFrame([(bytearray("a한😀".encode("utf-16-le")),)], "b binary")
    assert data.select(names.decode_utf16le(F.col("b")).alias("t")).first().t == "a한😀"
    assert names.lightest_shards({"a": 3.0, "b": 2.0, "c": 2.0, "d": 1.0}, 2) == [["a", "d"], ["b", "c"]]


def test_box_resize_is_the_mean_of_blocks():
    image = np.random.default_rng(1).integers(0, 256, (7, 10, 4), dtype=np.uint8)
    for width, height in ((10, 7), (3, 2), (1, 1), (4, 7), (12, 9)):
        got = box_resize(image, width, height)
        for y in range(height):
            for x in range(width):
                y0, x0 = y * 7 // height, x * 10 // width
                block = image[y0 : max((y + 1) * 7 // height, y0 + 1), x0 : max((x + 1) * 10 // width, x0 + 1)].reshape(-1, 4).astype(int)
                assert list(got[y, x]) == list(block.sum(0) // len(block))
