import pytest
from pyspark.sql import functions as F

from foliospark.functions import numbers, ranges
from foliospark.operators import pages as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "n", "want"), [("1-3,5", 10, [1, 2, 3, 5]), ("2-", 4, [2, 3, 4]), ("3,1,3", 3, [3, 1, 3]), (" 2 - 3 ,, 1", 3, [2, 3, 1]), ("0", 10, None), ("abc", 10, None), ("5-2", 10, None), ("", 10, None), ("1-11", 10, None), ("1-2-3", 10, None), ("-3", 10, None)])
def test_range_expressions(spark, text, n, want):
    assert one(spark, ranges.expand(F.lit(text), F.lit(n))) == want


def test_strict_ranges_and_sets(spark):
    with pytest.raises(Exception, match="bad page range"):
        one(spark, ranges.expand_strict(F.lit("9"), F.lit(3)))
    assert one(spark, ranges.select(F.lit(""), F.lit(3))) == [1, 2, 3] == one(spark, ranges.select(F.lit("All"), F.lit(3)))
    assert one(spark, ranges.select(F.lit("3,1,3"), F.lit(3))) == [1, 3] and one(spark, ranges.select(F.lit(" LAST "), F.lit(3))) == [3]


@pytest.fixture(scope="module")
def book(spark):
    rows = [(d, p, f"d{d}p{p}", 612.0, 792.0, [0.0, 0.0, 612.0, 792.0], None, 90 * (p % 4)) for d, n in ((1, 5), (2, 3)) for p in range(1, n + 1)]
    return spark.createDataFrame(rows, "doc_id long, page_no int, text string, width double, height double, media_box array<double>, crop_box array<double>, rotate int")


def texts(df, doc=1):
    return [r.text for r in sorted(df.filter(F.col("doc_id") == doc).collect(), key=lambda r: r.page_no)]


def test_splits_of_a_merge_give_its_parts(spark, book):
    merged = P.merge([book, book.filter("page_no < 3")])
    assert texts(merged) == [f"d1p{k}" for k in (1, 2, 3, 4, 5, 1, 2)]
    want = spark.createDataFrame([(1, "6-"), (2, "1-3")], "doc_id long, pages string")
    assert texts(P.pick(merged, want)) == ["d1p1", "d1p2"] and texts(P.pick(merged, want), 2) == ["d2p1", "d2p2", "d2p3"]


def test_reorder_and_its_inverse(spark, book):
    there = spark.createDataFrame([(1, "3,1,5,2,4")], "doc_id long, pages string")
    back = spark.createDataFrame([(1, "2,4,1,5,3")], "doc_id long, pages string")
    moved = P.reorder(book, there)
    assert texts(moved) == ["d1p3", "d1p1", "d1p5", "d1p2", "d1p4"]
    assert texts(P.reorder(moved.drop("source_page"), back)) == [f"d1p{k}" for k in range(1, 6)]
    with pytest.raises(Exception, match="every page once"):
        P.reorder(book, spark.createDataFrame([(1, "1-4,4")], "doc_id long, pages string")).collect()


def test_removed_and_picked_pages_are_all(spark, book):
    gone = spark.createDataFrame([(1, 2), (1, 4)], "doc_id long, page_no int")
    assert texts(P.remove(book, gone)) == ["d1p1", "d1p3", "d1p5"]
    assert P.compact(gone).collect()[0].pages == "2,4" and P.compact(book).filter("doc_id = 1").first().pages == "1-5"


def test_interleave_and_blank(book):
    a, b = book.filter("doc_id = 1"), book.filter("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long"))
    assert texts(P.interleave(a, b)) == ["d1p1", "d2p1", "d1p2", "d2p2", "d1p3", "d2p3", "d1p4", "d1p5"]
    assert texts(P.interleave(a, b, reverse=True))[:4] == ["d1p1", "d2p3", "d1p2", "d2p2"]
    assert texts(P.insert_blank(a, 1, 2)) == ["d1p1", None, None, "d1p2", "d1p3", "d1p4", "d1p5"]
    assert texts(P.insert_blank(a, 0))[0] is None and texts(P.insert_blank(a, 5))[5] is None
    with pytest.raises(ValueError, match="between 1 and 100"):
        P.insert_blank(a, 1, 101)


def test_geometry(spark, book):
    assert {r.rotate for r in P.rotate(book, -90).filter("page_no = 1").collect()} == {0}
    box = P.crop(book, 10, 20, 30, 40).first().crop_box
    assert box == [10, 20, 582, 752]
    with pytest.raises(Exception, match="crop margins"):
        P.crop(book, 400, 0, 300, 0).collect()
    r = P.resize(book, 306, 792).first()
    assert (r.scale, r.shift_x, r.shift_y) == (0.5, 0, 198) and r.crop_box is None
    assert [x.sheet for x in sorted(P.n_up(book.filter("doc_id = 1"), 2).collect(), key=lambda x: x.page_no)] == [1, 1, 2, 2, 3]
    assert one(spark, F.array(*P.rect(F.array(*[F.lit(float(v)) for v in (5, 9, 1, 2)])))) == [1, 2, 5, 9]


def test_labels_and_numbers(spark, book):
    assert P.labels(book, "n of N").filter("doc_id = 2 and page_no = 3").first().label == "3 of 3"
    assert [one(spark, numbers.round2(F.lit(x))) for x in (1.005, -1.005, 2.675, 0.125, -0.125)] == [1.0, -1.0, 2.68, 0.13, -0.13]
    for n in (1, 26, 27, 52, 702, 703, 16384, 18278):
        assert one(spark, numbers.column_number(numbers.column_letters(F.lit(n)))) == n
    assert one(spark, numbers.column_letters(F.lit(16384))) == "XFD"


def test_all_pages_gone_and_blanks_beyond_the_end_are_errors(spark):
    pages = spark.createDataFrame([(1, 1, 10.0, 20.0), (1, 2, 30.0, 40.0), (2, 1, 50.0, 60.0)], "doc_id long, page_no int, width double, height double")
    gone = spark.createDataFrame([(1, 1), (1, 1), (2, 5)], "doc_id long, page_no int")
    assert sorted((r.doc_id, r.page_no, r.source_page) for r in P.remove(pages, gone).collect()) == [(1, 1, 2), (2, 1, 1)]
    with pytest.raises(Exception, match="cannot remove all pages"):
        P.remove(pages, spark.createDataFrame([(2, 1)], "doc_id long, page_no int")).collect()
    assert sorted((r.doc_id, r.page_no, r.blank) for r in P.insert_blank(pages, 1).collect()) == [(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False), (2, 2, True)]
    with pytest.raises(Exception, match="after a page"):
        P.insert_blank(pages, 2).collect()
