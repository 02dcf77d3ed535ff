"""Page relations: ordered rows (doc_id, page_no from 1, ...), and the operators on them.

Order is the column page_no. Each operator works on all documents at once, keyed by doc_id; those that change the
order give page_no anew from one window over (doc_id), so a chain costs one exchange by doc_id. Operators that need a
pass over both sides use equi-joins on (doc_id, page_no).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.numbers import quarter_turns

#: A4 and US Letter in points, and the gap between the pages of a sheet.
A4 = (595.28, 841.89)
LETTER = (612.0, 792.0)
GUTTER = 12.0
STAMP_MARGIN = 24.0
STAMP_WIDTH_PERCENT = 20.0
MAX_BLANKS = 100


def page_count() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("doc_id"))


def renumber(pages: DataFrame, *order) -> DataFrame:
    """page_no from 1 in the given order."""
    return pages.withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def labels(pages: DataFrame, template: str = "n / N") -> DataFrame:
    """Adds ``label``: the template with every N replaced by the number of pages, then every n by the page's."""
    total = page_count().cast("string")
    return pages.withColumn("label", F.replace(F.replace(F.lit(template), F.lit("N"), total), F.lit("n"), F.col("page_no").cast("string")))


def merge(parts: list[DataFrame]) -> DataFrame:
    """All pages of all parts, in order of the parts, as documents of the same doc_id."""
    tagged = [p.withColumn("__part", F.lit(k)) for k, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    return renumber(rows.withColumn("source_page", F.col("page_no")), "__part", "source_page").withColumnRenamed("__part", "source_part")


def pick(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages in the order of an expression, with repeats. wanted: (doc_id, pages), an expression per document."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("__n"))
    rows = wanted.join(counts, "doc_id").select("doc_id", F.posexplode(ranges.expand_strict(F.col("pages"), F.col("__n"))).alias("__at", "page_no"))
    return rows.join(pages, ["doc_id", "page_no"]).withColumnRenamed("page_no", "source_page").withColumn("page_no", F.col("__at") + 1).drop("__at")


def reorder(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """pick() by expressions that name every page once; anything else is an error."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("__n"))
    checked = wanted.join(counts, "doc_id").withColumn("__p", ranges.expand(F.col("pages"), F.col("__n")))
    whole = (F.size("__p") == F.col("__n")) & (F.size(F.array_distinct("__p")) == F.col("__n"))
    return pick(pages, checked.select("doc_id", F.when(whole, F.col("pages")).otherwise(F.raise_error(F.lit("an order must name every page once"))).alias("pages")))


def remove(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages not in gone (doc_id, page_no). Documents that would lose all their pages are an error."""
    marked = pages.join(gone.select("doc_id", "page_no", F.lit(True).alias("__gone")).distinct(), ["doc_id", "page_no"], "left")
    stays = F.col("__gone").isNull()
    some = F.max(stays).over(Window.partitionBy("doc_id"))
    left = marked.withColumn("__stays", F.when(some, stays).otherwise(F.raise_error(F.lit("cannot remove all pages"))))
    return renumber(left.filter("__stays").drop("__gone", "__stays").withColumn("source_page", F.col("page_no")), "source_page")


def interleave(a: DataFrame, b: DataFrame, reverse: bool = False) -> DataFrame:
    """a1 b1 a2 b2 ..., what is left over in its place; b from its end if reverse."""
    rank = page_count() + 1 - F.col("page_no") if reverse else F.col("page_no")
    rows = a.select("*", F.lit("a").alias("side"), F.col("page_no").alias("__rank")).unionByName(b.select("*", F.lit("b").alias("side"), rank.alias("__rank")))
    return renumber(rows.withColumn("source_page", F.col("page_no")), "__rank", "side").drop("__rank")


def insert_blank(pages: DataFrame, after: int, count: int = 1) -> DataFrame:
    """count empty pages after page ``after`` (0: in front), of the size of the page before, or else the first.

    Documents of fewer than ``after`` pages are an error.
    """
    if not 1 <= count <= MAX_BLANKS or after < 0:
        raise ValueError("count must be between 1 and 100, and after not negative")
    like = max(after, 1)
    kept = {"doc_id", "width", "height"}
    blanks = pages.filter(F.col("page_no") == like).select(*[F.col(c) if c in kept else F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in pages.columns if c != "page_no"], F.lit(after).alias("page_no"), F.lit(True).alias("blank"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("__k"))
    rows = pages.withColumns({"blank": F.lit(False), "__k": F.lit(0)}).unionByName(blanks)
    last = F.max(F.when(~F.col("blank"), F.col("page_no"))).over(Window.partitionBy("doc_id"))
    checked = rows.withColumn("__at", F.when(last >= after, F.col("page_no")).otherwise(F.raise_error(F.lit("blank pages go after a page of the document"))))
    return renumber(checked, "__at", "__k").drop("__at", "__k")


def rotate(pages: DataFrame, by: int, selected: Column | None = None) -> DataFrame:
    if by % 90:
        raise ValueError("pages turn by quarters")
    turned = quarter_turns(F.col("rotate") + by)
    return pages.withColumn("rotate", turned if selected is None else F.when(selected, turned).otherwise(F.col("rotate")))


def rect(box: Column) -> tuple[Column, Column, Column, Column]:
    """Corners of a box of four numbers in any order; null if it isn't one."""
    ok = F.size(box) == 4
    at = lambda k: F.when(ok, F.element_at(box, k + 1))
    return F.least(at(0), at(2)), F.least(at(1), at(3)), F.greatest(at(0), at(2)), F.greatest(at(1), at(3))


def page_rect(*boxes: str) -> list[Column]:
    """The first of the boxes that is one, else US Letter."""
    found = [rect(F.col(b)) for b in boxes]
    return [F.coalesce(*[r[k] for r in found], F.lit((0.0, 0.0, *LETTER)[k])) for k in range(4)]


def crop(pages: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """crop_box cut by margins, from the crop box or else the media box; margins beyond the page are an error."""
    x0, y0, x1, y1 = page_rect("crop_box", "media_box")
    box = F.array(x0 + left, y0 + bottom, x1 - right, y1 - top)
    return pages.withColumn("crop_box", F.when((box[0] < box[2]) & (box[1] < box[3]), box).otherwise(F.raise_error(F.lit("crop margins exceed page size"))))


def resize(pages: DataFrame, width: float, height: float) -> DataFrame:
    """Adds scale, shift_x and shift_y that fit the page into width x height, centred; that is the new media box."""
    x0, y0, x1, y1 = page_rect("crop_box", "media_box")
    w, h = x1 - x0, y1 - y0
    s = F.least(width / w, height / h)
    placed = pages.withColumns({"scale": s, "shift_x": (width - s * w) / 2 - s * x0, "shift_y": (height - s * h) / 2 - s * y0})
    return placed.withColumns({"media_box": F.array(F.lit(0.0), F.lit(0.0), F.lit(float(width)), F.lit(float(height))), "crop_box": F.lit(None).cast("array<double>")})


def n_up(pages: DataFrame, per: int) -> DataFrame:
    """Adds sheet (from 1), slot (from 0), scale and place of each page on A4 sheets of 2 or 4."""
    if per not in (2, 4):
        raise ValueError("2 or 4 pages a sheet")
    sheet_w, sheet_h = (A4[1], A4[0]) if per == 2 else A4
    cols, rows = (2, 1) if per == 2 else (2, 2)
    cell_w, cell_h = (sheet_w - (cols + 1) * GUTTER) / cols, (sheet_h - (rows + 1) * GUTTER) / rows
    x0, y0, x1, y1 = page_rect("crop_box", "media_box")
    slot = F.pmod(F.col("page_no") - 1, F.lit(per))
    col, row = F.pmod(slot, F.lit(cols)), F.floor(slot / cols)
    sideways = F.col("rotate").isin(90, 270)
    w, h = F.when(sideways, y1 - y0).otherwise(x1 - x0), F.when(sideways, x1 - x0).otherwise(y1 - y0)
    s = F.least(cell_w / w, cell_h / h)
    upright = F.col("rotate") == 0
    x = GUTTER + col * (cell_w + GUTTER) + (cell_w - s * w) / 2 - F.when(upright, s * x0).otherwise(0.0)
    y = sheet_h - GUTTER - (row + 1) * cell_h - row * GUTTER + (cell_h - s * h) / 2 - F.when(upright, s * y0).otherwise(0.0)
    return pages.withColumns({"sheet": F.floor((F.col("page_no") - 1) / per) + 1, "slot": slot, "scale": s, "place_x": x, "place_y": y})


def anchor(position: Column, box: tuple, draw_w: Column, draw_h: Column, margin: float = STAMP_MARGIN) -> tuple[Column, Column]:
    """Lower left corner of a stamp at one of nine places (``top-left`` ... ``bottom-right``, the default)."""
    x0, y0, x1, y1 = box
    x = F.when(position.endswith("left"), x0 + margin).when(position.endswith("center"), (x0 + x1) / 2 - draw_w / 2).otherwise(x1 - margin - draw_w)
    y = F.when(position.startswith("top"), y1 - margin - draw_h).when(position.startswith("middle") | (position == "center"), (y0 + y1) / 2 - draw_h / 2).otherwise(y0 + margin)
    return x, y


def place_image(width: Column, height: Column, orientation: Column, fit: Column, page: tuple[float, float] = A4, margin: float = 0.0) -> Column:
    """Page and drawn size of an image on a fixed page: fit, fill, stretch or original; the page turns with the image.

    orientation is that of EXIF: 6 and 8 swap width and height.
    """
    swap = orientation.isin(5, 6, 7, 8)
    w, h = F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)
    short, long_ = min(page), max(page)
    page_w, page_h = F.when(w > h, long_).otherwise(short), F.when(w > h, short).otherwise(long_)
    in_w, in_h = page_w - 2 * margin, page_h - 2 * margin
    s = F.when(fit == "fit", F.least(in_w / w, in_h / h)).when(fit == "fill", F.greatest(in_w / w, in_h / h)).otherwise(1.0)
    draw_w, draw_h = F.when(fit == "stretch", in_w).otherwise(w * s), F.when(fit == "stretch", in_h).otherwise(h * s)
    return F.struct(page_w.alias("page_w"), page_h.alias("page_h"), draw_w.alias("draw_w"), draw_h.alias("draw_h"), (margin + (in_w - draw_w) / 2).alias("x"), (margin + (in_h - draw_h) / 2).alias("y"))


def choose_appearance(names: Column, state: Column) -> Column:
    """The named state if there is one, else the first name in order that isn't Off; null if none is left."""
    rest = F.array_min(F.filter(names, lambda k: k != "Off"))
    return F.when(F.array_contains(names, state), state).otherwise(rest)


def visual_point(x: Column, y: Column, box: tuple, rotate: Column) -> tuple[Column, Column]:
    """A point as seen on the turned page, in the page's own coordinates."""
    x0, y0, x1, y1 = box
    ux = F.when(rotate == 90, x1 - y).when(rotate == 180, x1 - x).when(rotate == 270, x0 + y).otherwise(x0 + x)
    uy = F.when(rotate == 90, y0 + x).when(rotate == 180, y1 - y).when(rotate == 270, y1 - x).otherwise(y0 + y)
    return ux, uy


def compact(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): the pages of each document as ranges, ascending, without repeats."""
    runs = pages.select("doc_id", "page_no").distinct().withColumn("__g", F.col("page_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))).groupBy("doc_id", "__g").agg(F.min("page_no").alias("a"), F.max("page_no").alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", part.alias("t")))).alias("x")).select("doc_id", F.array_join(F.col("x.t"), ",").alias("pages"))


def split_every(pages: DataFrame, size: int) -> DataFrame:
    """Adds segment: runs of ``size`` pages, the last may be shorter."""
    return pages.withColumn("segment", F.ceil(F.col("page_no") / size))


def split_at(pages: DataFrame, starts: Column) -> DataFrame:
    """Adds segment: a page where ``starts`` holds begins one; the first page always does."""
    begin = (F.coalesce(starts, F.lit(False)) | (F.col("page_no") == 1)).cast("int")
    return pages.withColumn("segment", F.sum(begin).over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)))


def facts(pages: DataFrame) -> DataFrame:
    """A row per document: pages, and the sizes of its pages in order."""
    size = F.struct("page_no", F.col("width").alias("w"), F.col("height").alias("h"), "rotate")
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(size)).alias("page_sizes"))
