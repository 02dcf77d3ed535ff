"""Sparse spreadsheet cells to dense rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import column_number

MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384


def split_ref(ref: Column) -> Column:
    """row and col (1-based) of a reference such as AB12; null for anything else."""
    letters, digits = F.regexp_extract(ref, r"^([A-Z]+)([0-9]+)\z", 1), F.regexp_extract(ref, r"^([A-Z]+)([0-9]+)\z", 2)
    return F.when(letters != "", F.struct(F.try_to_number(digits, F.lit("9999999999")).cast("long").alias("row"), column_number(letters).alias("col")))


def cell_value(kind: Column, raw: Column, shared: Column) -> Column:
    """Text of a cell by its type; a shared string that isn't there is empty."""
    return F.when(kind == "s", F.coalesce(shared, F.lit(""))).when(kind == "b", F.when(raw == "1", "TRUE").otherwise("FALSE")).otherwise(F.coalesce(raw, F.lit("")))


def resolve(cells: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(book, sheet, ref, type, raw) and shared strings (book, idx, value) to (book, sheet, row, col, value)."""
    at = split_ref(F.col("ref"))
    rows = cells.withColumn("at", at).filter((F.col("at.row") <= MAX_ROWS) & (F.col("at.col") <= MAX_COLUMNS))
    if shared is None:
        value = cell_value(F.col("type"), F.col("raw"), F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("idx", F.when(F.col("type") == "s", F.try_to_number("raw", F.lit("999999999")).cast("long"))).join(shared.withColumnRenamed("value", "__shared"), ["book", "idx"], "left")
        value = cell_value(F.col("type"), F.col("raw"), F.col("__shared"))
    return rows.select("book", "sheet", F.col("at.row").alias("row"), F.col("at.col").alias("col"), value.alias("value"))


def grid(cells: DataFrame) -> DataFrame:
    """(book, sheet, row, values): every row up to the last, each as wide as its own last cell, gaps empty.

    A row's cells are put in place by expressions, so a row is never exploded into its gaps.
    """
    by_row = cells.groupBy("book", "sheet", "row").agg(F.max("col").alias("width"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("m"))
    filled = by_row.select("book", "sheet", "row", F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))).alias("values"))
    every = cells.groupBy("book", "sheet").agg(F.max("row").alias("n")).select("book", "sheet", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("row"))
    return every.join(filled, ["book", "sheet", "row"], "left").select("book", "sheet", "row", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def csv_line(values: Column) -> Column:
    """RFC 4180: fields with commas, quotes or line ends are quoted."""
    quoted = lambda v: F.when(F.regexp_like(v, F.lit('[",\r\n]|^ ')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.array_join(F.transform(values, quoted), ",")
