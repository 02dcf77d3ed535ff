"""Queries that write small files from tables and read them back: the readers' round trips."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells as C
from ..sources import build, office, pdf
from .page_queries import pages_of, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _files(rows, make):
    """(path, content): one file for each doc_id, made from its rows in order."""

    def run(key, pdf_):
        return pd.DataFrame({"path": [str(key[0])], "content": [make(pdf_)]})

    return rows.groupBy("doc_id").applyInPandas(run, "path string, content binary")


@query("select conv_id as doc_id, cast(turn + 1 as int) as page_no, length(text) as chars, cast(90 * (turn % 4) as int) as rotate, md5(regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')) as digest from conversations")
def pdf_text(spark, sf):
    """Conversations written as PDF files, and their pages read from those."""
    rows = pages_of(spark, sf).select("doc_id", "page_no", "text", "width", "height", "rotate")
    files = _files(rows, lambda p: build.pdf(p.sort_values("page_no")[["text", "width", "height", "rotate"]].to_dict("records")))
    p = pdf.scan(files)
    return p.select(F.col("path").cast("long").alias("doc_id"), "page_no", F.length("text").alias("chars"), "rotate", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("select conv_id as doc_id, string_agg(text || chr(10), '' order by turn) as text from conversations group by conv_id")
def docx_text(spark, sf):
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return office.docx(_files(rows, lambda p: build.docx(list(p.sort_values("turn")["text"])))).select(F.col("path").cast("long").alias("doc_id"), "text")


@query("with c as (select p_partkey // 50 as book, (p_partkey % 50) // 10 + 1 as row, p_partkey % 10 + 1 as col, case when p_partkey % 3 = 0 then p_size::varchar else p_name end as v from part) select book, row, string_agg(v, ',' order by col) as line from c group by all")
def xlsx_rows(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(F.floor(k / 50).alias("doc_id"), (F.floor(F.pmod(k, F.lit(50)) / 10) + 1).alias("r"), (F.pmod(k, F.lit(10)) + 1).alias("c"), F.when(F.pmod(k, F.lit(3)) == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name")).alias("v"))
    files = _files(rows, lambda p: build.xlsx({"Sheet1": {(int(a), int(b)): v for a, b, v in zip(p["r"], p["c"], p["v"], strict=True)}}))
    grid = C.grid(C.resolve(office.xlsx(files).withColumnRenamed("path", "book")))
    return grid.select(F.col("book").cast("long").alias("book"), "row", C.csv_line(F.col("values")).alias("line"))


@query("select doc_id, '%PDF-1.' || (doc_id % 8) as head, '1.' || (doc_id % 8) as version, case doc_id % 3 when 0 then 'image/png' when 1 then 'image/jpeg' end as mime from documents")
def file_probes(spark, sf):
    """Versions and image types by first bytes."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("%PDF-1."), F.pmod("doc_id", F.lit(8)).cast("string")).alias("head"))
    magic = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.pmod("doc_id", F.lit(3)) == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00")))
    return d.select("doc_id", "head", F.regexp_extract(text.pdf_version(F.concat(F.encode("head", "ISO-8859-1"), F.lit(b"\n"))), "^[0-9.]+", 0).alias("version"), text.image_type(magic).alias("mime"))
