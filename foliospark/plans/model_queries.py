"""Queries of document-model, cell, budget and batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import column_letters
from ..operators import cells as C
from ..operators import model as M
from . import catalog
from .page_queries import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""with r as (select conv_id as doc_id, turn, role = 'assistant' as bold, text from conversations where text <> ''), g as (select *, turn - row_number() over (partition by doc_id, bold order by turn) as g, lag(bold) over (partition by doc_id order by turn) as p from r),
n as (select *, sum(case when p is distinct from bold then 1 else 0 end) over (partition by doc_id order by turn) as run_no from g)
select doc_id, cast(run_no as bigint) as run_no, bold, string_agg(text, '' order by turn) as text from n group by doc_id, run_no, bold""")
def merge_runs(spark, sf):
    r = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), (F.col("role") == "assistant").alias("bold"), "text")
    return M.merge_runs(r, ["bold"])


@query("""with p as (select conv_id as doc_id, turn, unnest(string_split(text, chr(10))) as text, unnest(range(0, len(string_split(text, chr(10))))) as k from conversations)
select doc_id, row_number() over (partition by doc_id order by turn, k) as para_no, turn as block_no, text from p""")
def normalize_blocks(spark, sf):
    b = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.lit(0).alias("run_no"), "text")
    return M.split_paragraphs(b).select("doc_id", "para_no", "block_no", "text")


@query()
def markdown_blocks(spark, sf):
    marked = F.concat(F.lit("# "), F.replace("text", F.lit("\nT"), F.lit("\n\n- T")))
    return M.parse_markdown(read(spark, sf, "documents").select("doc_id", marked.alias("text")))


@query()
def wrap_lines(spark, sf):
    return M.wrap_lines(read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), 40.0, {"i": 0.25, "l": 0.25, "m": 0.8, "w": 0.75})


@query("""with c as (select p_partkey // 20 as book, (p_partkey % 20) // 5 * 2 + 1 as row, (p_partkey * 7) % 30 + 1 as col, p_name from part),
u as (select book, row, col, max(p_name) as v from c group by all), w as (select book, row, max(col) as width from u group by all), n as (select book, max(row) as n from u group by book),
r as (select book, unnest(range(1, n + 1)) as row from n),
g as (select w.book, w.row, unnest(range(1, width + 1)) as col from w),
t as (select g.book, g.row, string_agg(coalesce(u.v, ''), ',' order by g.col) as line from g left join u on u.book = g.book and u.row = g.row and u.col = g.col group by all)
select r.book, r.row, coalesce(t.line, '') as line from r left join t on t.book = r.book and t.row = r.row""")
def sparse_cells_to_grid(spark, sf):
    k = F.col("p_partkey")
    row, col = F.floor(F.pmod(k, F.lit(20)) / 5) * 2 + 1, F.pmod(k * 7, F.lit(30)) + 1
    c = read(spark, sf, "part").groupBy(F.floor(k / 20).alias("book"), row.alias("r"), col.alias("c")).agg(F.max("p_name").alias("raw"))
    refs = c.select("book", F.lit("1").alias("sheet"), F.concat(column_letters(F.col("c")), F.col("r").cast("string")).alias("ref"), F.lit("str").alias("type"), "raw")
    return C.grid(C.resolve(refs)).select("book", "row", C.csv_line(F.col("values")).alias("line"))


@query("select d.doc_id, coalesce(nullif(case when l.quality = 1 then 'good' else '' end, ''), d.source) as title, coalesce(nullif(case when l.toxic = 1 then 'toxic' end, ''), d.lang) as subject from documents d left join labels l using (doc_id)")
def metadata_merge(spark, sf):
    old = read(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("subject"))
    new = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("title"), F.when(F.col("toxic") == 1, "toxic").alias("subject"))
    return M.merge_metadata(old, new, ["title", "subject"])


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as word, unnest(range(0, len(string_split(text, ' ')))) as word_no from documents), c as (select *, ((doc_id * 31 + word_no * 17) % 100) / 100.0::double as confidence from w)
select doc_id, count(*) as words, sum(length(word))::bigint as chars from c where confidence >= 0.6 and trim(regexp_replace(word, '[\\t\\n\\f\\r ]+', ' ', 'g')) <> '' and not regexp_matches(word, '\\p{Cc}') group by doc_id""")
def ocr_filter(spark, sf):
    w = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("word_no", "word"))
    c = F.pmod(F.col("doc_id") * 31 + F.col("word_no") * 17, F.lit(100)) / 100.0
    return w.filter((c >= 0.6) & text.is_unit(c) & text.is_ocr_text(F.col("word"))).groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))


@query("select doc_id, source, cast(sum(strlen(text)) over (partition by source order by doc_id rows unbounded preceding) as bigint) as used, sum(strlen(text)) over (partition by source order by doc_id rows unbounded preceding) <= 65536 as within from documents")
def budget_running(spark, sf):
    d = read(spark, sf, "documents")
    return M.running_budget(d, F.octet_length("text"), 65536, ["source"], ["doc_id"]).select("doc_id", "source", "used", "within")


@query("select user_id, count(*) as inputs, count(*) filter (where event_type <> 'error') as succeeded, count(*) filter (where event_type = 'error') as failed, coalesce(string_agg(cast(event_id as varchar), ',' order by event_id) filter (where event_type = 'error'), '') as failures from events group by user_id")
def batch_failures(spark, sf):
    """Failures as a column; a manifest lists them."""
    e = read(spark, sf, "events").select(F.col("user_id"), F.col("event_id").alias("index"), (F.col("event_type") != "error").alias("ok"))
    s = catalog.summarise(e, ["user_id"])
    return s.select("user_id", "inputs", "succeeded", "failed", F.array_join(F.transform("failures", lambda x: x["index"].cast("string")), ",").alias("failures"))


def _listed(names: str, takes: str, gives: str, least: int = 1, most: int = 1, many: bool = False, uses: str = "pb") -> str:
    flags = ", ".join(f"{flag in uses} as {name}" for flag, name in (("t", "terminal"), ("p", "pipeline"), ("b", "batch")))
    return f"select unnest(string_split('{names}', ' ')) as id, '{takes}' as takes, {least}::int as least, {most}::int as most, '{gives}' as gives, {many} as many, {flags}"


#: p: in pipelines, b: in batches, t: comes last.
_CATALOG_SQL = " union all ".join(
    [
        _listed("remove blank rotate crop resize nup watermark pagenum compress flatten metadata unlock stamp", "pdf", "pdf"),
        _listed("merge", "pdf", "pdf", 2, 100),
        _listed("interleave", "pdf", "pdf", 2, 2),
        _listed("protect", "pdf", "pdf", uses="pbt"),
        _listed("reorder", "pdf", "pdf", uses="p"),
        _listed("split", "pdf", "pdf", many=True, uses="bt"),
        _listed("workflow", "pdf", "pdf", most=100, uses="t"),
        _listed("batch", "pdf", "pdf", most=500, many=True, uses="t"),
        _listed("pdftext", "pdf", "text", uses="bt"),
        _listed("pdfdiff", "pdf", "text", 2, 2, uses="t"),
        _listed("info", "pdf", "json", uses="bt"),
        _listed("pdfimages pdf2img", "pdf", "zip", uses="bt"),
        _listed("pdf2docx", "pdf", "docx", uses="bt"),
        _listed("pdf2hwpx", "pdf", "hwpx", uses="bt"),
        _listed("img2pdf", "image", "pdf", most=500),
        _listed("imgconv imgresize", "image", "image"),
        _listed("txt2pdf md2pdf", "text", "pdf"),
        _listed("typst", "text", "pdf", uses=""),
        _listed("mdedit htmledit", "text", "text", uses=""),
        _listed("docx2pdf", "docx", "pdf"),
        _listed("docx2hwpx", "docx", "hwpx", uses="bt"),
        _listed("hwpx2pdf", "hwpx", "pdf"),
        _listed("hwpx2docx", "hwpx", "docx", uses="bt"),
        _listed("hwp2pdf", "hwp", "pdf"),
        _listed("xlsx2csv", "xlsx", "csv", uses="bt"),
        _listed("ocrpdf", "file", "pdf", most=500, uses="t"),
        _listed("ocr", "file", "text", most=500, uses="bt"),
        _listed("send", "file", "file", most=1000, many=True, uses="t"),
        _listed("redact", "raster-pages", "pdf", most=500, uses="t"),
    ]
)


@query(_CATALOG_SQL)
def operation_catalog(spark, sf):
    return catalog.as_table(spark)
