"""Queries of sizes, selections, page orders, characters and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, names, ranges
from .page_queries import SQL_PAGES, pages_of, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""with {SQL_PAGES}, s as (select doc_id, page_no, width as w, height as h, least(1.0::double, 350.0::double / width, 500.0::double / height) as k from pages_)
select doc_id, page_no, case when k < 1 then greatest(1, floor(w * k + 0.5)) else w end::bigint as width, case when k < 1 then greatest(1, floor(h * k + 0.5)) else h end::bigint as height from s""")
def fit_size(spark, sf):
    size = geometry.fit_size(F.col("width"), F.col("height"), 350, 500)
    return pages_of(spark, sf).select("doc_id", "page_no", size.alias("s")).select("doc_id", "page_no", "s.width", "s.height")


@query(f"""with {SQL_PAGES}, a as (select *, least(2.0::double, sqrt(200000.0::double / (width * height))) as k from pages_),
b as (select *, case when ceil(width * k) * ceil(height * k) > 200000 then k * (sqrt(200000.0::double / (ceil(width * k) * ceil(height * k))) * 0.999999::double) else k end as k2 from a)
select doc_id, page_no, ceil(width * k2)::bigint as width, ceil(height * k2)::bigint as height from b where ceil(width * k2) * ceil(height * k2) <= 200000""")
def render_size(spark, sf):
    size = geometry.render_size(F.col("width"), F.col("height"), 2.0, 200_000)
    return pages_of(spark, sf).select("doc_id", "page_no", size.alias("s")).filter("s is not null").select("doc_id", "page_no", "s.width", "s.height")


_CORNERS = ("page_no * 61.0 % 450 - 30", "page_no * 89.0 % 700 - 50", "doc_id * 37.0 % 800 - 20", "doc_id * 53.0 % 900 - 90")


@query(f"""with {SQL_PAGES}, c as (select doc_id, page_no, width as w, height as h, {", ".join(f"({c.replace('.0', '.0::double')})::double as c{k}" for k, c in enumerate(_CORNERS))} from pages_),
s as (select *, greatest(0, least(w, c0, c2)) as l, greatest(0, least(w, greatest(c0, c2))) as r, greatest(0, least(h, c1, c3)) as t, greatest(0, least(h, greatest(c1, c3))) as b from c),
p as (select *, greatest(0, floor(l / w * 640) - 8) as x, greatest(0, floor(t / h * 480) - 8) as y from s where l < r and t < b)
select doc_id, page_no, x::bigint as x, y::bigint as y, (least(640, ceil(r / w * 640) + 8) - x)::bigint as width, (least(480, ceil(b / h * 480) + 8) - y)::bigint as height from p""")
def selection_pixels(spark, sf):
    """Selections of pages that are drawn at 640 by 480 pixels; those without area give no row."""
    corners = [F.expr(c).cast("double") for c in _CORNERS]
    box = geometry.selection(*corners, F.col("width"), F.col("height"))
    rows = pages_of(spark, sf).select("doc_id", "page_no", box.alias("box")).filter("box is not null")
    cut = geometry.selection_pixels(F.col("box"), F.lit(640), F.lit(480), 8)
    return rows.select("doc_id", "page_no", cut.alias("s")).select("doc_id", "page_no", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("x", "y", "width", "height")])


@query("""with n as (select conv_id as doc_id, count(*) as n from conversations group by 1), m as (select *, range(1, n + 1) as l, doc_id % n + 1 as page, doc_id * 7 % n as target from n),
r as (select *, list_filter(l, lambda x: x <> page) as rest from m)
select doc_id, array_to_string(list_concat(list_concat(rest[1:target], [page]), rest[target + 1:]), ',') as page_order from r""")
def move_page(spark, sf):
    """One page of each conversation moved to another place."""
    n = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    order = F.sequence(F.lit(1).cast("long"), F.col("n"))
    new = ranges.moved(order, F.pmod("doc_id", "n") + 1, F.pmod(F.col("doc_id") * 7, F.col("n")))
    return n.select("doc_id", F.array_join(new, ",").alias("page_order"))


@query("""with c as (select doc_id, unnest(string_split(text, '')) as ch, unnest(range(0, len(string_split(text, '')))) as k from documents where text <> ''), f as (select doc_id, ch, min(k) as k from c where ch <> chr(10) group by all)
select d.doc_id, coalesce(string_agg(ch, '' order by k), '') as characters from documents d left join f using (doc_id) where d.text is not null group by d.doc_id""")
def distinct_characters(spark, sf):
    d = read(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", F.array_join(names.distinct_characters(F.col("text")), "").alias("characters"))


@query("select page_id, url <> '' and url not in ('.', '..') and not regexp_matches(url, '[/\\\\]') and strlen(url) <= 255 as whole, length(split_part(url, '/', 3)) between 1 and 255 as host from pages")
def file_names(spark, sf):
    """Whether an address, and its host, can be the name of a file."""
    return read(spark, sf, "pages").select("page_id", names.is_file_name(F.col("url")).alias("whole"), names.is_file_name(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"))


@query()
def transfer_names(spark, sf):
    """Each conversation as a transfer whose files are named by role."""
    files = read(spark, sf, "conversations").select(F.col("conv_id").alias("transfer"), F.col("turn").alias("file_no"), F.concat("role", F.lit(".txt")).alias("name"))
    return names.transfer_names(files)


@query("select l_suppkey as image, cast(l_quantity as int) as red, l_linenumber as green, cast(l_discount * 100 as int) as blue, count(*) as pixels from lineitem group by all")
def color_histogram(spark, sf):
    rgb = (F.col("l_quantity").cast("int").alias("red"), F.col("l_linenumber").alias("green"), F.round(F.col("l_discount") * 100).cast("int").alias("blue"))
    return read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("image"), *rgb).agg(F.count("*").alias("pixels"))
