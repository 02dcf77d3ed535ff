"""Queries of the page algebra: conversations are documents, turns their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.numbers import round2
from ..operators import pages as P


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    w, h = (300 + F.pmod(n, F.lit(400))).cast("double"), (400 + F.pmod(n * 7, F.lit(500))).cast("double")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "role", "text", w.alias("width"), h.alias("height"), F.array(F.lit(0.0), F.lit(0.0), w, h).alias("media_box"), F.lit(None).cast("array<double>").alias("crop_box"), (90 * F.pmod("turn", F.lit(4))).cast("int").alias("rotate"))


SQL_PAGES = "pages_ as (select conv_id as doc_id, cast(turn + 1 as int) as page_no, role, text, cast(300 + length(text) % 400 as double) as width, cast(400 + (length(text) * 7) % 500 as double) as height, cast(90 * (turn % 4) as int) as rotate from conversations)"


def _r2(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 100 + 0.5) / 100)"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"with {SQL_PAGES} select doc_id, page_no, replace(replace('page n of N', 'N', cast(count(*) over (partition by doc_id) as varchar)), 'n', cast(page_no as varchar)) as label from pages_")
def page_number_labels(spark, sf):
    return P.labels(pages_of(spark, sf), "page n of N").select("doc_id", "page_no", "label")


_EXPR = "case doc_id % 4 when 0 then '1-' when 1 then ' 2 , 1' when 2 then '1-2,2,' else '9-3' end"


@query(f"""with {SQL_PAGES}, c as (select doc_id, cast(count(*) as int) n, {_EXPR} e from pages_ group by doc_id),
l as (select doc_id, case doc_id % 4 when 0 then range(1, n + 1) when 1 then [2, 1] when 2 then [1, 2, 2] end as p from c)
select doc_id, k as position, p[k] as page_no from (select doc_id, p, unnest(range(1, len(p) + 1)) as k from l)""")
def page_ranges_expand(spark, sf):
    counts = pages_of(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = counts.select("doc_id", F.posexplode(ranges.expand(F.expr(_EXPR), F.col("n"))).alias("position", "page_no"))
    return rows.select("doc_id", (F.col("position") + 1).cast("long").alias("position"), F.col("page_no").cast("long").alias("page_no"))


@query(f"""with {SQL_PAGES}, r as (select doc_id, page_no, page_no - row_number() over (partition by doc_id order by page_no) g from pages_ where role <> 'system' and page_no <> 3),
x as (select doc_id, min(page_no) a, max(page_no) b from r group by doc_id, g)
select doc_id, string_agg(case when a = b then cast(a as varchar) else a || '-' || b end, ',' order by a) as pages from x group by doc_id""")
def page_ranges_compact(spark, sf):
    return P.compact(pages_of(spark, sf).filter("role <> 'system' and page_no <> 3"))


@query(f"""with {SQL_PAGES}, x as (select doc_id // 2 as d, doc_id % 2 as source_part, page_no as source_page from pages_)
select d as doc_id, source_part, source_page, row_number() over (partition by d order by source_part, source_page) as page_no from x""")
def merge_pages(spark, sf):
    p = pages_of(spark, sf)
    part = lambda k: p.filter(F.pmod("doc_id", F.lit(2)) == k).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    return P.merge([part(0), part(1)]).select("doc_id", F.col("source_part").cast("long").alias("source_part"), "source_page", F.col("page_no").cast("long").alias("page_no"))


@query(f"""with {SQL_PAGES} select doc_id, page_no as source_page, cast(1 as int) as page_no from pages_ p where page_no = 2
union all select doc_id, page_no, cast(page_no + 1 as int) from pages_""")
def split_pages(spark, sf):
    p = pages_of(spark, sf)
    return P.pick(p, p.select("doc_id").distinct().withColumn("pages", F.lit("2, 1-"))).select("doc_id", "source_page", "page_no")


@query(f"with {SQL_PAGES} select doc_id, page_no as source_page, cast(count(*) over (partition by doc_id) + 1 - page_no as int) as page_no from pages_")
def reorder_pages(spark, sf):
    p = pages_of(spark, sf)
    back = p.groupBy("doc_id").agg(F.count("*").cast("int").alias("n")).select("doc_id", ranges.order(F.sequence(F.col("n"), F.lit(1), F.lit(-1))).alias("pages"))
    return P.reorder(p, back).select("doc_id", "source_page", "page_no")


@query(f"with {SQL_PAGES} select doc_id, page_no as source_page, cast(row_number() over (partition by doc_id order by page_no) as int) as page_no from pages_ where role <> 'assistant'")
def remove_pages(spark, sf):
    p = pages_of(spark, sf)
    return P.remove(p, p.filter("role = 'assistant'").select("doc_id", "page_no")).select("doc_id", "source_page", "page_no")


@query(f"""with {SQL_PAGES}, x as (select doc_id // 2 as d, case when doc_id % 2 = 0 then 'a' else 'b' end as side, page_no as source_page,
 case when doc_id % 2 = 0 then page_no else count(*) over (partition by doc_id) + 1 - page_no end as k from pages_)
select d as doc_id, side, source_page, cast(row_number() over (partition by d order by k, side) as int) as page_no from x""")
def interleave_pages(spark, sf):
    p = pages_of(spark, sf)
    part = lambda k: p.filter(F.pmod("doc_id", F.lit(2)) == k).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    return P.interleave(part(0), part(1), reverse=True).select("doc_id", "side", "source_page", "page_no")


@query(f"""with {SQL_PAGES}, x as (select doc_id, page_no as k, 0 as b, width, height from pages_ union all
 select doc_id, 1, unnest(range(1, 3)), width, height from pages_ where page_no = 1)
select doc_id, cast(row_number() over (partition by doc_id order by k, b) as int) as page_no, b > 0 as blank, width, height from x""")
def insert_blank(spark, sf):
    return P.insert_blank(pages_of(spark, sf), 1, 2).select("doc_id", "page_no", "blank", "width", "height")


@query(f"with {SQL_PAGES} select doc_id, page_no, cast(case when page_no % 2 = 1 then (((rotate - 90) % 360) + 360) % 360 else rotate end as int) as rotate from pages_")
def rotate_pages(spark, sf):
    return P.rotate(pages_of(spark, sf), -90, F.pmod("page_no", F.lit(2)) == 1).select("doc_id", "page_no", "rotate")


@query(f"with {SQL_PAGES} select doc_id, page_no, 10.0::double as x0, 20.0::double as y0, width - 30 as x1, height - 40.5 as y1 from pages_")
def crop_pages(spark, sf):
    box = F.col("crop_box")
    return P.crop(pages_of(spark, sf), 10, 20, 30, 40.5).select("doc_id", "page_no", box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[3].alias("y1"))


@query(f"""with {SQL_PAGES}, s as (select *, least(595.28 / width, 841.89 / height) as s from pages_)
select doc_id, page_no, {_r2('s * 100')} as scale, {_r2('((595.28 - s * width) / 2)')} as shift_x, {_r2('((841.89 - s * height) / 2)')} as shift_y from s""")
def resize_fit(spark, sf):
    return P.resize(pages_of(spark, sf), *P.A4).select("doc_id", "page_no", round2(F.col("scale") * 100).alias("scale"), round2(F.col("shift_x")).alias("shift_x"), round2(F.col("shift_y")).alias("shift_y"))


_CW, _CH = (P.A4[0] - 36) / 2, (P.A4[1] - 36) / 2


@query(f"""with {SQL_PAGES}, b as (select *, (page_no - 1) // 4 + 1 as sheet, (page_no - 1) % 4 as slot, case when rotate in (90, 270) then height else width end as w, case when rotate in (90, 270) then width else height end as h from pages_),
s as (select *, least({_CW} / w, {_CH} / h) as s from b)
select doc_id, page_no, cast(sheet as bigint) as sheet, cast(slot as int) as slot, {_r2('s * 100')} as scale,
 {_r2(f'(12 + (slot % 2) * ({_CW} + 12) + ({_CW} - s * w) / 2)')} as place_x,
 {_r2(f'({P.A4[1]} - 12 - (slot // 2 + 1) * {_CH} - (slot // 2) * 12 + ({_CH} - s * h) / 2)')} as place_y from s""")
def nup_layout(spark, sf):
    return P.n_up(pages_of(spark, sf), 4).select("doc_id", "page_no", "sheet", F.col("slot").cast("int").alias("slot"), round2(F.col("scale") * 100).alias("scale"), round2(F.col("place_x")).alias("place_x"), round2(F.col("place_y")).alias("place_y"))


_PLACES = ("top-left", "top-center", "top-right", "middle-left", "center", "middle-right", "bottom-left", "bottom-center", "bottom-right")


@query(f"""with {SQL_PAGES}, q as (select *, [{', '.join(repr(x) for x in _PLACES)}][doc_id % 9 + 1] as position, width * 0.2 as w from pages_)
select doc_id, page_no, position,
 {_r2("(case when position like '%left' then 24 when position like '%center' then width / 2 - w / 2 else width - 24 - w end)")} as x,
 {_r2("(case when position like 'top%' then height - 24 - w / 2 when position like 'middle%' or position = 'center' then height / 2 - w / 4 else 24 end)")} as y from q""")
def stamp_anchor(spark, sf):
    p = pages_of(spark, sf).withColumn("position", F.element_at(F.array(*[F.lit(x) for x in _PLACES]), (F.pmod("doc_id", F.lit(9)) + 1).cast("int")))
    w = F.col("width") * (P.STAMP_WIDTH_PERCENT / 100)
    x, y = P.anchor(F.col("position"), (F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")), w, w / 2)
    return p.select("doc_id", "page_no", "position", round2(x).alias("x"), round2(y).alias("y"))


@query(f"""with {SQL_PAGES}, q as (select *, ['fit', 'fill', 'stretch', 'original'][doc_id % 4 + 1] as fit, case when doc_id % 3 = 0 then height else width end as w, case when doc_id % 3 = 0 then width else height end as h from pages_),
p as (select *, case when w > h then 841.89 else 595.28 end as pw, case when w > h then 595.28 else 841.89 end as ph from q),
d as (select *, case fit when 'fit' then least((pw - 36) / w, (ph - 36) / h) when 'fill' then greatest((pw - 36) / w, (ph - 36) / h) else 1.0 end as s from p),
e as (select *, case when fit = 'stretch' then pw - 36 else w * s end as dw, case when fit = 'stretch' then ph - 36 else h * s end as dh from d)
select doc_id, page_no, fit, {_r2('dw')} as draw_w, {_r2('dh')} as draw_h, {_r2('(18 + (pw - 36 - dw) / 2)')} as x, {_r2('(18 + (ph - 36 - dh) / 2)')} as y from e""")
def image_placement(spark, sf):
    fit = F.element_at(F.array(*[F.lit(x) for x in ("fit", "fill", "stretch", "original")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    turn = F.when(F.pmod("doc_id", F.lit(3)) == 0, 6).otherwise(1)
    p = pages_of(spark, sf).withColumn("fit", fit).withColumn("i", P.place_image(F.col("width"), F.col("height"), turn, F.col("fit"), margin=18.0))
    return p.select("doc_id", "page_no", "fit", *[round2(F.col(f"i.{c}")).alias(c) for c in ("draw_w", "draw_h", "x", "y")])


@query(f"with {SQL_PAGES}, n as (select doc_id, list(distinct role) as k, bool_or(role = 'system') as has from (select doc_id, role from pages_ union all select doc_id, 'Off' from pages_) group by doc_id) select doc_id, case when has then 'system' else list_min(list_filter(k, lambda x: x <> 'Off')) end as chosen from n")
def flatten_choice(spark, sf):
    names = pages_of(spark, sf).groupBy("doc_id").agg(F.array_append(F.collect_set("role"), F.lit("Off")).alias("k"))
    return names.select("doc_id", P.choose_appearance(F.col("k"), F.lit("system")).alias("chosen"))


@query(f"with {SQL_PAGES} select doc_id, count(*) as pages, string_agg(cast(cast(width as int) as varchar) || 'x' || cast(cast(height as int) as varchar) || '@' || rotate, ' ' order by page_no) as sizes from pages_ group by doc_id")
def doc_facts(spark, sf):
    text = F.transform("page_sizes", lambda s: F.concat(s["w"].cast("int").cast("string"), F.lit("x"), s["h"].cast("int").cast("string"), F.lit("@"), s["rotate"].cast("string")))
    return P.facts(pages_of(spark, sf)).select("doc_id", "pages", F.array_join(text, " ").alias("sizes"))


@query(f"with {SQL_PAGES} select doc_id, cast(ceil(page_no / 3.0) as bigint) as segment, min(page_no) as first_page, max(page_no) as last_page from pages_ group by 1, 2")
def smart_split_fixed(spark, sf):
    return P.split_every(pages_of(spark, sf), 3).groupBy("doc_id", "segment").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


@query(f"""with {SQL_PAGES}, s as (select *, sum(case when role = 'user' or page_no = 1 then 1 else 0 end) over (partition by doc_id order by page_no rows unbounded preceding) as segment from pages_)
select doc_id, cast(segment as bigint) as segment, min(page_no) as first_page, max(page_no) as last_page from s group by 1, 2""")
def smart_split_pattern(spark, sf):
    return P.split_at(pages_of(spark, sf), F.regexp_like("role", F.lit("^user$"))).groupBy("doc_id", "segment").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


@query(f"""with {SQL_PAGES}, a as (select doc_id // 2 as d, page_no, width, height from pages_ where doc_id % 2 = 0), b as (select doc_id // 2 as d, page_no, width, height from pages_ where doc_id % 2 = 1)
select coalesce(a.d, b.d) as doc_id, a.page_no as a_page, b.page_no as b_page, coalesce(abs(a.width - b.width) > 0.01 or abs(a.height - b.height) > 0.01, true) as size_changed
from a full outer join b on a.d = b.d and a.page_no = b.page_no""")
def index_pairs(spark, sf):
    p = pages_of(spark, sf)
    a, b = (p.filter(F.pmod("doc_id", F.lit(2)) == k).select(F.floor(F.col("doc_id") / 2).alias("doc_id"), F.col("page_no").alias("k"), F.col("page_no").alias(f"{s}_page"), F.col("width").alias(f"{s}_w"), F.col("height").alias(f"{s}_h")) for k, s in ((0, "a"), (1, "b")))
    changed = (F.abs(F.col("a_w") - F.col("b_w")) > 0.01) | (F.abs(F.col("a_h") - F.col("b_h")) > 0.01)
    return a.join(b, ["doc_id", "k"], "full").select("doc_id", "a_page", "b_page", F.coalesce(changed, F.lit(True)).alias("size_changed"))
