"""Queries of text, diff and alignment operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import integrity, text
from ..functions.numbers import round2
from ..operators import align as A
from ..operators import diff as D
from ..operators.search import find_patterns
from .page_queries import _r2, pages_of, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SQL_LINES = r"lines_ as (select doc_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\r]+$', '')) as l from documents))"


def lines_of(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), "line")


@query(f"with {SQL_LINES} select * from lines_")
def text_lines(spark, sf):
    return lines_of(spark, sf)


@query(r"""with p as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n[ \t\r]*\n'), lambda x: trim(regexp_replace(x, '[\t\n\f\r ]+', ' ', 'g'))), lambda x: x <> '') as l from documents)
select doc_id, unnest(range(1, len(l) + 1)) as par_no, unnest(l) as paragraph from p""")
def paragraphs(spark, sf):
    broken = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    return read(spark, sf, "documents").select("doc_id", F.posexplode(text.paragraphs(broken)).alias("k", "paragraph")).select("doc_id", (F.col("k") + 1).cast("long").alias("par_no"), "paragraph")


@query(f"with {SQL_LINES} select line, count(*) as uses, count(distinct doc_id) as docs, min(doc_id) as first_doc from lines_ group by line having count(*) > 1")
def line_dictionary(spark, sf):
    return lines_of(spark, sf).groupBy("line").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).filter("uses > 1")


@query(r"with n as (select doc_id, sha256(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g')) as digest from documents), f as (select digest, min(doc_id) as first_doc, count(*) as copies from n group by digest) select n.doc_id, f.first_doc, f.copies from n join f using (digest) where copies > 1")
def identical_text(spark, sf):
    n = read(spark, sf, "documents").select("doc_id", F.sha2(F.array_join(text.lines(F.col("text")), "\n"), 256).alias("digest"))
    f = n.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1")
    return n.join(f, "digest").select("doc_id", "first_doc", "copies")


def _pairs(spark, sf):
    """Each document with the next; the digest groups make some pairs alike."""
    rows = lines_of(spark, sf).select(F.col("doc_id"), (F.col("line_no") - 1).alias("pos"), F.col("line").alias("text"))
    a = rows.withColumn("pair_id", F.col("doc_id"))
    b = rows.withColumn("pair_id", F.col("doc_id") - 1).filter("pair_id >= 0")
    return D.sides(a, b)


_TRIM_SQL = f"""with {SQL_LINES}, a as (select doc_id as pair_id, line_no as k, line from lines_), b as (select doc_id - 1 as pair_id, line_no as k, line from lines_ where doc_id > 0),
n as (select pair_id, coalesce(x.n, 0) as n, coalesce(y.m, 0) as m from (select pair_id, count(*) n from a group by 1) x full outer join (select pair_id, count(*) m from b group by 1) y using (pair_id)),
p as (select n.pair_id, n, m, coalesce(min(case when a.line is distinct from b.line then a.k end), least(n, m) + 1) - 1 as p from n left join a on a.pair_id = n.pair_id and a.k <= least(n, m) left join b on b.pair_id = n.pair_id and b.k = a.k group by n.pair_id, n, m),
s as (select p.pair_id, n, m, p, least(coalesce(min(case when a.line is distinct from b.line then n - a.k + 1 end), least(n, m) + 1) - 1, n - p, m - p) as s from p left join a on a.pair_id = p.pair_id and n - a.k < least(n, m) left join b on b.pair_id = p.pair_id and m - b.k = n - a.k group by p.pair_id, n, m, p)"""


@query(_TRIM_SQL + " select pair_id, n as a_lines, m as b_lines, p as equal_start, s as equal_end, n - p - s as removed, m - p - s as added from s where n > 0 or m > 0")
def trim_replace_diff(spark, sf):
    ops = D.trim(_pairs(spark, sf))
    kind = lambda k: F.count_if(F.col("kind") == k)
    first = F.coalesce(F.min(F.when(F.col("kind") != "=", F.col("seq"))), F.count("*"))
    return ops.groupBy("pair_id").agg((kind("=") + kind("-")).alias("a_lines"), (kind("=") + kind("+")).alias("b_lines"), first.alias("equal_start"), (kind("=") - first).alias("equal_end"), kind("-").alias("removed"), kind("+").alias("added"))


@query(_TRIM_SQL + """, h as (select *, greatest(p - 3, 0) as from_, least(s, 3) as tail from s where n - p - s > 0 or m - p - s > 0),
c as (select *, (p - from_) + (n - p - s) + tail as a_count, (p - from_) + (m - p - s) + tail as b_count from h)
select pair_id, cast(1 as bigint) as hunk, a_count, b_count, '@@ -' || (from_ + case when a_count > 0 then 1 else 0 end) || case when a_count <> 1 then ',' || a_count else '' end || ' +' || (from_ + case when b_count > 0 then 1 else 0 end) || case when b_count <> 1 then ',' || b_count else '' end || ' @@' as header from c""")
def diff_hunks(spark, sf):
    return D.hunks(D.trim(_pairs(spark, sf))).select("pair_id", F.col("hunk").cast("long").alias("hunk"), "a_count", "b_count", "header")


@query()
def lcs_diff(spark, sf):
    ops = D.script(_pairs(spark, sf))
    return D.hunks(ops).select("pair_id", "hunk", "a_start", "a_count", "b_start", "b_count", "header")


def _lane(start: str, times: str, tail: str) -> str:
    return f"list_reduce(list_prepend({start}::bigint, u), lambda a, c: {tail.format(x=f'(((xor(a, c) & 65535) * {times} + ((((xor(a, c) >> 16) * {times}) & 4294967295) << 16 & 4294967295)) & 4294967295)')})"


@query(f"""with w as (select doc_id, coalesce(text, '') as text from documents),
c as (select doc_id, case when text = '' then cast([] as bigint[]) else list_transform(string_split(text, ''), lambda ch: unicode(ch)::bigint) end as u, length(text) as n from w)
select doc_id, lpad(to_hex({_lane('2166136261', '16777619', '{x}')}), 8, '0') as first_lane, lpad(to_hex(n), 8, '0') as length_part from c""".replace("to_hex(", "lower_hex(").replace("lower_hex(", "format('{:x}', "))
def text_fingerprint(spark, sf):
    """The first lane and the length of every text; null counts as empty. Both lanes are tested against a scalar
    model."""
    f = text.fingerprint(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", f.alias("f")).select("doc_id", F.substring("f", 1, 8).alias("first_lane"), F.substring("f", 17, 8).alias("length_part"))


@query(f"""select a.vec_id, {_r2("list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: least(abs(z[1]::double * 1000 - z[2]::double * 1000) / 255.0, 1.0))) / 64 * 100")} as distance, a.label <> b.label as text_differs from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def page_distance(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 1000).alias("fp"), "label")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("fp").alias("fp_b"), F.col("label").alias("label_b"))
    return e.join(b, "vec_id").select("vec_id", round2(A.fingerprint_distance(F.col("fp"), F.col("fp_b")) * 100).alias("distance"), (F.col("label") != F.col("label_b")).alias("text_differs"))


@query()
def align_pages(spark, sf):
    """Conversations 2k and 2k+1 as page sequences, aligned by the lengths of all words, whole text and size."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w).cast("int"))
    page = F.struct("page_no", words.alias("fingerprint"), text.fingerprint(F.col("text")).alias("text_fp"), "width", "height")
    p = pages_of(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("x"))
    a, b = (p.filter(F.pmod("doc_id", F.lit(2)) == k).select(F.floor(F.col("doc_id") / 2).alias("pair_id"), F.col("x").alias(s)) for k, s in ((0, "a"), (1, "b")))
    return A.align(a.join(b, "pair_id"))


@query("select event_type, count(*) as pages, count(*) filter (where value > 50) as changed, min(case when value > 50 then event_id end) as first_changed, max(case when value > 50 then event_id end) as last_changed from events group by event_type")
def visual_summary(spark, sf):
    hit = F.col("value") > 50
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("pages"), F.count_if(hit).alias("changed"), F.min(F.when(hit, F.col("event_id"))).alias("first_changed"), F.max(F.when(hit, F.col("event_id"))).alias("last_changed"))


_MARKED = "replace(replace(replace(text, ' the ', ' **the** '), ' of ', ' [of](x) '), ' de ', ' _de_ ')"


@query("select doc_id, " + reduce(lambda s, r: "regexp_replace({}, '{}', '{}', 'g')".format(s, r[0], r[1].replace("$", "\\")), text.INLINE, _MARKED) + " as plain from documents")
def markdown_inline(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.strip_markdown(F.expr(_MARKED)).alias("plain"))


@query("""select page_id, replace(replace(replace(replace(replace(regexp_replace(html, '[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as escaped from pages""")
def xml_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.escape_xml(F.col("html")).alias("escaped"))


_HREF = "case page_id % 4 when 0 then url when 1 then ' javascript:' || url when 2 then 'MAILTO:a@b' else regexp_replace(url, '^[a-z]+:', '') end"


@query(f"with u as (select page_id, {_HREF} as h from pages) select page_id, case when h like ' javascript:%' then '' else h end as href from u")
def href_allowlist(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.safe_href(F.expr(_HREF)).alias("href"))


@query("select page_id, translate(url, '/\\:*?\"<>|', '_________') as name from pages")
def sanitize_name(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.safe_sheet_name(F.col("url")).alias("name"))


@query("""with f as (select doc_id, source || '.pdf' as name, lower(source) as k from documents), n as (select *, row_number() over (partition by k order by doc_id) as r from f)
select doc_id, case when r = 1 then name else regexp_replace(name, '^(.*)(\\.[^.]*)$', '\\1 (' || r || ')\\2') end as unique_name from n""")
def unique_names(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("name"))
    r = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("doc_id"))
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?\z", 1), F.regexp_extract("name", r"^(.+?)(\.[^.]*)?\z", 2)
    return d.withColumn("r", r).select("doc_id", F.when(F.col("r") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("r").cast("string"), F.lit(")"), ext)).alias("unique_name"))


@query("""with t as (select item_id, string_split(text, '. ')[1] as pattern from benchmark) select d.doc_id, t.item_id, instr(d.text, t.pattern) as first_at from documents d join t on instr(d.text, t.pattern) > 0 where length(t.pattern) >= 12""")
def forbidden_patterns(spark, sf):
    """The first sentence of each benchmark item, if it has 12 characters or more, in every document."""
    patterns = read(spark, sf, "benchmark").select("item_id", F.element_at(F.split("text", r"\. "), 1).alias("pattern")).filter(F.length("pattern") >= 12)
    return find_patterns(read(spark, sf, "documents"), patterns)


_DIGESTS = "list_transform(range(0, greatest(ceil(strlen(text) / 1000.0), 1)::bigint), lambda k: sha256(substring(hex(encode(text)), k * 2000 + 1, 2000)))"


@query(f"select doc_id, strlen(text) as bytes, cast(ceil(strlen(text) / 1000.0) as bigint) as chunks, sha256(unhex(array_to_string({_DIGESTS}, ''))) as checksum from documents")
def chunk_checksum(spark, sf):
    """Chunks of 1000 bytes, digested as hex text so that SQL can cut them."""
    data = F.encode(F.hex(F.encode("text", "UTF-8")), "UTF-8")
    return read(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), integrity.chunk_count(F.octet_length("text"), 1000).alias("chunks"), integrity.transfer_checksum(integrity.chunk_digests(data, 2000)).alias("checksum"))


@query("select source as transfer, count(*) as files, cast(sum(strlen(text)) as bigint) as total_size, cast(sum(ceil(strlen(text) / 65536.0)) as bigint) as total_chunks, count(*) <= 1000 and sum(strlen(text)) <= 8589934592 as accepted from documents group by source")
def transfer_manifest(spark, sf):
    size = F.octet_length("text").cast("long")
    return read(spark, sf, "documents").groupBy(F.col("source").alias("transfer")).agg(F.count("*").alias("files"), F.sum(size).alias("total_size"), F.sum(integrity.chunk_count(size, 65536)).alias("total_chunks"), ((F.count("*") <= 1000) & (F.sum(size) <= 8 << 30)).alias("accepted"))
