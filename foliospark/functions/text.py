"""Text rules as column expressions. White space is always written out: engines differ on \\s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[\\t\\n\\f\\r ]"


def right_trim(line: Column) -> Column:
    """Without spaces, tabs and returns at the end."""
    return F.regexp_replace(line, r"[ \t\r]+\z", "")


def lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), right_trim)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, white space inside made single spaces, empty ones dropped."""
    parts = F.transform(F.split(text, "\n[ \\t\\r]*\n"), lambda p: F.trim(F.regexp_replace(p, f"{BLANK}+", " ")))
    return F.filter(parts, lambda p: p != "")


def squeeze_blank_lines(text: Column) -> Column:
    """Three line ends or more become two."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


#: Characters that XML 1.0 can't hold.
ILLEGAL_XML = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def escape_xml(text: Column) -> Column:
    out = F.regexp_replace(text, ILLEGAL_XML, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_pdf_literal(text: Column) -> Column:
    """Backslashes and brackets of a PDF string; characters beyond Latin-1 are an error."""
    out = text
    for c in ("\\", "(", ")"):
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return F.when(F.regexp_like(text, F.lit(r"[^\x00-\xFF]")), F.raise_error(F.lit("not Latin-1"))).otherwise(out)


def fingerprint(text: Column) -> Column:
    """Two 32-bit mixes over the UTF-16 units and their number, 24 hex digits."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    n = utf16_length(F.coalesce(text, F.lit("")))
    points = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda p: F.array(F.shiftright(p - 0x10000, 10) + 0xD800, (p - 0x10000).bitwiseAND(0x3FF) + 0xDC00)
    codes = F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, pair(p)).otherwise(F.array(p))))

    def product(a: Column, by: int) -> Column:
        """a * by modulo 2**32, in halves so that nothing overflows."""
        low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
        return (low * by + F.shiftleft((high * by).bitwiseAND(mask), 16).bitwiseAND(mask)).bitwiseAND(mask)

    def mix(s: Column, c: Column) -> Column:
        b = product(s["b"].bitwiseXOR(c), 0x5BD1E995)
        return F.struct(product(s["a"].bitwiseXOR(c), 0x01000193).alias("a"), b.bitwiseXOR(F.shiftright(b, 13)).alias("b"))

    start = F.struct(F.lit(0x811C9DC5).cast("long").alias("a"), F.lit(0x9E3779B9).cast("long").alias("b"))
    done = F.aggregate(codes, start, mix)
    return F.lower(F.concat(*[F.lpad(F.hex(x), 8, "0") for x in (done["a"], done["b"], n)]))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def decode_info(data: Column) -> Column:
    """PDF info bytes: UTF-16BE after a mark, else Latin-1."""
    marked = F.hex(F.substring(data, 1, 2)) == "FEFF"
    return F.when(marked, F.decode(F.substring(data, F.lit(3), F.octet_length(data)), "UTF-16BE")).otherwise(F.decode(data, "ISO-8859-1"))


def encode_info(text: Column) -> Column:
    plain = F.regexp_like(text, F.lit(r"^[\x00-\x7F]*\z"))
    return F.when(plain, F.encode(text, "US-ASCII")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def pdf_version(content: Column) -> Column:
    return F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-([0-9.]*)", 1)


def image_type(data: Column) -> Column:
    """MIME type by the first bytes; null for others."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("89504E47"), "image/png").when(h.startswith("FFD8"), "image/jpeg").when(h.startswith("474946"), "image/gif")


def png_size(data: Column) -> Column:
    at = lambda k: F.conv(F.hex(F.substring(data, k, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A", F.struct(at(17).alias("width"), at(21).alias("height")))


#: Fixed values, which results depend on: patterns of inline Markdown and what they leave. Images go, links leave their
#: label, then code, bold and italic leave their text: the order matters.
INLINE = ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"_([^_]+)_", "$1"))


def strip_markdown(text: Column) -> Column:
    for pattern, kept in INLINE:
        text = F.regexp_replace(text, pattern, kept)
    return text


def is_rule(line: Column) -> Column:
    """Three or more of one of - * _ , with spaces between allowed."""
    return F.regexp_like(F.replace(F.trim(line), F.lit(" "), F.lit("")), F.lit(r"^(-{3,}|\*{3,}|_{3,})\z"))


def list_item(line: Column) -> Column:
    """level, ordered, number and text of a list item; null if the line is none."""
    p = r"^([ \t]*)([-*+]|([0-9]+)\.)[ \t]+(.*)\z"
    got = lambda k: F.regexp_extract(line, p, k)
    level = F.when((F.length(F.replace(got(1), F.lit("\t"), F.lit("  "))) >= 2), 1).otherwise(0)
    return F.when(F.regexp_like(line, F.lit(p)), F.struct(level.alias("level"), (got(3) != "").alias("ordered"), F.coalesce(F.try_to_number(got(3), F.lit("999999999")).cast("int"), F.lit(0)).alias("number"), got(4).alias("text")))


def safe_href(href: Column) -> Column:
    """The link if it has no scheme or one of http, https and mailto; else empty."""
    h = F.regexp_replace(F.regexp_replace(href, "[\\t\\n\\r]", ""), "^[\\x0B\\f ]+|[\\x0B\\f ]+\\z", "")
    scheme = F.lower(F.regexp_extract(h, r"^([^:]+):", 1))
    token = F.regexp_like(scheme, F.lit(r"^[a-z0-9+.-]+\z"))
    return F.when(~token | scheme.isin("http", "https", "mailto"), h).otherwise("")


def safe_sheet_name(name: Column) -> Column:
    return F.translate(name, '/\\:*?"<>|', "_" * 9)


def is_ocr_text(text: Column) -> Column:
    return (F.trim(F.regexp_replace(text, f"{BLANK}+", " ")) != "") & ~F.regexp_like(text, F.lit(r"\p{Cc}"))


def is_unit(x: Column) -> Column:
    return x.between(0, 1) & ~F.isnan(x)


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def image_name(page_no: Column, extension: str = "png") -> Column:
    return F.format_string(f"page-%03d.{extension}", page_no.cast("int"))
