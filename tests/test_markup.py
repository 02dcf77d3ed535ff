import struct

from pyspark.sql import functions as F

from foliospark.functions.markup import inline_html, jpeg_header, jpeg_size, markdown_html, safe_link


def test_inline_marks_become_elements():
    cases = {
        "a < b & 'c'": "a &lt; b &amp; &#39;c&#39;",
        "**bold** and _it_": "<strong>bold</strong> and <em>it</em>",
        "`**raw** <x>`": "<code>**raw** &lt;x&gt;</code>",
        "![alt](x.png)left": "left",
        "[go **on**](https://e.org/?a=1&b)": '<a href="https://e.org/?a=1&amp;b" target="_blank" rel="noopener">go <strong>on</strong></a>',
        "[here](#top)": '<a href="#top">here</a>',
        "[bad *x*](java\tscript:run)": "bad <em>x</em>",
        "<script>": "&lt;script&gt;",
        "": "",
    }
    assert {k: inline_html(k) for k in cases} == cases
    assert safe_link(" MAILTO:a@b ") == "MAILTO:a@b" and safe_link("data:x") == ""


def _jpeg(order: str, turn: int) -> bytes:
    tiff = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, turn, 0)
    exif = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, 30, 40, 3) + bytes(9)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xff\xc2" + struct.pack(">H", len(frame) + 2) + frame


def test_jpeg_headers(spark):
    assert jpeg_header(_jpeg("<", 6)) == (40, 30, 3, 6) == jpeg_header(_jpeg(">", 6))
    whole = _jpeg("<", 1)
    files = [whole, whole[:20], b"\xff\xd8", b"\xff\xd8\xff\xda\x00\x02", b"GIF", b"", None, b"\xff\xd8\x00", whole[:-12]]
    df = spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "k int, b binary")
    got = {r.k: r.s for r in df.select("k", jpeg_size("b").alias("s")).collect()}
    assert tuple(got[0]) == (40, 30, 3, 1, None) and all(got[k].width is None and got[k].error for k in range(1, 9))


def test_markdown_column(spark):
    df = spark.createDataFrame([("*x*",), (None,)], "t string")
    assert [r.h for r in df.select(markdown_html(F.col("t")).alias("h")).collect()] == ["<em>x</em>", None]
