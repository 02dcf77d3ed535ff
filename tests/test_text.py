from pyspark.sql import functions as F

from foliospark.functions import integrity, text
from foliospark.operators import cells, diff, model
from foliospark.operators.align import align_costs, gray_fingerprint, pixel_diff

import hashlib

import numpy as np


def each(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.k)]


def fingerprint(t):
    units = t.encode("utf-16-be")
    a, b, m = 0x811C9DC5, 0x9E3779B9, 0xFFFFFFFF
    for k in range(0, len(units), 2):
        c = int.from_bytes(units[k : k + 2])
        a = (a ^ c) * 0x01000193 & m
        b = (b ^ c) * 0x5BD1E995 & m
        b ^= b >> 13
    return f"{a:08x}{b:08x}{len(units) // 2:08x}"


def test_fingerprints_follow_the_scalar_model(spark):
    values = ["", "a", "hello", "é ß", "😀", "x😀y\n", "가나다", "\x00￿"]
    assert each(spark, values, text.fingerprint) == [fingerprint(v) for v in values]


def test_lines_and_paragraphs(spark):
    assert each(spark, ["a \t\r\nb\n\nc \n"], text.lines) == [["a", "b", "", "c", ""]]
    assert each(spark, ["Paragraph one line a\nline b\n\nParagraph two\n\n\nParagraph three"], text.paragraphs) == [["Paragraph one line a line b", "Paragraph two", "Paragraph three"]]
    assert each(spark, ["a\x0bb  c"], text.paragraphs) == [["a\x0bb c"]]
    assert each(spark, ["a\n\n\n\nb"], text.squeeze_blank_lines) == ["a\n\nb"]


def test_markdown_rules(spark):
    assert each(spark, ["a **b** _c_ `d` [e](f) ![g](h)i __j__ *k*"], text.strip_markdown) == ["a b c d e i j k"]
    assert each(spark, ["---", "- - -", "***", "**", "--*", "___ "], text.is_rule) == [True, True, True, False, False, True]
    assert [x and (x.level, x.ordered, x.number, x.text) for x in each(spark, ["- a", "  12. b", "c", "-d"], text.list_item)] == [(0, False, 0, "a"), (1, True, 12, "b"), None, None]
    blocks = model.markdown_blocks("# T #\npara **x**\nmore\n\n> q\n> r\n1. one\n  - two\n\n    code\n\n    end\n\n***\n```\n# not\n```\nlast")
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "T"), ("paragraph", "para x more"), ("quote", "q r"), ("item", "one"), ("item", "two"), ("code", "code\n\nend"), ("rule", ""), ("code", "# not"), ("paragraph", "last")]


def test_links_and_names(spark):
    values = ["http://a", " HTTPS://b", "javascript:x", "java\nscript:x", "#f", "a/b:c", "mailto:x", "vbscript:y", ":x", ""]
    assert each(spark, values, text.safe_href) == ["http://a", "HTTPS://b", "", "", "#f", "a/b:c", "mailto:x", "", ":x", ""]
    assert each(spark, ['a/b\\c:d*e?f"g<h>i|j'], text.safe_sheet_name) == ["a_b_c_d_e_f_g_h_i_j"]
    assert each(spark, ["<a b='c'>&\x01\x0b"], text.escape_xml) == ["&lt;a b=&apos;c&apos;&gt;&amp;"]


def pairs(spark, a, b):
    return spark.createDataFrame([(1, a, b)], "pair_id long, a array<string>, b array<string>")


def ops(df):
    return [(r.kind, r.a_pos, r.b_pos) for r in sorted(df.collect(), key=lambda r: r.seq)]


def test_trimmed_script(spark):
    got = ops(diff.trim(pairs(spark, list("12345"), list("12995"))))
    assert got == [("=", 0, 0), ("=", 1, 1), ("-", 2, 2), ("-", 3, 2), ("+", 4, 2), ("+", 4, 3), ("=", 4, 4)]
    assert ops(diff.trim(pairs(spark, [], ["x"]))) == [("+", 0, 0)] and ops(diff.trim(pairs(spark, ["a", "a"], ["a"]))) == [("=", 0, 0), ("-", 1, 1)]


def test_scripts_turn_a_into_b(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        script = diff.lcs_script(a, b)
        assert [a[i] if k == "=" else b[j] for k, i, j in script if k != "-"] == b
        assert [a[i] for k, i, _ in script if k != "+"] == a
        kept = sum(k == "=" for k, _, _ in script)
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert kept == best[-1, -1]
    assert [k for k, _, _ in diff.lcs_script(["a"], ["b"])] == ["-", "+"]


def test_hunks_and_report(spark):
    a = ["", *[f"L{k}" for k in range(1, 9)]]
    b = [x if x != "L4" else "L4X" for x in a]
    p = pairs(spark, a, b)
    script = diff.script(p)
    assert [r.header for r in diff.hunks(script).collect()] == ["@@ -2,7 +2,7 @@"]
    assert diff.report(script, p).first().report == "@@ -2,7 +2,7 @@\n L1\n L2\n L3\n-L4\n+L4X\n L5\n L6\n L7"
    same = pairs(spark, a, a)
    assert diff.report(diff.script(same), same).first().report == "identical"
    far = pairs(spark, list("abcdefghijklmnop"), list("Xbcdefghijklmnop") + ["Y"])
    assert [r.header for r in sorted(diff.hunks(diff.script(far)).collect(), key=lambda r: r.hunk)] == ["@@ -1,4 +1,4 @@", "@@ -14,3 +14,4 @@"]


def test_alignment():
    far = np.array([[0.0, 2, 2], [2, 2, 0]])
    assert align_costs(far) == [(0, 0), (None, 1), (1, 2)]
    assert align_costs(far.T) == [(0, 0), (1, None), (2, 1)]


def test_pixels():
    a = np.zeros((1, 2, 4), np.uint8)
    b = a.copy()
    b[0, 1, 2] = 200
    assert pixel_diff(a, b) == (1, (1, 0, 2, 1)) and pixel_diff(a, a) == (0, None)
    assert pixel_diff(a, np.zeros((2, 2, 4), np.uint8))[0] == 2
    assert gray_fingerprint(np.full((16, 16, 4), 255, np.uint8)) == [255] * 64 and len(gray_fingerprint(np.zeros((3, 5, 4), np.uint8))) == 64


def test_cells(spark):
    rows = [("b", "s", "A1", "n", "1"), ("b", "s", "C1", "n", "3"), ("b", "s", "B3", "n", "99"), ("b", "s", "A4", "b", "1"), ("b", "s", "B4", "b", "true"), ("b", "s", "C4", "s", "0"), ("b", "s", "D4", "s", "7"), ("b", "s", "x", "n", "1")]
    shared = spark.createDataFrame([("b", 0, 'Hi, "you"')], "book string, idx long, value string")
    grid = cells.grid(cells.resolve(spark.createDataFrame(rows, "book string, sheet string, ref string, type string, raw string"), shared))
    lines = [r.line for r in sorted(grid.select("row", cells.csv_line(F.col("values")).alias("line")).collect(), key=lambda r: r.row)]
    assert lines == ["1,,3", "", ",99", 'TRUE,FALSE,"Hi, ""you""",']


def test_runs_tables_and_wrapping(spark):
    runs = spark.createDataFrame([(1, 1, True, "가"), (1, 2, True, "나"), (1, 3, False, ""), (1, 4, False, "다"), (1, 5, True, "라")], "doc_id long, ord int, bold boolean, text string")
    assert [(r.bold, r.text) for r in sorted(model.merge_runs(runs, ["bold"]).collect(), key=lambda r: r.run_no)] == [(True, "가나"), (False, "다"), (True, "라")]
    assert model.table_grid([[(2, 2), (1, 1)], [(1, 1)]]) == (3, [(0, 0, 2, False), (0, 2, 1, False), (1, 0, 2, True), (1, 2, 1, False)])
    assert model.table_grid([[(2, 1), (1, 2)], [(1, 1), (1, 1)]]) == (3, [(0, 0, 2, False), (0, 2, 1, False), (1, 0, 1, False), (1, 1, 1, False), (1, 2, 1, True)])
    assert model.wrap("aa bb cc", lambda c: 1, 5) == ["aa bb", "cc"] or model.wrap("aa bb cc", lambda c: 1, 5) == ["aa", "bb cc"]
    assert model.wrap("abcdef", lambda c: 1, 4) == ["abcd", "ef"] and model.wrap("", lambda c: 1, 4) == [""]


def test_integrity(spark):
    data = spark.createDataFrame([(bytearray(b"x" * 2500),), (bytearray(b""),)], "d binary")
    got = [r.c for r in data.select(integrity.transfer_checksum(integrity.chunk_digests(F.col("d"), 1000)).alias("c")).collect()]
    want = [hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in parts)).hexdigest() for parts in ([b"x" * 1000, b"x" * 1000, b"x" * 500], [b""])]
    assert got == want
