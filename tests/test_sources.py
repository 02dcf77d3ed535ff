import base64
import zlib

import pytest

from foliospark.plans import catalog
from foliospark.sources import build, office, pdf
from foliospark.streaming import transfer


def test_pdf_round_trip_and_filters():
    data = build.pdf([{"text": "Hello (World)\nback\\slash", "rotate": 90}, {"text": "two", "flate": False, "width": 100, "height": 50}])
    rows = pdf.read_pages("x", data)
    assert [r[5] for r in rows] == ["Hello (World)\nback\\slash", "two"] and rows[0][4] == 90 and rows[1][2] == [0, 0, 100, 50]
    assert pdf.run_length(bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128])) == b"abczzz"
    packed = base64.a85encode(zlib.compress(bytes([5]) + b"bytes!" + bytes([128]))) + b"~>"
    doc = pdf.Document(build.pdf([{"text": ""}]))
    held = pdf.Stream({"Filter": [pdf.Name("ASCII85Decode"), pdf.Name("FlateDecode"), pdf.Name("RunLengthDecode")]}, packed)
    assert doc.decode(held) == b"bytes!"
    with pytest.raises(pdf.PdfError, match="no filter"):
        doc.decode(pdf.Stream({"Filter": pdf.Name("JBIG2Decode")}, b""))


def test_pdf_updates_maps_and_errors():
    base = build.pdf([{"text": "old", "flate": False}])
    body = b"BT (new) Tj [(a) -200 (b) -50 (c)] TJ (d) ' ET"
    update = b"4 0 obj\n<< /Length 999 >>\nstream\n" + body + b"\nendstream\nendobj\n"
    assert pdf.read_pages("x", base + update)[0][5] == "newa bc\nd"
    table, size = pdf.unicode_map(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfchar <41> <0391> <42> <0392> endbfchar 2 beginbfrange <43> <45> <0061> <50> <51> [<0078> <0079>] endbfrange")
    assert size == 1 and pdf._shown(b"AB", (table, 1)) == "ΑΒ" and pdf._shown(b"CDEPQ", (table, 1)) == "abcxy"
    assert "not a PDF" in pdf.read_pages("x", b"nothing")[0][6]
    assert "encrypted" in pdf.read_pages("x", base.replace(b"/Root", b"/Encrypt 9 0 R /Root"))[0][6]
    assert "no pages" in pdf.read_pages("x", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj")[0][6]


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_prediction(kind):
    rows = [bytes([10, 20, 30, 40]), bytes([11, 22, 33, 44])]
    above, out = bytes(4), b""
    for r in rows:
        line = bytearray()
        for k in range(4):
            a, b, c = r[k - 1] if k else 0, above[k], above[k - 1] if k else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))
            line.append((r[k] - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes([kind]) + line
        above = r
    assert pdf.unpredict(out, 15, 1, 8, 4) == b"".join(rows)


def test_office_files(spark):
    assert office.docx_text(build.docx(["a\tb", "c\nd", "", "", "", "e <&>"])) == "a\tb\nc\nd\n\ne <&>\n"
    got = office.xlsx_cells(build.xlsx({"One": {(1, 1): "x", (2, 28): "7"}, "Two": {(1, 2): "x"}}))
    assert got == [("One", "A1", "str", "x"), ("One", "AB2", "n", "7"), ("Two", "B1", "str", "x")]
    files = spark.createDataFrame([("a", bytearray(b"junk"))], "path string, content binary")
    assert "not a ZIP" in office.docx(files).first().error and "not a ZIP" in office.xlsx(files).first().error
    assert pdf.scan(files).first().error


def test_pipelines_are_checked_before_they_run():
    s = catalog.Step
    assert catalog.validate([s("a", "merge"), s("b", "rotate"), s("c", "protect")], "pdf", 3) == ("pdf", 1)
    with pytest.raises(catalog.PlanError, match="not available in pipelines"):
        catalog.validate([s("a", "pdftext")], "pdf", 1)
    rows = catalog.CATALOG.values()
    assert len(rows) == 45 and [sum(o.engine == e for o in rows) for e in ("wasm", "module", "transport")] == [38, 6, 1]
    assert [sum(getattr(o, f) for o in rows) for f in ("pipeline", "batch", "terminal")] == [25, 35, 18]
    key = catalog.artifact_key
    assert key(catalog.Step("a", "crop", {"x": 1, "y": 2}), ["d"]) == key(catalog.Step("b", "crop", {"y": 2, "x": 1}), ["d"]) != key(catalog.Step("a", "crop", {"x": 1, "y": 2}), ["e"])
    for steps, count, why in (([], 1, "needs steps"), ([s("a", "rotate"), s("a", "crop")], 1, "distinct"), ([s("a", "merge")], 1, "2 to 100"), ([s("a", "imgconv")], 1, "takes image"), ([s("a", "pdftext"), s("b", "txt2pdf")], 1, "last"), ([s("a", "nope")], 1, "no operation"), ([s("a", "stamp")], 1, "needs image"), ([s("a", "rotate")], 2, "1 to 1")):
        with pytest.raises(catalog.PlanError, match=why):
            catalog.validate(steps, "pdf", count)


def test_failures_are_rows(spark):
    from pyspark.sql import functions as F

    def work(data):
        if data == b"bad":
            raise ValueError("broken input")
        return data.upper()

    rows = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "index int, content binary").withColumn("r", catalog.attempt(work, F.col("content"), 1))
    got = {r["index"]: r.r for r in rows.collect()}
    assert got[1].ok and bytes(got[1].value) == b"OK" and (got[2].ok, got[2].error, got[2].attempts) == (False, "broken input", 2)


def message(kind, seq, offset=None, payload=None, size=None, checksum=None):
    return {"transfer": "t", "file": "f", "seq": seq, "kind": kind, "size": size, "offset": offset, "payload": payload, "checksum": checksum}


def test_transfer_protocol():
    import hashlib

    digests = [hashlib.sha256(x).hexdigest() for x in (b"abcd", b"ef")]
    steps = [(message("chunk", 0, 0, b"abcd"), "error: not started"), (message("start", 1, size=6), "started"), (message("chunk", 2, 0, b"abc"), "error: unexpected chunk"), (message("chunk", 3, 0, b"abcd"), "written"), (message("start", 4, size=6), "resumed"), (message("finish", 5, checksum="x"), "error: incomplete"), (message("chunk", 6, 4, b"ef"), "written"), (message("chunk", 7, 6, b"g"), "error: nothing is missing"), (message("finish", 8, checksum="x"), "error: checksum"), (message("finish", 9, checksum=transfer.checksum(digests)), "finished"), (message("finish", 10, checksum=transfer.checksum(digests)), "replayed")]
    state = None
    for m, want in steps:
        state, status = transfer.receive(state, m, 4)
        assert status == want, m


def test_transfer_as_a_stream(spark, tmp_path):
    schema = "transfer string, file string, seq long, kind string, size long, offset long, payload binary, checksum string"
    data = [message("start", 1, size=4), message("chunk", 2, 0, bytearray(b"wxyz")), message("finish", 3, checksum=transfer.checksum([__import__("hashlib").sha256(b"wxyz").hexdigest()]))]
    spark.createDataFrame([tuple(m.values()) for m in data], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = transfer.receiver(stream, 4).writeStream.format("memory").queryName("got").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.seq, r.status, r.offset) for r in spark.sql("select * from got order by seq").collect()] == [(1, "started", 0), (2, "written", 4), (3, "finished", 4)]
