from foliospark.llm import licenses

from .conftest import DOCS, frame


def test_copies_of_one_licence_agree(spark):
    mit = licenses.KNOWN["MIT"][0]
    texts = [mit, "MIT License\n\nCopyright (c) 2019 A. Person\n\n" + mit.split("\n\n", 1)[1], mit.upper().replace(",", " ,"), mit.replace("\n\n", " ").replace('"', "'"), mit + " Not.", "This work is licenced under the GNU General Public Licence, version 3", None, "", "(c) 1999 X\nall rights reserved.\n", "copyright law is hard"]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert [got[k].license for k in range(len(texts))] == ["MIT"] * 4 + [None, "GPL-3.0", None, None, None, None]
    assert got[6].license_digest == got[7].license_digest == got[8].license_digest != got[9].license_digest


def test_edges(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    docs = frame(spark, ["x", "x"]).withColumnRenamed("source", "license")
    assert licenses.scan(docs.union(docs)).count() == 4
