from foliospark.llm import licenses

from .conftest import frame


def test_every_known_text_is_found_in_another_dress(spark):
    known = [(name, text) for name, texts in licenses.KNOWN.items() for text in texts]
    dressed = [f"Copyright (c) 2021 Some Body\nAll rights reserved.\n\n{text.upper()}\n" for _, text in known]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, dressed + ["prose before. " + known[0][1]])).collect()}
    assert [got[k] for k in range(len(known))] == [name for name, _ in known] and got[len(known)] is None
    assert len(licenses.KNOWN) == 22 and "3. Neither the name" in licenses.KNOWN["BSD-3-Clause"][0]


def test_a_table_of_digests_can_be_given(spark):
    table = licenses.digests_of(spark.createDataFrame([("B", "Be  kind!"), ("A", "be kind"), ("C", None), ("D", "--")], "license string, text string"))
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, ["BE KIND.", "", None, "unkind"]), digests=table).collect()}
    assert got == {0: "A", 1: None, 2: None, 3: None}
