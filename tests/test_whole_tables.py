"""Queries leave out no rows, words or characters, however large the table."""

import __spark_entry__
import pandas as pd

from .test_text import fingerprint


def run(spark, folder, query, table, rows):
    pd.DataFrame(rows).to_parquet(folder / f"{table}.parquet", index=False)
    return __spark_entry__.queries()[query](spark, str(folder)).collect()


def test_every_document_has_a_fingerprint(spark, tmp_path):
    texts = ["a", None, "", "b" * 1999, "c" * 2000, "long 😀 text " * 400]
    got = run(spark, tmp_path, "text_fingerprint", "documents", [{"doc_id": k, "text": t} for k, t in enumerate(texts)])
    want = {k: fingerprint(t or "") for k, t in enumerate(texts)}
    assert {r.doc_id: (r.first_lane, r.length_part) for r in got} == {k: (f[:8], f[16:]) for k, f in want.items()} and len(got) == len(texts)


def test_pages_that_differ_late_are_other_pages(spark, tmp_path):
    start = "word " * 70
    turns = [(0, 0, start + "abcde"), (1, 0, start + "ab cd"), (1, 1, start + "abcde")]
    got = run(spark, tmp_path, "align_pages", "conversations", [{"conv_id": c, "turn": t, "role": "user", "text": x} for c, t, x in turns])
    assert sorted((r.seq, r.a_ord, r.b_ord) for r in got) == [(0, None, 0), (1, 0, 1)]


def test_all_parts_become_books(spark, tmp_path):
    keys = [1999, 2000, 3999, 4000, 25000]
    rows = [{"p_partkey": k, "p_name": f"n{k}", "p_size": k} for k in keys]
    got = run(spark, tmp_path, "sparse_cells_to_grid", "part", rows)
    names = sorted(v for r in got for v in r.line.split(",") if v)
    assert names == sorted(f"n{k}" for k in keys) and {r.book for r in got} == {k // 20 for k in keys}
    got = run(spark, tmp_path, "xlsx_rows", "part", rows)
    names = sorted(v for r in got for v in r.line.split(",") if v)
    assert names == sorted(str(k) if k % 3 == 0 else f"n{k}" for k in keys) and {r.book for r in got} == {k // 50 for k in keys}
