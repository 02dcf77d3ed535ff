import hashlib

from foliospark.llm import secrets

from .conftest import DOCS, frame

KEY = "9f3c1e7ab2d84c560f1e2d3c4b5a69788796a5b4"


def test_secrets_are_told_from_what_looks_alike(spark):
    texts = [f'x token = "{KEY}" y', f"password: '{KEY[:32]}'", f"see commit {KEY} for this", "ring 4111222233334444 or 1234567890123456 now", "write to some.person.1985@mail.example.com.", None, "", f'é😀 api_key = "{KEY}". And token = "{KEY[::-1]}"', "a" * 5000 + " 1" * 300]
    got = {}
    for r in secrets.scan(frame(spark, texts)).collect():
        assert r.candidate_sha256 == hashlib.sha256(texts[r.doc_id][r.start : r.end].encode()).hexdigest()
        got.setdefault(r.doc_id, []).append((r.start, r.secret))
    assert got[0] == [(11, True)] and got[1] == [(11, True)]
    assert sorted(got[7]) == [(texts[7].index(KEY), True), (texts[7].index(KEY[::-1]), True)]
    assert not any(s for d in (2, 3, 4) for _, s in got.get(d, []))
    assert set(got) <= {0, 1, 2, 3, 4, 7}


def test_own_findings_and_edges(spark):
    rows = [(f'{c} "', f"{k:02d}ab45cd67ef89{k * 7919:08d}", '"', "p", float(c == "zulu =")) for k in range(40) for c in ("zulu =", "yank =")]
    own = spark.createDataFrame(rows, "before string, candidate string, after string, path string, label double")
    docs = spark.createDataFrame([(1, 'zulu = "77ab45cd67ef8912345678"', "en", None, 0), (1, 'zulu = "77ab45cd67ef8912345678"', "en", None, 0)], DOCS)
    assert secrets.scan(docs, own).count() == 2
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0
