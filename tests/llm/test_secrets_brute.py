"""Candidates against a plain scan, and the forest on findings it hasn't seen."""

import re

from pyspark.sql import functions as F

from foliospark.llm import secrets

from .conftest import frame

KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-"


def plain(text):
    out, at = [], 0
    while at < len(text):
        if text[at] not in KEY:
            at += 1
            continue
        end = at
        while end < len(text) and text[end] in KEY:
            end += 1
        if end - at >= secrets.MIN_LENGTH:
            pad = end
            while pad < len(text) and text[pad] == "=":
                pad += 1
            # One or two = that nothing follows are padding.
            found = text[at:pad] if 0 < pad - end <= 2 and not (pad < len(text) and text[pad] in KEY) else text[at:end]
            found = found.rstrip(".")
            if len(found) >= secrets.MIN_LENGTH and re.search("[0-9]|[a-z][A-Z]+[a-z]", found):
                out.append((at, found))
        at = end
    return out


def test_candidates_are_those_of_a_plain_scan(spark, rng):
    alphabet = KEY + "== \n\"':é" * 2
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += [None, "", "API_KEY=9f3c0a1b2c3d4e5f60718293", "A_VERY_LONG_NAME_1=9f3c0a1b2c3d4e5f60718293", "x" * 3000 + "1", "k=" + "Ab1+" * 9 + "==", "k=" + "Ab1+" * 9 + "===", "see abcdefghijklmno1. Then"]
    got = {}
    for r in secrets.candidates(frame(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.candidate))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == plain(t or ""), t


def test_a_glued_name_is_not_part_of_the_secret(spark):
    import hashlib

    key = "9f3c0a1b2c3d4e5f60718293a4b5c6d7e8f90a1b"
    rows = secrets.scan(frame(spark, [f"export API_KEY={key}"])).collect()
    assert [(r.candidate_sha256, r.secret) for r in rows] == [(hashlib.sha256(key.encode()).hexdigest(), True)]


def test_forest_on_held_out_findings(spark):
    """Precision and recall on findings that training hasn't seen."""
    rows = secrets.generated_findings(spark).withColumn("h", F.pmod(F.xxhash64("candidate"), F.lit(3)))
    model = secrets.train(rows.filter("h <> 1").drop("h"))
    held, names = secrets._with_features(rows.filter("h = 1").drop("h"))
    out = model.transform(secrets.VectorAssembler(inputCols=names, outputCol="f").transform(held)).groupBy("label", "prediction").count().collect()
    n = {(r.label, r.prediction): r["count"] for r in out}
    assert n[1.0, 1.0] / (n[1.0, 1.0] + n.get((0.0, 1.0), 0)) > 0.97
    assert n[1.0, 1.0] / (n[1.0, 1.0] + n.get((1.0, 0.0), 0)) > 0.97
