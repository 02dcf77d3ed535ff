import hashlib
from collections import Counter

from foliospark.llm import substring_dedup as S

from .conftest import DOCS, frame, words


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def held(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, None if r.kept is None else bytes(r.kept)) for r in df.collect()}


def test_same_as_brute_force(spark, rng):
    shared = [words(rng, n) for n in (33, 34, 35, 36, 50, 120)]
    texts = [None, "", "short", "ab" * 400, "x" * 199, "x" * 200, "y" * 201, "é" * 150]
    for k in range(30):
        parts = [words(rng, rng.randrange(1, 60)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        if k % 3 == 0:
            parts.append(rng.choice(shared)[rng.randrange(5) : -rng.randrange(1, 5)])
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-2][:-7] + "changed", words(rng, 20) + texts[-3]]
    got = held(S.dedup(frame(spark, texts)))
    for k, want in enumerate(brute(texts)):
        assert got[k][:4] == want[:4], k
        assert got[k][4] is None or got[k][4] == want[4]


def test_blocks_agree(spark, rng, monkeypatch):
    import numpy as np

    text = np.frombuffer((words(rng, 400) * 2).encode(), np.uint8)
    whole = [x for part in S.segments(text) for x in zip(part[1].tolist(), part[2].tolist(), part[3].tolist(), strict=True)]
    monkeypatch.setattr(S, "BLOCK", 1000)
    cut = [x for part in S.segments(text) for x in zip(part[1].tolist(), part[2].tolist(), part[3].tolist(), strict=True)]
    spread = lambda rows: {p: a for a, f, last in rows for p in range(f, last + 1)}
    assert spread(whole) == spread(cut) and len(spread(whole)) == len(text) - 199


def test_empty_table_and_repeated_rows(spark, rng):
    assert S.dedup(spark.createDataFrame([], DOCS)).count() == 0
    t = words(rng, 60)
    rows = S.dedup(spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, None, "en", "s", 1)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, len(t)), (1, len(t)), (2, 0)]
