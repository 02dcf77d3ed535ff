import numpy as np

from foliospark.llm import packing

from .conftest import DOCS, words


def test_shares_hold_beyond_256_sources(spark, rng):
    rows = [(k, words(rng, 100), "en", "ab"[k % 2], 0) for k in range(20)] + [(100 + k, "one", "en", f"s{k}", 0) for k in range(300)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), capacity=100, shares={"a": 0.75, "b": 0.25}).collect()
    first = [r for r in got if r.sequence_id == 0]
    assert sum(r.length for r in first) == 100 and abs(sum(r.length for r in first if r.source == "a") - 75) <= 2
    assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_every_source_has_its_own_part(spark):
    rows = [(k, "one two three", "en", f"s{k % 300}", 0) for k in range(1200)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), capacity=600).collect()
    per = {}
    for r in got:
        per[r.sequence_id, r.source] = per.get((r.sequence_id, r.source), 0) + r.length
    total = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r.length
    whole = sum(total.values())
    for w in range(whole // 600):
        assert all(abs(per.get((w, s), 0) - 600 * t / whole) <= 2.5 for s, t in total.items())


def test_prefixes_of_many_queues_are_exact():
    rng = np.random.default_rng(1)
    totals = rng.integers(0, 6, 500)
    m = packing.Mixture(totals)
    order = sorted((m.deadline(q, j), q) for q, n in enumerate(totals) for j in range(n))
    at = np.arange(0, len(order), 37)
    want = np.array([np.bincount([q for _, q in order[:n]], minlength=500) for n in at])
    assert (m.given(at) == want).all()
