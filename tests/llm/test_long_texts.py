"""Texts that long runs or many distinct words make hard."""

import time

import numpy as np

from foliospark.llm import pii, quality, warc
from foliospark.llm.common import materialize, new_path

from .conftest import frame, words


def test_addresses_in_long_digit_runs():
    assert pii.ips("0" * 5000 + "1.2.3.4") == [(0, 5007)]
    assert pii.ips("1.2.3.4.5.6.7.8 9..1.2.3.4, 256.1.1.1.2.3.4.5") == [(0, 7), (8, 15), (19, 26), (38, 45)]
    began = time.perf_counter()
    assert pii.ips("1" * 1_000_000) == [] and pii.ips("1." * 500_000) == [(k, k + 7) for k in range(0, 999_993, 8)]
    assert time.perf_counter() - began < 20


def test_addresses_as_the_pattern_finds_them(rng):
    import re

    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(500):
        text = "".join(rng.choice("0125..  x") for _ in range(60))
        want = [m.span() for m in pattern.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert pii.ips(text) == want, text


def test_contexts_are_the_words_beside_a_span():
    text = "my id  number: AB-123456, issued " + "y" * 500
    at = text.index("AB")
    contexts = pii.Contexts(text)
    assert contexts.left(at) == ["id", "number:"] and contexts.right(at + 9) == [","]
    assert contexts.right(text.index("yy")) == ["y" * pii.NEAR] and contexts.left(0) == []
    assert pii.patterns(contexts, at, at + 9) == ["id number: _", "number: _ ,"] or pii.patterns(contexts, at, at + 9)[0].startswith("id number")


def test_long_identifiers_are_candidates():
    text = "code " + "A1" * 300 + " end"
    assert pii.candidates(text, []) == [(5, 605)]


def test_bootstrap_finds_what_the_patterns_of_seeds_announce(spark):
    """Against a plain-Python version of the rounds."""
    seeds = [f"call me at +1 (555) 010-{k:04d} now" for k in range(8)]
    hidden = [f"call me at 555x{k:05d} now" for k in range(3)]
    texts = [*seeds, *hidden, "row of 1234567 items", None, ""]
    got = {r.doc_id: r.spans for r in pii.extract(frame(spark, texts)).collect()}
    edges, seed = set(), {}
    for t in texts:
        base = [x for s in pii.base_spans(t or "") for x in s]
        contexts = pii.Contexts(t or "")
        for spans, is_seed in ((base, True), (pii.candidates(t or "", base), False)):
            for a, b in spans:
                for p in pii.patterns(contexts, a, b):
                    edges.add((t[a:b], p))
                    seed[t[a:b]] = seed.get(t[a:b], False) or is_seed
    score = {i: float(s) for i, s in seed.items()}
    for _ in range(pii.MAX_ROUNDS):
        confidence = {}
        for p in {p for _, p in edges}:
            own = [score[i] for i, q in edges if q == p]
            c = sum(own) / (len(own) + pii.SHRINK)
            if sum(s >= pii.ACCEPT for s in own) >= pii.MIN_SUPPORT and c >= pii.PATTERN_CONFIDENCE:
                confidence[p] = c
        score = {i: 1.0 if seed[i] else 1 - np.prod([1 - 0.999 * confidence.get(p, 0.0) for j, p in edges if j == i]) for i in seed}
    for k, t in enumerate(texts):
        base = [x for s in pii.base_spans(t or "") for x in s]
        want = [f"found:{a}:{b}" for a, b in pii.candidates(t or "", base) if score.get(t[a:b], 0) >= pii.ACCEPT]
        assert [s for s in got[k].split(",") if s.startswith("found")] == want
    assert all("found" in got[k] for k in range(8, 11)) and got[11] == ""


def test_mask_with_clashing_names_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "mail a@b.co", 1, "x"), (1, None, 2, "y")], "doc_id long, text string, row int, spans string")
    assert sorted((r.text or "", r.row, r.spans) for r in pii.mask(docs).collect()) == [("", 2, "y"), ("mail [EMAIL]", 1, "x")]


def test_word_numbers_of_any_size():
    wide = np.array([1 << 21, 5, (1 << 22) + 7, 9, 1 << 21, 5, (1 << 22) + 7, 2])
    assert quality.repeated_words(wide) == 6 and quality.repeated_words(np.arange(8) << 20) == 0
    many = np.concatenate([np.arange(2_200_000), [0, 1, 2]])
    assert quality.repeated_words(many) == 6


def test_a_task_for_each_range(spark, rng):
    from pyspark.sql import functions as F

    rows = [(k, f"http://h/{k}", words(rng, 400)) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = materialize(warc.write_warc(pages, new_path(spark, "warc-test")), "warc-test-files")
    size = files.first()["bytes"]
    split = size // 20
    read = warc.read_warc(files, split_bytes=split)
    assert read.rdd.getNumPartitions() == -(-size // split)
    found = read.withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 300 and len({r.task for r in found}) > 10
