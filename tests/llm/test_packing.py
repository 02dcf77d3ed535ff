import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliospark.llm import packing
from foliospark.llm.words import WordBpe

from .conftest import DOCS, words

TEXTS = ["Hello, world! It's 12km — naïve café", "ΣΑΣ Σ", "<|endoftext|> x", "İstanbul ́combining é", "a b\x85c\x1cd", "汉字かな 한글", "don't DON'T 's", "\x00\x07 odd", "ß ẞ ǅ ﬁ ²½", "x" * 3000, "😀 family 👨‍👩‍👧", ""]


@functools.cache
def _bpe():
    path = packing.default_vocabulary()
    return WordBpe(path), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_vocabulary())


def test_ids_are_the_library_s(library):
    bpe = WordBpe(packing.default_vocabulary())
    ids, bounds = bpe.tokens_of(TEXTS)
    for k, t in enumerate(TEXTS):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ é'sStTrReEvVlLmMdD’ \t\n\x85\xa0\x1c\x00\x7f<|>½²ªİſKÅ漢ß.,-_123ĺ́"), max_size=40), max_size=6))
def test_any_text_has_the_library_s_ids(texts):
    bpe, one = _bpe()
    ids, bounds = bpe.tokens_of(texts)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == one.encode(t, add_special_tokens=False).ids, t


def check(rows, want, capacity):
    """want: (doc_id, ids) of each document; every id lies in one piece, windows are filled without gaps."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    for d, ids in want:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    sizes = []
    for w in sorted(by_window):
        at = 0
        for r in sorted(by_window[w], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert sorted(by_window) == list(range(len(sizes)))
    assert all(s == capacity for s in sizes[:-1]) and 0 < sizes[-1] <= capacity
    return by_window


def test_windows_hold_the_mixture(spark, rng, library):
    rows = [(k, words(rng, rng.randrange(0, 300)) if k % 7 else None, "en", ("hot" if k % 3 else f"s{k % 5}") if k % 11 else None, 0) for k in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = packing.pack(docs, capacity=256).collect()
    want = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    windows = check(got, want, 256)
    total, share = sum(len(i) for _, i in want), {}
    for (_, ids), r in zip(want, rows, strict=True):
        share[r[3] or ""] = share.get(r[3] or "", 0) + len(ids) / total
    for w in sorted(windows)[:-1]:
        for s, p in share.items():
            held = sum(r.length for r in windows[w] if r.source == s)
            assert abs(held - 256 * p) <= 2.5


def test_target_shares_and_edges(spark, rng, library):
    rows = [(k, words(rng, 100), "en", "ab"[k % 2], 0) for k in range(20)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), capacity=100, shares={"a": 0.75, "b": 0.25}).collect()
    windows = check(got, [(r[0], [*library.encode(r[1], add_special_tokens=False).ids, 2]) for r in rows], 100)
    assert abs(sum(r.length for r in windows[0] if r.source == "a") - 75) <= 2
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    one = packing.pack(spark.createDataFrame([(5, "", None, None, None)], DOCS)).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in one] == [(5, 0, 1, 1, 0, 0)]


def test_many_queues_share(spark):
    rows = [(k, "one two", "en", f"src{k}", 0) for k in range(40)]
    got = packing.pack(spark.createDataFrame(rows, DOCS), capacity=16, max_queues=4).collect()
    assert len({r.doc_id for r in got}) == 40


def test_mixture_ranks_are_a_permutation():
    m = packing.Mixture([7, 100, 1, 0, 33], capacity=10)
    ranks = np.concatenate([m.rank(np.full(n, q), np.arange(n)) for q, n in enumerate(m.totals) if n])
    assert sorted(ranks.tolist()) == list(range(141))
    given = m.given(np.arange(142))
    assert (given.sum(1) == np.arange(142)).all() and (np.diff(given, axis=0) >= 0).all()
