from itertools import combinations

from foliospark.llm import near_dedup

from .conftest import DOCS, frame, words


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_same_as_brute_force(spark, rng):
    base = [words(rng, n) for n in (3, 5, 9, 60, 200, 900)]
    texts = list(base)
    for t in base:
        texts += [edited(rng, t, k) for k in (0, 1, 2, 3, 8, 20)]
        texts.append(t.upper())
    texts += [None, "", " \n\t", "one", "one", "ONE", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_dense_group_with_tiny_runs(spark, rng):
    base = words(rng, 150, 10**6)
    texts = [edited(rng, base, 1 + k % 9) for k in range(80)] + [words(rng, 100) for _ in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(frame(spark, texts), max_run=4).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_dense_group_of_a_thousand(spark, rng):
    """Recall 1: copies with 0 to 40 edits of one text; most pairs are near 0.75, many documents link with few others."""
    base = words(rng, 150, 10**6)
    texts = [edited(rng, base, k % 41) for k in range(1000)] + [words(rng, 100) for _ in range(50)]
    want = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_deepest_trees_alone(spark, rng):
    base = words(rng, 150, 10**6)
    texts = [edited(rng, base, k % 31) for k in range(200)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(frame(spark, texts), max_run=1, windows=()).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_sketches_estimate_similarity(rng):
    import numpy as np

    random = np.random.default_rng(3)
    shared = random.integers(0, 1 << 63, 600, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, random.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in "ab")
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - 0.75) < 0.14
    unequal = int(np.bitwise_count((near_dedup.bits(a) ^ near_dedup.bits(b)).view(np.uint64)).sum())
    assert abs(unequal - near_dedup.BITS * 0.125) < 60


def test_null_ids_and_clashing_columns(spark, rng):
    t = words(rng, 60)
    docs = spark.createDataFrame([(None, t, 1), (None, t, 2), (5, t, 3), (7, t, 4), (7, "b", 5), (7, "a", 9)], "doc_id long, text string, comp long")
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.link(docs).collect())
    assert rows == [(False, 5, 5, True), (False, 7, 5, False), (False, 7, 5, False), (False, 7, 5, False), (True, 0, None, True), (True, 0, None, True)]
    docs = spark.createDataFrame([(None, t, 1), (None, t, 2), (7, "b", 5), (7, "a", 9), (7, "a", 8)], "doc_id long, text string, comp long")
    assert sorted((r.doc_id or 0, r.text, r.comp) for r in near_dedup.drop_duplicates(docs).collect()) == sorted([(0, t, 1), (0, t, 2), (7, "a", 8)])


def test_empty_repeated_and_stage(spark, rng):
    assert near_dedup.link(spark.createDataFrame([], DOCS)).count() == 0
    t = words(rng, 50)
    docs = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t, "en", "s", 1), (3, None, None, None, None)], DOCS)
    rows = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.link(docs).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    left = near_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
