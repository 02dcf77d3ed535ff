import zlib

import numpy as np

from foliospark.llm import toxicity as T

from .conftest import DOCS, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, rng, n=400):
    rows, labels = [], []
    for k in range(n):
        toxic = int(k % 4 == 0)
        w = words(rng, rng.randrange(5, 120), 3000).split()
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["nastyword", "vileterm,", "FOULNESS"]))
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, toxic))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), {k: t for k, _, t in labels}


def test_held_out_accuracy(spark, rng):
    docs, labels, truth = corpus(spark, rng)
    got = T.score(docs, *T.fit(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 80 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_whole_texts_score_alike_in_any_batch(spark, rng):
    docs = [np.array([T.features(w.encode()) for w in words(rng, n).split()], np.int64).reshape(-1, 2) for n in (1, 2, 3, 50) for _ in range(8)]
    model = T.train(docs, np.arange(len(docs)) % 2, np.ones(len(docs)), updates=5)
    texts = ["", words(rng, 1), words(rng, 2), words(rng, 900), "...", "é ß"]
    batch = T.Scorer(model).score(texts)
    alone = [T.Scorer(model).score([t])[0] for t in texts]
    assert np.allclose(batch, alone)
    plain = [model.probability(T._DocScorer(model).logit(np.array([T.features(w) for w in t.encode().split()], np.int64).reshape(-1, 2))) for t in texts]
    assert np.allclose(batch, plain, atol=1e-5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (1, "", "xx", "s", 0), (None, "a", "en", "s", 1)], DOCS)
    got = T.score(docs, *T.fit(docs, spark.createDataFrame([], LABELS))).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.0}
    assert T.score(spark.createDataFrame([], DOCS), None).count() == 0
