import math
import re
from collections import Counter

import sentencepiece

from foliospark.llm import quality

from .conftest import DOCS, frame, words


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(windows)
    repeat = {j for k, x in enumerate(windows) if count[x] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed


TEXTS = [None, "", " \n \t", "a b c a b c d", "x\x1cy\x85z\xa0w é😀", "l1\nl2\nl1\n\n l1\nl1", "a a a a a", "1 2 3\n1 2 3", "# $ %% && | <b>", "one " * 60]


def test_base_figures(spark, rng):
    texts = TEXTS + [words(rng, n, v) for n in (49, 50, 51, 300, 3000) for v in (5, 50, 5000)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t or ""), t
        assert not (r.base_failed and r.kept)


def test_fertility_figures(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=quality.default_vocabulary())
    text = "The cat sat ☃☃ on 12 mats\nand " * 9
    r = quality.measure(frame(spark, [text])).first()
    ids = [i for w in text.split() for i in sp.encode(w)]
    assert r.n_tokens == len(ids) and math.isclose(r.chars_per_token, sum(map(len, text.split())) / len(ids))
    assert math.isclose(r.byte_share, sum(map(sp.is_byte, ids)) / len(ids))
    runs = [ids[k : k + quality.RUN] for k in range(0, len(ids) // quality.RUN * quality.RUN, quality.RUN)]
    if len(ids) % quality.RUN:
        runs.append(ids[-quality.RUN :])
    entropy = sum(-sum(c / len(x) * math.log(c / len(x)) for c in Counter(x).values()) for x in runs) / len(runs) / math.log(min(quality.RUN, len(ids)))
    assert math.isclose(r.token_entropy, entropy, abs_tol=1e-9)


def test_junk_goes_and_clean_text_stays(spark, rng):
    clean = [words(rng, 150, 3000) for _ in range(80)]
    junk = [" ".join(f"{w}###" for w in words(rng, 150, 3000).split()) for _ in range(4)]
    got = {r.doc_id: r.kept for r in quality.judge(frame(spark, clean + junk)).collect()}
    assert all(got[k] for k in range(80)) and not any(got[k] for k in range(80, 84))
    kept = quality.keep(frame(spark, clean + junk))
    assert kept.columns == [x.split()[0] for x in DOCS.split(", ")] and kept.count() == 80


def test_edges(spark):
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "я " * 3, None, None, 1), (1, "я " * 3, None, None, 1)], DOCS).withColumnRenamed("n_chars", "n_words")
    assert [(r.doc_id, r.lang, r.kept) for r in quality.judge(docs).collect()] == [(1, "script:cyrillic", False)] * 2
