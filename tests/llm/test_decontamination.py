from foliospark.llm import decontamination as D

from .conftest import DOCS, frame, words

ITEM = "A train leaves Springfield with Maria at noon and travels 120 km in 3 hours while Peter waits 45 minutes. How far does Maria travel in 120 minutes by that train?"
BENCH = "item_id long, text string"


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), BENCH)


def hits(df):
    return {(r.doc_id, r.item_id): r.kind for r in df.collect()}


def test_copies_and_new_parameters_are_found(spark, rng):
    noise = lambda: words(rng, 40)
    changed = ITEM.replace("120", "250").replace("Maria", "Nadia").replace("45", "10").replace("Springfield", "Oslo")
    wrong = ITEM.replace("120 minutes", "99 minutes").replace("Maria at", "Nadia at")
    texts = [f"{noise()} {ITEM} {noise()}", ITEM.upper(), f"{noise()}\n{changed}\n{noise()}", f"{noise()}. {wrong} {noise()}", noise(), None, "", ITEM[: len(ITEM) // 4], ITEM.replace(" ", "***  ")]
    got = hits(D.contaminated(frame(spark, texts), bench(spark, ITEM, words(rng, 30), None, "")))
    assert got.pop((0, 0)) == "exact" and got.pop((2, 0)) == "reparameterised" and got.pop((8, 0)) == "exact"
    # Upper case has no names: those windows differ, the others are enough.
    got.pop((1, 0), None)
    assert got == {}


def test_short_items_and_equal_items(spark, rng):
    short = "tell me the capital city"
    texts = [f"{words(rng, 9)} {short} {words(rng, 9)}", "tell me the capital", words(rng, 30)]
    assert hits(D.contaminated(frame(spark, texts), bench(spark, short, short))) == {(0, 0): "exact"}


def test_same_as_brute_force_on_literal_text(spark, rng):
    items = [words(rng, n, 10**6).replace("x", "") for n in (12, 20, 40)]
    items = ["".join(c for c in t if not c.isdigit() or rng.random() < 0) + "" for t in items]
    letters = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [letters(n) for n in (12, 20, 40)]
    texts = []
    for k in range(40):
        w = letters(30).split()
        item = items[k % 3].split()
        part = item[rng.randrange(len(item)) :] if k % 2 else item
        w[10:10] = part
        texts.append(" ".join(w))
    want = set()
    for d, t in enumerate(texts):
        have = {tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)}
        for i, x in enumerate(items):
            own = [tuple(x.split()[k : k + 8]) for k in range(len(x.split()) - 7)]
            if 2 * sum(o in have for o in own) >= len(own):
                want.add((d, i))
    assert set(hits(D.contaminated(frame(spark, texts), bench(spark, *items)))) == want


def test_edges(spark):
    docs = frame(spark, [ITEM, ITEM])
    assert D.contaminated(docs, spark.createDataFrame([], BENCH)).count() == 0
    assert D.contaminated(spark.createDataFrame([], DOCS), bench(spark, ITEM)).count() == 0
    assert hits(D.contaminated(docs.union(docs), bench(spark, ITEM))) == {(0, 0): "exact", (1, 0): "exact"}
    left = D.drop_contaminated(docs.union(frame(spark, ["clean", None], first=7)), bench(spark, ITEM))
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [7, 8]
