from foliospark.llm import decontamination as D

from .conftest import frame, words
from .test_decontamination import ITEM, bench, hits


def test_every_place_is_compared(spark, rng):
    wrong = ITEM.replace("120 minutes", "99 minutes").replace("Maria at", "Nadia at")
    changed = ITEM.replace("120", "250").replace("Maria", "Nadia").replace("45", "10")
    noise = lambda: words(rng, 30)
    texts = [f"{noise()}. {wrong} {noise()}. {ITEM} {noise()}", f"{noise()}. {wrong} {noise()}. {changed}", f"{wrong} {noise()}. {wrong}"]
    assert hits(D.contaminated(frame(spark, texts), bench(spark, ITEM))) == {(0, 0): "exact", (1, 0): "reparameterised"}


def test_a_repeated_window_counts_once(spark):
    letters = ["a" + "bcdefghij"[k // 9] + "bcdefghij"[k % 9] for k in range(60)]
    part = " ".join(letters[:8])
    texts = [". ".join([part, "x y z"] * 80), " ".join(letters)]
    got = D.contaminated(frame(spark, texts), bench(spark, " ".join(letters))).collect()
    assert [(r.doc_id, r.n_windows, r.item_windows, r.coverage) for r in got] == [(1, 53, 53, 1.0)]


def test_items_of_slots_are_found_by_their_values(spark):
    item = "count 3 9 27 81 243 729 2187 6561 19683"
    texts = [f"they say: {item}. and so on", "they say: count 2 4 8 16 32 64 128 256 512. and so on"]
    assert hits(D.contaminated(frame(spark, texts), bench(spark, item))) == {(0, 0): "exact"}
