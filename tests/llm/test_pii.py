import hashlib
import re

from foliospark.llm import pii

from .conftest import DOCS, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TEXTS = ["a@b.c, x.y+z@mail.example.com; @no.dot me@host a@b.c@d.e.f", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.255 256.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 4000000000000000000000000002", "+1 (499) 555-6503 +12 345 +1234567890123456 ++49 30 1234567", None, "", "é" * 50 + " ä@b.de q@é.fr 12@3.4", "x" * 600 + "@example.com " + "9" * 700, "١٢٣@x.yz 1٠2"]


def brute(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    out = [m.span() for m in EMAIL.finditer(text)], [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += ([m.span() for m in CARD.finditer(text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))], [m.span() for m in PHONE.finditer(text) if 9 <= len(only(m[0])) <= 15])
    return out


def test_base_spans_as_the_patterns_say(spark):
    rows = {r.doc_id: r for r in pii.extract(frame(spark, TEXTS)).collect()}
    for k, t in enumerate(TEXTS):
        want = brute(t or "")
        text = ",".join(f"{n}:{a}:{b}" for n, spans in zip(pii.KINDS, want, strict=True) for a, b in spans)
        r = rows[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want], t
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)


def test_contexts_of_seeds_find_more(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004", "4012 8888 8888 1881"]
    texts = [f"words {k} then the member card: {c} was used" for k, c in enumerate(cards)]
    texts += ["so the member card: AB-99/1234567 was used", "order 99887766 shipped today", "nothing here"]
    rows = {r.doc_id: r for r in pii.extract(frame(spark, texts)).collect()}
    at = texts[5].index("AB-99")
    assert rows[5].spans == f"found:{at}:{at + 13}"
    assert rows[6].spans == "" and rows[7].spans == ""
    masked = {r.doc_id: r for r in pii.mask(frame(spark, texts)).collect()}
    assert masked[5].text == "so the member card: [FOUND] was used" and masked[0].text == "words 0 then the member card: [CARD] was used"
    assert masked[0].n_chars == len(masked[0].text) and masked[7].text == "nothing here"


def test_masks_overlaps_once():
    assert pii.mask_text("ab1.2.3.4cd", "ip:2:9,card:4:10") == "ab[IP]d"
    assert pii.mask_text("x", "") == "x"


def test_edges(spark):
    assert pii.extract(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a@b.c", "en", "s", 5), (1, "a@b.c", "en", "s", 5), (2, None, None, None, None)], DOCS)
    assert sorted((r.doc_id, r.spans) for r in pii.extract(docs).collect()) == [(1, "email:0:5"), (1, "email:0:5"), (2, "")]
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and sorted((r.doc_id, r.text) for r in masked.collect()) == [(1, "[EMAIL]"), (1, "[EMAIL]"), (2, None)]
