"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern. Its spans are the seeds of a
bootstrap: every span, and every other token that looks like an identifier, has lexical patterns (the two words
before it; the words on both sides). Spark scores the graph of patterns and instances in rounds: a pattern's
confidence is the mean score of its distinct instances, shrunk where they are few; an instance's score is what its
patterns leave of the chance that none of them is right. Seeds keep a score of 1. Instances that end above
``ACCEPT`` through patterns of enough support are found spans. Only rows of identifier-like tokens enter the graph,
so it is a small fraction of the text; every step is a partial aggregation or an equi-join.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
FOUND = "found"
#: Rounds end when they accept no more; these at most, by far more than a chain of patterns needs.
MAX_ROUNDS = 25
#: A pattern needs this many distinct instances of a score of 1 (seeds, or promoted before).
MIN_SUPPORT = 3
SHRINK = 1.0
PATTERN_CONFIDENCE = 0.6
ACCEPT = 0.6
#: Characters of a context word, those nearest the span.
NEAR = 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_TOKEN_LEFT = re.compile(r"[A-Za-z0-9._/+-]+\Z")
_TOKEN_RIGHT = re.compile(r"[A-Za-z0-9._/+-]*")
_DIGITS = re.compile(r"\D+")
_NUMBER = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")
#: A local part or token longer than this is looked for in steps.
_STEP = 256


def _run_left(text: str, low: int, at: int, pattern: re.Pattern) -> int:
    """Where the run of a pattern's characters that ends before ``at`` starts, not before ``low``."""
    size = _STEP
    while True:
        a = max(low, at - size)
        m = pattern.search(text, a, at)
        start = m.start() if m else at
        if start > a or a == low:
            return start
        size *= 4


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping. Each @ is looked at once: whatever starts in the run before it leads to it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = _run_left(text, last, at, _LOCAL_END)
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Leftmost groups of four numbers in each dotted chain of numbers, found in one scan."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of KINDS."""
    return [emails(text) if "@" in text else [], ips(text) if "." in text else [], cards(text), phones(text) if "+" in text else []]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens of 6 characters or more with three digits or more that overlap no span in ``taken``."""
    out, done = [], 0
    taken = sorted(taken)
    k, reach = 0, 0
    for m in _DIGIT.finditer(text):
        if m.start() < done:
            continue
        a = _run_left(text, done, m.start(), _TOKEN_LEFT)
        b = _TOKEN_RIGHT.match(text, m.end()).end()
        done = b
        while b > a and text[b - 1] in "._/+-":
            b -= 1
        while a < b and text[a] in "._/+-":
            a += 1
        if b - a < 6 or len(_DIGITS.sub("", text[a:b])) < 3:
            continue
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def _word(w: str) -> str:
    return _NUMBER.sub("0", w.lower().strip(",.;!?\"'()[]")) or w.lower()


class Contexts:
    """The words of a text, to look up those beside a span. Of a longer word, NEAR characters nearest the span count."""

    def __init__(self, text: str):
        spans = [m.span() for m in _WORD.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in spans], [b for _, b in spans]

    def left(self, at: int) -> list[str]:
        k = bisect.bisect_left(self.starts, at)
        return [self.text[max(a, min(b, at) - NEAR) : min(b, at)] for a, b in zip(self.starts[max(0, k - 2) : k], self.ends[max(0, k - 2) : k], strict=True)]

    def right(self, at: int) -> list[str]:
        k = bisect.bisect_right(self.ends, at)
        return [self.text[max(a, at) : min(b, max(a, at) + NEAR)] for a, b in zip(self.starts[k : k + 1], self.ends[k : k + 1], strict=True)]


def patterns(contexts: Contexts, a: int, b: int) -> list[str]:
    left = [_word(w) for w in contexts.left(a)]
    right = [_word(w) for w in contexts.right(b)]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_BASE = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, seen array<struct<start:int,end:int,instance:string,seed:boolean,patterns:array<string>>>"


def _detect(_, part) -> dict:
    out: dict = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "base_sha256", "seen")}
    for text in common.texts_of(part):
        kinds = base_spans(text)
        for name, spans in zip(KINDS, kinds, strict=True):
            out[f"n_{name}"].append(len(spans))
        base = joined((k, a, b) for k, spans in zip(KINDS, kinds, strict=True) for a, b in spans)
        out["base_spans"].append(base)
        out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
        taken = [x for spans in kinds for x in spans]
        seen, others = [], candidates(text, taken)
        contexts = Contexts(text) if taken or others else None
        for spans, seed in ((taken, True), (others, False)):
            for a, b in spans:
                found = patterns(contexts, a, b)
                if found:
                    seen.append({"start": a, "end": b, "instance": hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest(), "seed": seed, "patterns": found})
        out["seen"].append(seen)
    return {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), **out}


def detect_base(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Base spans of every whole text, and the identifier-like tokens with their patterns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return common.arrow_map(plain, _BASE, _detect)


def bootstrap(base: DataFrame, rounds: int = MAX_ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, text_key, found): spans of discovered identifiers as ``found:start:end``, sorted."""
    seen = base.select("doc_id", "text_key", F.explode("seen").alias("s")).select("doc_id", "text_key", "s.*")
    rows = seen.select("doc_id", "text_key", "start", "end", "seed", "instance", "patterns")
    edges = common.materialize(rows.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("seed").alias("seed")), "pii-edges")
    # Only patterns of a seed can pass a score on in the first round, and only their instances in later ones.
    scores = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    accepted = None
    for _ in range(rounds):
        strength = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count("*").alias("n"), F.sum((F.col("score") >= accept).cast("long")).alias("support"))
        strong = strength.filter(F.col("support") >= MIN_SUPPORT).select("pattern", F.round(F.col("sum") / (F.col("n") + SHRINK), 9).alias("confidence")).filter(F.col("confidence") >= PATTERN_CONFIDENCE)
        # A pattern that no seed carries gives 0; seeds stay at 1.
        scored = edges.join(strong, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.log(1.0 - F.coalesce("confidence", F.lit(0.0)) * 0.999)).alias("miss"))
        scores = common.materialize(scored.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.round(1.0 - F.exp("miss"), 9)).alias("score")), "pii-scores")
        now = scores.agg(F.count_if(F.col("score") >= accept).alias("n")).first()["n"]
        if now == accepted:
            break
        accepted = now
    good = scores.filter(F.col("score") >= accept)
    hits = rows.filter(~F.col("seed")).join(good, "instance", "left_semi").select("doc_id", "text_key", "start", "end").distinct()
    return hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x")).select("doc_id", "text_key", F.transform("x", lambda s: F.format_string(f"{FOUND}:%d:%d", s["start"], s["end"])).alias("found"))


def extract(docs: DataFrame, id_col="doc_id", text_col="text", rounds: int = MAX_ROUNDS) -> DataFrame:
    """All spans of every document: those of the base, then those found.

    Null text is empty text, with no spans. Offsets are code points, ends exclusive. Kinds may overlap one another;
    found spans overlap none. Repeated rows give a row each, rows without an id too. Texts of any length are scanned
    in time proportional to them. An empty table gives no rows.
    """
    base = common.materialize(detect_base(docs, id_col, text_col), "pii-base")
    found = bootstrap(base, rounds)
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "found")
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left").select("doc_id", "text_key", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(F.concat(F.filter(F.array("base_spans"), lambda s: s != ""), F.coalesce("found", F.array().cast("array<string>"))), ",").alias("spans"))


def mask_text(text: str, spans: str) -> str:
    """Text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not spans:
        return text
    parts = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    out, at, end = [], 0, -1
    for a, b, kind in parts:
        b = -b
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], f"[{kind.upper()}]"]
        end = b
    return "".join(out) + text[end:]


def mask(docs: DataFrame, id_col="doc_id", text_col="text", length_col="n_chars") -> DataFrame:
    """docs with its texts masked and their lengths, if it has them, counted anew; all else stays."""
    spans = extract(docs, id_col, text_col).filter("spans <> ''").select("doc_id", "text_key", "spans").distinct()
    right = common.bounded_broadcast(common.materialize(spans, "pii-spans"), 50_000)
    at, names = docs.columns.index(text_col), docs.columns
    # The row stays whole in a column of its own, so that none of its names can clash.
    put = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("row_key"))
    met = put.join(right, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("text_key")), "left")
    joined_ = met.select(*[F.col("row")[c].alias(c) for c in names], F.col("spans").alias("_" * (1 + max(map(len, names)))))

    def run(batches):
        for batch in common.slices(batches):
            marks = batch.column(len(names)).to_pylist()
            cols = [batch.column(k) for k in range(len(names))]
            if any(marks):
                cols[at] = pa.array([t if t is None or not m else mask_text(t, m) for t, m in zip(cols[at].to_pylist(), marks, strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    masked = common.map_batches(joined_, run, docs.schema)
    if length_col in names:
        masked = masked.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return masked


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
