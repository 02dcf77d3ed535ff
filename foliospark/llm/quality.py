"""Quality rules by tokeniser fertility.

A public sub-word vocabulary shows how far a text is from the language it was made for: junk needs more tokens per
character (symbols, shouting), falls back to bytes, or repeats few tokens. Three figures per document:

* ``chars_per_token``: code points in words per token;
* ``byte_share``: share of tokens that are byte fallbacks;
* ``token_entropy``: mean entropy of its runs of ``RUN`` tokens (the last ends with the text), over the most that a
  run can have. Runs of one length make long and short texts comparable.

A document is rejected if a figure lies outside the band of its language and size class (powers of two of its
tokens: the figures of short texts scatter more). Bands are Tukey fences over all documents that pass the base rules:
quartiles less or plus ``FENCE`` times the inter-quartile range (which counts as ``LEAST`` of the median at least).
Classes of under ``LEAST_DOCS`` documents use their language's band. Quartiles are exact, of figures rounded to
``STEP`` decimals, so that counting needs a bounded map for each class. Languages are the values of the language
column; where it is null, the script of most letters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import PieceWords

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 2.5
LEAST = 0.02
RUN = 100
LEAST_DOCS = 30
#: Texts of 2**this tokens or more are one size class.
LAST_CLASS = 13
BROADCAST_ROWS = 100_000
STEP = 3  # decimals
METRICS = ("chars_per_token", "byte_share", "token_entropy")
#: Byte share has a spread of nearly zero in clean text: its band is this wide at least.
LEAST_BYTE_SHARE = 0.02
SYMBOLS = b"#*$%&|<>"

SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Code points of a byte: none for continuation bytes and white space.
_CHAR = ~_SPACE
_CHAR[0x80:0xC0] = False


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(numbers: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(numbers)
    if n < 4:
        return 0
    x = numbers.astype(np.int64)
    if x.max() >= 1 << 21:
        x = np.unique(x, return_inverse=True)[1]
    if x.max() < 1 << 21:  # three numbers fit one
        keys = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
        order = np.argsort(keys)
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
    else:
        order = np.lexsort((x[2:], x[1:-1], x[:-2]))
        same = np.ones(len(order) - 1, bool)
        for k in range(3):
            ranked = x[order + k]
            same &= ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for k in range(3):
        twice[starts + k] = True
    return int(twice.sum())


_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))


def script(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = [(int(((points >= a) & (points <= b)).sum()), name) for name, a, b in _SCRIPTS]
    best = max(counts, key=lambda x: x[0])
    return f"script:{best[1]}" if best[0] else "script:none"


def run_entropy(tokens: np.ndarray) -> float:
    """Mean entropy of the runs of RUN tokens, between 0 and 1."""
    n = len(tokens)
    if n < 2:
        return 0.0
    size = min(RUN, n)
    runs = tokens[: n // size * size].reshape(-1, size)
    if n % size:
        runs = np.vstack([runs, tokens[-size:]])
    runs = np.sort(runs, 1)
    fresh = np.ones(runs.shape, bool)
    fresh[:, 1:] = runs[:, 1:] != runs[:, :-1]
    first = np.flatnonzero(fresh.ravel())
    counts = np.diff(np.append(first, fresh.size))
    return 1.0 - float((counts * np.log(counts)).sum()) / fresh.size / float(np.log(size))


def _measure(words: PieceWords, part) -> dict:
    texts = common.texts_of(part)
    raw = [t.encode("utf-8", "replace") for t in texts]
    split = [x.split() for x in raw]
    numbers, bounds = words.number(split)
    lengths = words.length.data[numbers]
    from .words import spread

    ids = words.flat.data[spread(words.start.data[numbers], lengths)]
    ends = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    ends = ends[bounds]
    out: dict = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "token_entropy")}
    for k, data in enumerate(raw):
        own, tokens = numbers[bounds[k] : bounds[k + 1]], ids[ends[k] : ends[k + 1]]
        view = np.frombuffer(data, np.uint8)
        chars, n = int(_CHAR[view].sum()), len(tokens)
        out["n_words"].append(len(own))
        out["word_chars"].append(chars)
        out["n_symbols"].append(int(_SYMBOL[view].sum()))
        out["n_dup_lines"].append(duplicate_lines(data))
        out["n_repeat_words"].append(repeated_words(own))
        out["n_tokens"].append(n)
        out["chars_per_token"].append(chars / n if n else 0.0)
        out["byte_share"].append(float(words.is_byte[tokens].sum()) / n if n else 0.0)
        out["token_entropy"].append(run_entropy(tokens))
    langs = part.column("lang").to_pylist()
    return {"doc_id": part.column("doc_id"), "lang": [x if x is not None else script(t) for x, t in zip(langs, texts, strict=True)], **out}


def measure(docs: DataFrame, id_col="doc_id", text_col="text", lang_col: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """The base figures and the fertility figures of every whole text. Null text: no words, all figures zero."""
    vocabulary = vocabulary or default_vocabulary()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return common.arrow_map(plain, SCHEMA, _measure, lambda: PieceWords(vocabulary))


def bands(figures: DataFrame, keys: list[str], fence: float = FENCE, least_docs: int = 1) -> DataFrame:
    """A row for each value of the keys: the lowest and highest figure that is kept."""
    least = {m: F.lit(LEAST) * F.col(f"{m}_q")[1] for m in METRICS} | {"byte_share": F.lit(LEAST_BYTE_SHARE)}
    q = figures.groupBy(*keys).agg(F.count("*").alias("band_docs"), *[F.percentile(F.round(m, STEP), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{m}_q") for m in METRICS])
    out = []
    for m in METRICS:
        spread = F.greatest(F.col(f"{m}_q")[2] - F.col(f"{m}_q")[0], least[m])
        out += [(F.col(f"{m}_q")[0] - fence * spread).alias(f"{m}_low"), (F.col(f"{m}_q")[2] + fence * spread).alias(f"{m}_high")]
    return q.filter(F.col("band_docs") >= least_docs).select(*keys, F.struct(*out).alias("_".join(keys) + "_band"))


def _bounded(rows: DataFrame) -> DataFrame:
    """A language can hold most documents: where the bands are few, no row is moved to meet them."""
    return common.bounded_broadcast(common.materialize(rows, "quality-bands"), BROADCAST_ROWS)


def judge(docs: DataFrame, id_col="doc_id", text_col="text", lang_col: str | None = "lang", vocabulary: str | None = None, fence: float = FENCE) -> DataFrame:
    """Figures, base verdict and verdict of every document.

    Repeated ids are judged one by one. Empty and null texts have no words and fail the base rules. A document of a
    language none of whose documents pass the base rules fails them itself, so every judged one has a band.
    """
    figures = common.materialize(measure(docs, id_col, text_col, lang_col, vocabulary), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    figures = figures.withColumn("base_failed", failed)
    figures = figures.withColumn("size", F.least(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))), F.lit(LAST_CLASS)))
    passed = figures.filter("not base_failed")
    joined = figures.join(_bounded(bands(passed, ["lang"], fence)), "lang", "left").join(_bounded(bands(passed, ["lang", "size"], fence, LEAST_DOCS)), ["lang", "size"], "left")
    joined = joined.withColumn("band", F.coalesce("lang_size_band", "lang_band"))
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.col(m).between(F.col(f"band.{m}_low"), F.col(f"band.{m}_high"))
    return joined.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "n_tokens", *METRICS)


def keep(docs: DataFrame, id_col="doc_id", text_col="text", lang_col: str | None = "lang", **options) -> DataFrame:
    """docs without those that are rejected. An id stays with all its rows if one of them is kept."""
    verdicts = judge(docs, id_col, text_col, lang_col, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = common.materialize(verdicts.filter("not kept").select(F.col("doc_id").alias("__gone")), "quality-gone")
    return docs.join(common.bounded_broadcast(gone, 10 * BROADCAST_ROWS), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality": op4_quality}
ORACLE: dict[str, str] = {}
