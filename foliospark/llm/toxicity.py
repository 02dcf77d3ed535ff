"""Toxicity by a convolutional text classifier: hashed embeddings, several filter widths, max pooling, in numpy.

A word is its lower-cased letters; its embedding is the sum of those of two hashed features, the word and its first
letters. Filters of each width slide over the words of the whole text; the largest answer of each filter goes to a
logistic output. Training (Adagrad, on the driver) uses a bounded, documented sample of labelled rows, drawn by a hash
of the id alone: ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` rows, weighted back to the share of labels in all labelled rows.
The first embedding dimension starts as smoothed log-odds of the feature, so that few rows are enough to begin with.
Every fifth row of the sample is held back to calibrate the output and to choose a threshold for each language;
neither language nor source nor id is an input of a score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import Words

MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
HASH_BITS = 24
PREFIX = 4
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
BATCH, UPDATES, RATE, DECAY = 32, 900, 0.05, 1e-5
THRESHOLD = 0.7
PAD = max(WIDTHS) - 1
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: bytes) -> tuple[int, int]:
    """Hashes of the word and of its first letters; 0 stands for none."""
    letters = _EDGE.sub("", word.decode("utf-8", "replace").lower())
    if not letters:
        return 0, 0
    mask = (1 << HASH_BITS) - 1
    return zlib.crc32(letters.encode()) & mask or 1, zlib.crc32(b"^" + letters[:PREFIX].encode()) & mask or 1


class FeatureWords(Words):
    """Both features of each word."""

    def reset(self):
        super().reset()
        self.table = np.zeros((0, 2), np.int64)

    def learn(self, fresh):
        self.table = np.vstack([self.table, np.array([features(w) for w in fresh], np.int64).reshape(-1, 2)])


def _sample_features(words: FeatureWords, part) -> dict:
    numbers, bounds = words.number([t.encode("utf-8", "replace").split() for t in common.texts_of(part)])
    rows = words.table[numbers].astype("<i4")
    return {"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "lang": part.column("lang"), "features": [rows[bounds[k] : bounds[k + 1]].tobytes() for k in range(part.num_rows)]}


class Model:
    """The trained classifier: keys (sorted features), rows of the embedding, filters and output."""

    def __init__(self, keys: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.keys = keys  # row k + 1 is that of keys[k]; row 0 is none
        self.table = np.zeros((len(keys) + 1, DIM), np.float32)
        self.table[1:, 1:] = rng.normal(0, 0.02, (len(keys), DIM - 1))
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0, : FILTERS // 2] = 0.5
        self.bias = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.shift, self.scale = np.float32(-2.0), 1.0

    def rows(self, hashed: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashed)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashed, at + 1, 0) if len(self.keys) else np.zeros(hashed.shape, np.int64)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, 0]] + self.table[rows[:, 1]]

    def lanes(self, hashed: np.ndarray) -> list[list[np.ndarray]]:
        """What each word adds to the filters of each width, at each place in the window."""
        x = self.embed(self.rows(hashed))
        return [[x @ f[j] for j in range(len(f))] for f in self.filters]

    def probability(self, logit):
        return 1.0 / (1.0 + np.exp(-np.clip(logit * self.scale, -30, 30)))


def padded(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words once every text is followed by PAD nulls (an empty text has one more in front)."""
    n = np.diff(bounds)
    size = np.maximum(n, 1) + PAD
    starts = np.cumsum(size) - size
    place = np.repeat(starts - bounds[:-1], n) + np.arange(bounds[-1])
    return place, starts, starts + np.maximum(n, 1)


def pool(z: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(z, np.stack([starts, ends], 1).ravel()[:-1] if ends[-1] == len(z) else np.stack([starts, ends], 1).ravel(), 0)[::2]


def _slide(parts: list[np.ndarray]) -> np.ndarray:
    z = parts[0].copy()
    for j in range(1, len(parts)):
        z[:-j] += parts[j][j:]
    return z


def _auto_batches(n: int, rng) -> list[np.ndarray]:
    order = rng.permutation(n)
    return [order[k : k + BATCH] for k in range(0, n, BATCH)]


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, updates: int = UPDATES, seed: int = 11) -> Model:
    """docs: features (words x 2) of each text."""
    counts: dict[int, list[int]] = {}
    for d, y in zip(docs, labels.tolist(), strict=True):
        for k in np.unique(d).tolist():
            counts.setdefault(k, [0, 0])[y] += 1
    counts.pop(0, None)
    keys = np.array(sorted(k for k, c in counts.items() if sum(c) >= 2), np.int64)
    model = Model(keys, seed)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    if len(keys):
        c = np.array([counts[k] for k in keys.tolist()], np.float64)
        odds = np.log((c[:, 1] + 0.2) / (n1 + 0.4)) - np.log((c[:, 0] + 0.2) / (n0 + 0.4))
        # Counts of one or two rows say little.
        model.table[1:, 0] = np.clip(odds * c.sum(1) / (c.sum(1) + 5.0), -1, 6)
    rows = [model.rows(d) for d in docs]
    params = [model.table, *model.filters, *model.bias, model.out]
    squares = [np.full(p.shape, 1e-3, np.float32) for p in params]
    shift_square, rng, done = 1e-3, np.random.default_rng(seed), 0

    def update(k, grad, at=slice(None)):
        squares[k][at] += grad * grad
        params[k][at] -= RATE * (grad / np.sqrt(squares[k][at]) + DECAY * params[k][at])

    while done < updates and docs:
        for batch in _auto_batches(len(docs), rng):
            n = np.array([len(rows[d]) for d in batch])
            bounds = np.concatenate([[0], np.cumsum(n)])
            place, starts, ends = padded(bounds)
            row = np.zeros((int(ends[-1]) + PAD, 2), np.int64)
            if bounds[-1]:
                row[place] = np.concatenate([rows[d] for d in batch])
            x = model.embed(row)
            tops, where = [], []
            for k, f in enumerate(model.filters):
                z = _slide([x @ f[j] for j in range(len(f))]) + model.bias[k]
                at = np.stack([z[a:b].argmax(0) + a for a, b in zip(starts, ends, strict=True)])
                where.append(at)
                tops.append(np.take_along_axis(z, at, 0))
            top = np.concatenate(tops, 1)
            hidden = np.maximum(top, 0)
            p = 1.0 / (1.0 + np.exp(-np.clip(hidden @ model.out + model.shift, -30, 30)))
            slope = ((p - labels[batch]) * weights[batch] / len(batch)).astype(np.float32)
            back = slope[:, None] * model.out[None, :] * (top > 0)
            touched, pushes = [], []
            for k, f in enumerate(model.filters):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    at = where[k] + j
                    grad[j] = np.einsum("bfd,bf->df", x[at], own)
                    push = own[:, :, None] * f[j].T[None]
                    for side in (0, 1):
                        touched.append(row[at, side].ravel())
                        pushes.append(push.reshape(-1, DIM))
                update(1 + k, grad)
                update(1 + len(WIDTHS) + k, own.sum(0))
            ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(ids), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(pushes))
            total[ids == 0] = 0
            update(0, total, ids)
            update(len(params) - 1, (slope[:, None] * hidden).sum(0))
            g = float(slope.sum())
            shift_square += g * g
            model.shift -= np.float32(RATE * g / np.sqrt(shift_square))
            done += 1
            if done >= updates:
                break
    return model


class Scorer(Words):
    """Scores texts; what a word adds to each filter is worked out once."""

    def __init__(self, model: Model):
        self.model = model
        super().__init__()

    def reset(self):
        super().reset()
        self.known = [[np.zeros((0, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]
        self.number([[b""]])  # number 0: the null word

    def learn(self, fresh):
        for old, new in zip(self.known, self.model.lanes(np.array([features(w) for w in fresh], np.int64).reshape(-1, 2)), strict=True):
            for j, lane in enumerate(new):
                old[j] = np.concatenate([old[j], lane])

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        numbers, bounds = self.number([t.encode("utf-8", "replace").split() for t in texts])
        place, starts, ends = padded(bounds)
        line = np.zeros(int(ends[-1]) + PAD, np.int32)
        line[place] = numbers
        logit = np.full(len(texts), self.model.shift, np.float64)
        for k, lanes in enumerate(self.known):
            z = _slide([lane[line] for lane in lanes])
            logit += np.maximum(pool(z, starts, ends) + self.model.bias[k], 0) @ self.model.out[k * FILTERS : (k + 1) * FILTERS]
        return self.model.probability(logit)


def calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scales the output so that it fits rows held back; returns their probabilities."""
    scorer = _DocScorer(model)
    logits = np.array([scorer.logit(d) for d in docs])
    if len(docs) and 0 < labels.sum() < len(labels):
        losses = []
        grid = (0.4, 0.6, 0.8, 1.0, 1.25, 1.5)
        for s in grid:
            p = np.clip(1 / (1 + np.exp(-np.clip(logits * s, -30, 30))), 1e-6, 1 - 1e-6)
            losses.append(float(-(weights * np.where(labels == 1, np.log(p), np.log(1 - p))).sum()))
        model.scale = grid[int(np.argmin(losses))]
    return model.probability(logits)


class _DocScorer:
    def __init__(self, model):
        self.model = model

    def logit(self, d: np.ndarray) -> float:
        m, n = self.model, max(1, len(d))
        line = np.zeros((n + PAD, 2), np.int64)
        line[: len(d)] = d
        x, out = m.embed(m.rows(line)), float(m.shift)
        for k, f in enumerate(m.filters):
            z = _slide([x @ f[j] for j in range(len(f))])[:n].max(0) + m.bias[k]
            out += float(np.maximum(z, 0) @ m.out[k * FILTERS : (k + 1) * FILTERS])
        return out


def thresholds(p: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """For each language the threshold of best F1 on rows held back; THRESHOLD where they lack either label."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        y, s = labels[own], p[own]
        best = (0.0, THRESHOLD)
        if 0 < y.sum() < len(y):
            for t in (0.7, 0.5, 0.6, 0.8, 0.9, 0.4, 0.3):
                hit = int(((s >= t) & (y == 1)).sum())
                f1 = 2 * hit / max(1, int((s >= t).sum()) + int(y.sum()))
                best = max(best, (f1, t), key=lambda x: x[0])
        out[lang] = best[1]
    return out


def held_out(doc_id):
    """Rows that learning never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> tuple[Model | None, dict[str, float]]:
    """A model from the labelled rows that aren't held out, and thresholds by language; None without both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    drawn = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(most) for y, most in ((1, max_positive), (0, max_negative))]
    ids = common.materialize(drawn[0].union(drawn[1]), "tox-sample")
    # At most max_positive + max_negative rows: a proven bound.
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = common.arrow_map(plain.join(F.broadcast(ids), "doc_id"), "doc_id long, toxic int, lang string, features binary", _sample_features, FeatureWords)
    got = sorted(rows.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["features"]))
    x = [np.frombuffer(r["features"], "<i4").reshape(-1, 2).astype(np.int64) for r in got]
    y = np.array([r["toxic"] for r in got], np.int64)
    if not 0 < y.sum() < len(y):
        return None, {}
    share = total[1] / (total[0] + total[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    # Rare labels still count enough to be learnt.
    weight = np.where(y == 1, np.maximum(weight, 0.5), weight)
    back = np.arange(len(y)) % 5 == 4
    keep = np.flatnonzero(~back)
    model = train([x[k] for k in keep], y[keep], weight[keep])
    at = np.flatnonzero(back)
    p = calibrate(model, [x[k] for k in at], y[at], weight[at])
    return model, thresholds(p, y[at], [got[k]["lang"] for k in at])


def score(docs: DataFrame, model: Model | None, by_lang: dict[str, float] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold and flagged (score at its language's threshold).

    Every whole text gets a score, empty and null ones that of no words; without a model (no labels of both kinds) it
    is 0. Repeated rows give a row each.
    """
    by_lang = by_lang or {}
    limits = F.lit(THRESHOLD)
    for lang, t in by_lang.items():
        limits = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limits)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), limits.cast("double").alias("lang_threshold"))

    def step(scorer, part):
        texts = common.texts_of(part)
        return {"doc_id": part.column("doc_id"), "score": scorer.score(texts) if scorer else np.zeros(len(texts)), "lang_threshold": part.column("lang_threshold")}

    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = common.arrow_map(plain, "doc_id long, score double, lang_threshold double", step, lambda: shared.value and Scorer(shared.value))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, common.table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
