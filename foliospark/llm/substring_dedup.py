"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes if it lies in a ``LENGTH``-byte string that also starts elsewhere. Sorting all suffixes would write many
times the corpus; only positions that can still matter are refined, by identifiers of buckets:

* The bucket of a position is the identifier of its ``Q``-gram. For every window of ``LENGTH`` bytes, the smallest
  identifier of a Q-gram inside it (the rightmost of equals) is its anchor. Equal windows have equal anchors at equal
  places, so windows whose anchor's bucket has one member are done. Anchors are about 1.5 % of the positions.
* Neighbouring windows with one anchor form a segment. Buckets of two or more are refined by the identifier of the
  segment's whole stretch: members of a stretch that occurs twice are repeated altogether.
* What is left - stretches that occur once, in a bucket of several - is refined by chunks of ``CHUNK`` windows, counted
  from the anchor. If the identifier of what all windows of a chunk share occurs once, none is repeated; if that of
  the chunk's whole stretch occurs twice, all are.
* Chunks in between are refined to the single window. A window's identifier is built from those of later offsets:
  ``id(2Q)`` at p from ``id(Q)`` at p and p+Q, ``id(LENGTH)`` from ``id(2Q)`` at p and at its last place, each level
  reusing the one before.

One member of each kind stands for its copies, with their number, so a bucket of thousands of copies costs what one
costs.

Identifiers are 64-bit hashes; windows are compared under (bucket, window) pairs of them. Counts are partial sums and
joins equi-joins, which AQE splits where one bucket holds many rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import mix64

LENGTH = 200
Q = 64
#: Window starts handled at once; bounds memory with very long texts.
BLOCK = 1 << 20
#: Windows of a chunk.
CHUNK = 16
BROADCAST_ROWS = 1_000_000

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if n > len(_powers.get("up", ())):
        size = 1 << max(14, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Ids:
    """Identifiers of substrings of one block of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=self.sums[1:])

    def grams(self, size: int, low: int, high: int) -> np.ndarray:
        """Identifiers of the strings of one size that start in [low, high)."""
        return mix64((self.sums[low + size : high + size] - self.sums[low:high]) * self.down[low:high])

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64(mix64((self.sums[ends] - self.sums[starts]) * self.down[starts]) + (ends - starts).astype(np.uint64))

    def windows(self, low: int, high: int, length: int, q: int) -> np.ndarray:
        """Identifiers of the windows that start in [low, high), from those of Q-grams at later offsets."""
        reach = high - low
        part = self.grams(q, low, high + length - q)
        size = q
        while 2 * size <= length:
            part = mix64(part[: len(part) - size] * np.uint64(3) + part[size:])
            size *= 2
        last = length - size
        return mix64(part[:reach] * np.uint64(5) + part[last : last + reach])


def segments(data: np.ndarray, length: int = LENGTH, q: int = Q):
    """Runs of windows with one anchor: (bucket, anchor, first window, last window, stretch), block by block."""
    n, width = len(data), length - q + 1
    for at in range(0, max(0, n - length + 1), BLOCK):
        own = data[at : at + BLOCK + length - 1]
        ids = Ids(own)
        grams = ids.grams(q, 0, len(own) - q + 1)
        # The upper half orders; the lower makes the rightmost of equals smallest.
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        anchor = 0xFFFFFFFF - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        last = np.append(first[1:] - 1, len(anchor) - 1)
        yield grams[anchor[first]], anchor[first] + at, first + at, last + at, ids.stretches(first, last + length)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def _segment_rows(length: int, q: int):
    def step(_, part) -> dict | None:
        out = {k: [] for k in ("bucket", "anchor", "first", "last", "stretch")}
        rows, counts = [], []
        for k, text in enumerate(part.column("text").to_pylist()):
            data = _bytes(text)
            for found in segments(data, length, q):
                for name, values in zip(out, found, strict=True):
                    out[name].append(values)
                rows.append(k)
                counts.append(len(found[0]))
        if not rows:
            return None
        who = np.repeat(rows, counts)
        joined = {k: np.concatenate(v) for k, v in out.items()}
        return {"doc_id": part.column("doc_id").take(pa.array(who)), "text_key": part.column("text_key").take(pa.array(who)), "bucket": joined["bucket"].view(np.int64), "anchor": joined["anchor"].astype(np.int32), "first": joined["first"].astype(np.int32), "last": joined["last"].astype(np.int32), "stretch": joined["stretch"].view(np.int64)}

    return step


def _chunk_rows(length: int):
    def step(_, part) -> dict | None:
        cols: dict = {k: [] for k in ("bucket", "chunk", "first", "last", "core", "stretch", "n")}
        who = []
        for k, (text, parts) in enumerate(zip(part.column("text").to_pylist(), part.column("parts").to_pylist(), strict=True)):
            data = _bytes(text)
            for p in parts:
                # Places in the segment's own bytes; windows start at ``anchor - offset``.
                low, own = p["first"], data[p["first"] : p["last"] + length]
                anchor, reach = p["anchor"] - low, p["last"] - low
                numbers = np.arange((anchor - reach) // CHUNK, anchor // CHUNK + 1)
                first, last = np.maximum(anchor - numbers * CHUNK - CHUNK + 1, 0), np.minimum(anchor - numbers * CHUNK, reach)
                ids = Ids(own)
                # What every window of the chunk holds, wherever the segment ends.
                core = ids.stretches(np.minimum(anchor - numbers * CHUNK, len(own)), np.minimum(anchor - numbers * CHUNK - CHUNK + 1 + length, len(own)))
                count = len(numbers)
                for name, values in (("bucket", np.full(count, p["bucket"], np.int64)), ("chunk", numbers), ("first", first + low), ("last", last + low), ("core", core.view(np.int64)), ("stretch", ids.stretches(first, last + length).view(np.int64)), ("n", np.full(count, p["n"], np.int64))):
                    cols[name].append(values)
                who.append(np.full(count, k))
        if not who:
            return None
        at = pa.array(np.concatenate(who))
        out = {name: np.concatenate(v) for name, v in cols.items()}
        return {"doc_id": part.column("doc_id").take(at), "text_key": part.column("text_key").take(at), **out, "chunk": out["chunk"].astype(np.int32), "first": out["first"].astype(np.int32), "last": out["last"].astype(np.int32)}

    return step


def _window_rows(length: int, q: int):
    def step(_, part) -> dict | None:
        cols: dict = {k: [] for k in ("bucket", "window", "at", "n")}
        who, counts = [], []
        for k, (text, parts) in enumerate(zip(part.column("text").to_pylist(), part.column("parts").to_pylist(), strict=True)):
            data = _bytes(text)
            for p in parts:
                own = data[p["first"] : p["last"] + length]
                found = Ids(own).windows(0, len(own) - length + 1, length, q)
                cols["window"].append(found)
                cols["at"].append(np.arange(p["first"], p["last"] + 1, dtype=np.int32))
                cols["bucket"].append(np.full(len(found), p["bucket"], np.int64))
                cols["n"].append(np.full(len(found), p["n"], np.int64))
                who.append(k)
                counts.append(len(found))
        if not who:
            return None
        at = pa.array(np.repeat(who, counts))
        return {"doc_id": part.column("doc_id").take(at), "text_key": part.column("text_key").take(at), "bucket": np.concatenate(cols["bucket"]), "window": np.concatenate(cols["window"]).view(np.int64), "at": np.concatenate(cols["at"]), "n": np.concatenate(cols["n"])}

    return step


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(keep: bool, part) -> dict:
    removed, spans, digest, kept = [], [], [], []
    for text, parts in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
        data, at, left = (text or "").encode("utf-8", "replace"), 0, []
        runs = merge([(p["first"], p["end"]) for p in parts])
        for a, b in runs:
            left.append(data[at:a])
            at = b
        rest = b"".join([*left, data[at:]])
        removed.append(len(data) - len(rest))
        spans.append(len(runs))
        digest.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest if keep else None)
    return {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_removed": removed, "n_spans": spans, "kept_sha256": digest, "kept": kept}


def repeated_spans(docs: DataFrame, length: int = LENGTH, q: int = Q) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, text_key, first, end) that cover what is repeated, and the texts of the documents they are in.

    docs: doc_id, text, text_key.
    """
    key = ["doc_id", "text_key"]
    every = common.materialize(common.arrow_map(docs, "doc_id long, text_key long, bucket long, anchor int, first int, last int, stretch long", _segment_rows(length, q)), "sub-segments")
    # Written first, so that both sides of the join are plain exchanges and AQE can split a large bucket.
    twice = common.materialize(every.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket"), "sub-twice")
    active = common.materialize(every.join(twice, "bucket"), "sub-active")
    common.discard(every)
    stretches = active.groupBy("bucket", "stretch").agg(F.count("*").alias("n"), F.min(F.struct(*key, "anchor", "first", "last")).alias("one"))
    stretches = common.materialize(stretches, "sub-stretches")
    whole = active.join(stretches.filter("n > 1").select("bucket", "stretch"), ["bucket", "stretch"]).select(*key, "first", (F.col("last") + length).alias("end"))
    # Buckets with stretches of one copy; each of their stretches sends one member on.
    open_ = stretches.groupBy("bucket").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("bucket")
    onward = stretches.join(open_, "bucket").select("one.*", "bucket", "n")
    ids = active.select(*key).distinct()
    texts = common.materialize(docs.join(common.bounded_broadcast(common.materialize(ids, "sub-ids"), BROADCAST_ROWS), key, "left_semi").distinct(), "sub-texts")
    parts = onward.groupBy(*key).agg(F.collect_list(F.struct("anchor", "first", "last", "bucket", "n")).alias("parts"))
    place = ["bucket", "chunk", "core"]
    chunks = common.materialize(common.arrow_map(texts.join(parts, key), "doc_id long, text_key long, bucket long, chunk int, first int, last int, core long, stretch long, n long", _chunk_rows(length)), "sub-chunks")
    kinds = common.materialize(chunks.groupBy(*place, "stretch").agg(F.sum("n").alias("n"), F.min(F.struct(*key, "first", "last")).alias("one")), "sub-kinds")
    in_twice = chunks.filter("n = 1").join(kinds.filter("n > 1").select(*place, "stretch"), [*place, "stretch"]).select(*key, "first", (F.col("last") + length).alias("end"))
    mixed = kinds.groupBy(*place).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select(*place)
    pieces = kinds.join(mixed, place).select("one.*", "bucket", "n")
    parts = pieces.groupBy(*key).agg(F.collect_list(F.struct("first", "last", "bucket", "n")).alias("parts"))
    windows = common.materialize(common.arrow_map(texts.join(parts, key), "doc_id long, text_key long, bucket long, window long, at int, n long", _window_rows(length, q)), "sub-windows")
    again = windows.groupBy("bucket", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("bucket", "window")
    single = windows.filter("n = 1").join(again, ["bucket", "window"]).select(*key, F.col("at").alias("first"), (F.col("at") + length).alias("end"))
    single = single.union(in_twice)
    return whole.union(single), texts


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, q: int = Q, keep_bytes: bool = True) -> DataFrame:
    """What is left of every document without the bytes of strings that occur twice or more.

    Null text is empty text. Repeated rows are copies of one another, each with a result. Documents shorter than
    ``length`` bytes keep all. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (null: the whole text, or
    keep_bytes is false).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    spans, texts = repeated_spans(plain, length, q)
    key = ["doc_id", "text_key"]
    grouped = spans.groupBy(*key).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    done = common.materialize(common.arrow_map(texts.join(grouped, key), "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string, kept binary", _cut, lambda: keep_bytes), "sub-cut")
    base = plain.select(*key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return base.join(done, key, "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLE: dict[str, str] = {}
