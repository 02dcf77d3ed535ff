"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (its documents end to end). Tokens are served in the order of virtual deadlines
``(j + 1/2) / share`` of the j-th token of a queue, ties by queue number. That is deficit round-robin with a
quantum of one token: after any number of tokens, every queue is within about one token of its share, and what a
queue lacks (its deficit) is carried from window to window. The order is a pure function of the queue totals, so
each task works out any window without the windows before it: the deficits are carried across partitions too.

Windows of ``capacity`` tokens are consecutive runs of that order. Within a window a queue's tokens lie together,
queues in order of number. Only the last window can be short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .words import WordBpe

CAPACITY = 4096
END_ID = 2
#: Of older callers; without effect.
MAX_QUEUES = 256
#: Bytes of text that are tokenised at once: the more, the more parts are looked up once only.
SLICE_BYTES = 3 << 19
#: Cells of the tables of (row, queue) that are held at once.
CELLS = 1 << 20
#: Rows of the (partition, queue) table up to which it is broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Mixture:
    """The service order of queues with given totals and shares."""

    def __init__(self, totals, shares=None, capacity: int = CAPACITY):
        self.totals = np.asarray(totals, np.int64)
        weights = np.asarray(self.totals if shares is None else shares, np.float64)
        weights = np.where(self.totals > 0, np.maximum(weights, 1e-12), 1.0)
        self.share = weights / weights[self.totals > 0].sum() if (self.totals > 0).any() else weights
        self.capacity, self.total = capacity, int(self.totals.sum())

    def deadline(self, queue, j):
        return (j + 0.5) / self.share[queue]

    def served(self, t: np.ndarray) -> np.ndarray:
        """Tokens of each queue with a deadline of at most t, for each t."""
        guess = np.floor(np.asarray(t)[:, None] * self.share[None, :] + 0.5).astype(np.int64)
        return np.clip(guess, 0, self.totals[None, :])

    def given(self, n: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first n of the order, for each n."""
        n = np.clip(np.asarray(n, np.int64), 0, self.total)
        low, high = np.zeros(len(n)), np.full(len(n), float(np.max(np.where(self.totals > 0, (self.totals + 1) / self.share, 0.0), initial=1.0)))
        # With the queues' own proportions, about n tokens are served by time n.
        near = self.served(n.astype(np.float64)).sum(1)
        if np.abs(near - n).max(initial=0) <= len(self.totals):
            count = self.served(n.astype(np.float64))
        else:
            for _ in range(70):
                mid = (low + high) / 2
                few = self.served(mid).sum(1) <= n
                low, high = np.where(few, mid, low), np.where(few, high, mid)
            count = self.served(low)
        rows = np.arange(len(n))
        queues = np.arange(len(self.totals))
        for _ in range(4 * len(self.totals) + 8):
            diff = n - count.sum(1)
            if not diff.any():
                break
            ahead = np.where(count < self.totals[None, :], self.deadline(queues[None, :], count), np.inf)
            behind = np.where(count > 0, self.deadline(queues[None, :], count - 1), -np.inf)
            # The first of the next tokens, or the last of those taken, one of a queue at most.
            up, down = ahead.argsort(1, kind="stable"), len(queues) - 1 - (-behind[:, ::-1]).argsort(1, kind="stable")
            some = queues[None, :]
            r, c = np.nonzero((some < diff[:, None]) & np.isfinite(np.take_along_axis(ahead, up, 1)))
            count[r, up[r, c]] += 1
            r, c = np.nonzero((some < -diff[:, None]) & np.isfinite(np.take_along_axis(behind, down, 1)))
            count[r, down[r, c]] -= 1
        # One token may stand on the wrong side of another after the steps above: swap until in order.
        while len(n):
            ahead = np.where(count < self.totals[None, :], self.deadline(queues[None, :], count), np.inf)
            behind = np.where(count > 0, self.deadline(queues[None, :], count - 1), -np.inf)
            a, b = ahead.argmin(1), len(queues) - 1 - behind[:, ::-1].argmax(1)
            x, y = ahead[rows, a], behind[rows, b]
            wrong = (x < y) | ((x == y) & (a < b))
            if not wrong.any():
                break
            count[rows[wrong], a[wrong]] += 1
            count[rows[wrong], b[wrong]] -= 1
        return count

    def rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The place in the order of the j-th token of a queue."""
        step = self.rows_at_once()
        return np.concatenate([self._rank(queue[k : k + step], j[k : k + step]) for k in range(0, max(len(j), 1), step)])

    def rows_at_once(self) -> int:
        return max(1, CELLS // max(len(self.totals), 1))

    def _rank(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        t = self.deadline(queue, j)
        queues = np.arange(len(self.totals))[None, :]
        count = np.clip(np.floor(t[:, None] * self.share[None, :] + 0.5).astype(np.int64), 0, self.totals[None, :])
        tie = queues < queue[:, None]

        def before(c):
            d = self.deadline(queues, c)
            return (d < t[:, None]) | ((d == t[:, None]) & tie)

        for _ in range(3):
            count = np.where((count > 0) & ~before(count - 1), count - 1, count)
        for _ in range(3):
            count = np.where((count < self.totals[None, :]) & before(count), count + 1, count)
        count[np.arange(len(j)), queue] = j
        return count.sum(1)

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray):
        """Cuts the runs [start, start + length) of queues at window bounds.

        Returns for each piece: run number, offset in the run, length, window, offset in the window.
        """
        some = np.flatnonzero(length > 0)
        if not len(some):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        q, s, n = queue[some], start[some], length[some]
        first, last = self.rank(q, s) // self.capacity, self.rank(q, s + n - 1) // self.capacity
        count = last - first + 1
        run = np.repeat(np.arange(len(some)), count)
        window = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        own, k, step = q[run], len(window), self.rows_at_once()
        low, high, offset = (np.zeros(k, np.int64) for _ in range(3))
        for c in range(0, k, step):
            part = slice(c, min(c + step, k))
            needed, at = np.unique(np.concatenate([window[part], window[part] + 1]), return_inverse=True)
            given, rows = self.given(needed * self.capacity), np.arange(part.stop - c)
            before, after = given[at[: len(rows)]], given[at[len(rows) :]]
            low[part], high[part] = before[rows, own[part]], after[rows, own[part]]
            size = after - before
            offset[part] = (np.cumsum(size, 1) - size)[rows, own[part]]
        a, b = np.maximum(low, s[run]), np.minimum(high, s[run] + n[run])
        offset += a - low
        keep = b > a
        return some[run[keep]], (a - s[run])[keep], (b - a)[keep], window[keep], offset[keep]


def _tokenise(vocabulary: str, end_id: int):
    schema = "pid int, queue string, before long, doc_id long, n long, ids binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        words, pid, so_far = WordBpe(vocabulary), TaskContext.get().partitionId(), {}
        for part in common.slices(batches, size=SLICE_BYTES):
            ids, bounds = words.tokens_of(common.texts_of(part))
            blobs, befores, counts = [], [], []
            queues = part.column("queue").to_pylist()
            for k, queue in enumerate(queues):
                blobs.append(ids[bounds[k] : bounds[k + 1]].astype("<u2").tobytes() + end_id.to_bytes(2, "little"))
                counts.append(int(bounds[k + 1] - bounds[k]) + 1)
                befores.append(so_far.get(queue, 0))
                so_far[queue] = befores[-1] + counts[-1]
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(queues), pa.int32()), pa.array(queues, pa.string()), pa.array(befores, pa.int64()), part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=names)

    return run, schema


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    shares: dict[str, float] | None = None,
    max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """Pack all documents into windows of at most ``capacity`` tokens.

    shares: target proportion of each source (others: 0); default the sources' own, so that all queues end together.
    When a queue runs dry, those that are left share its part. Every source is a queue of its own at any number of them;
    max_queues has no effect and is taken for older callers.

    Null text counts as empty (one piece: the end id); null source is a queue of its own; repeated ids are separate
    documents; an empty table gives no rows. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and source.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col else F.lit("")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), source.alias("queue"))
    run, schema = _tokenise(vocabulary, end_id)
    tokens = common.materialize(common.map_batches(plain, run, schema), "pack-tokens")

    parts = common.materialize(tokens.groupBy("pid", "queue").agg(F.sum("n").alias("n")), "pack-parts")
    lanes = parts.withColumn("lane", F.col("queue"))
    totals = {r["lane"]: r["n"] for r in lanes.groupBy("lane").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    number = {x: i for i, x in enumerate(names)}
    mixture = Mixture([totals[x] for x in names], [shares.get(x, 0.0) for x in names] if shares else None, capacity)
    # The rows of (partition, queue) in a lane follow one another: a running sum gives each its first token.
    base = lanes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("lane").orderBy("pid", "queue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("pid", "queue", "lane", "base")
    placed = tokens.join(common.bounded_broadcast(common.materialize(base, "pack-base"), BROADCAST_ROWS), ["pid", "queue"])

    out_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"

    def cut(_, part):
        queue = np.array([number[x] for x in part.column("lane").to_pylist()], np.int64)
        first = part.column("base").to_numpy(zero_copy_only=False) + part.column("before").to_numpy(zero_copy_only=False)
        n = part.column("n").to_numpy(zero_copy_only=False)
        doc, start, length, window, offset = mixture.pieces(queue, first, n)
        blobs, crcs = part.column("ids").to_pylist(), []
        wide = {}
        for d, a, size in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
            if d not in wide:
                wide = {d: np.frombuffer(blobs[d], "<u2").astype("<u4")}
            crcs.append(zlib.crc32(wide[d][a : a + size]))
        ids, sources = part.column("doc_id").to_pylist(), part.column("queue").to_pylist()
        where = doc.tolist()
        return {"doc_id": [ids[d] for d in where], "start": start, "length": length, "ids_crc32": crcs, "doc_tokens": n[doc], "sequence_id": window, "offset": offset, "source": [sources[d] for d in where]}

    return common.arrow_map(placed.select("doc_id", "queue", "lane", "base", "before", "n", "ids"), out_schema, cut)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
