"""Near-duplicates by an LSH forest: Jaccard of word shingles, every link confirmed on full sets.

A document's signature is ``TREES`` sequences of ``DEPTH`` min-hashes. A tree is an order of the documents, sorted by
their sequence; documents with a long common prefix stand next to one another in it.

1. Documents of equal shingle sets are one class; from here on a class is its smallest document.
2. Rounds over all orders: each document and those shortly before it (``WINDOWS``) are candidates, if their common
   prefix is long enough and they are in different components. Candidates whose signatures agree are
   confirmed, links merge components, and the next round's neighbours are those of other components. A region of near copies thus costs a
   few pairs for each member and order. An order is dealt out by ranges of the whole sort key, so no run, however
   large, lands in one task.
3. What is left is whole: documents of different components that share a run (``SHALLOW`` equal hashes). Runs of more
   than ``MAX_RUN`` members go deeper, with the more trees the deeper (``LEVELS``), so depth follows the density of
   the region; at the last level no size is too large. Levels are few, as each one costs a document of a dense region
   a row for every tree of it, and going deeper than the last saves less in comparisons than its trees cost. Members of a run meet in an equi-join whose condition compares
   sketches of ``BITS`` one-bit min-hashes and holds for the first shared run only, so that neither pairs far from
   0.75 nor repetitions become rows; what is left is confirmed.

Two documents of similarity 0.75 share no run with probability 2e-8 at the first level, 3e-7 at the last; the sketches' cut of 4.5 standard deviations loses 4e-6 of such pairs (closer ones: less).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components
from .words import mix64, word_hashes

WORDS = 5
PERCENT = 75
TREES, DEPTH, SHALLOW = 32, 4, 3
#: Depth and number of trees, for documents of runs that were too large at the level before.
LEVELS = ((4, 40),)
MAX_RUN = 512
#: For each round: places in the orders that it looks back, and the least common prefix, longer for farther looks.
WINDOWS = ((1, 3), (4, 4))
SIGNATURE = TREES * DEPTH
DEVIATIONS = 4.5
#: Hashes of SIGNATURE that agree in all but the last 3e-6 of pairs of similarity 0.75.
LEAST_AGREED = int(SIGNATURE * 0.75 - DEVIATIONS * (SIGNATURE * 0.75 * 0.25) ** 0.5)
#: Bits of two documents of similarity s are equal with probability (1 + s) / 2.
BITS, FIRST_BITS = 2048, 512
LEAST_EQUAL, LEAST_FIRST = (int(n * 0.875 - DEVIATIONS * (n * 0.875 * 0.125) ** 0.5) for n in (BITS, FIRST_BITS))
BROADCAST_ROWS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Numbers that are worked on at once.
_CELLS = 1 << 18


class MinHashes:
    """The least of each of ``n`` linear permutations of 32-bit numbers over a set."""

    def __init__(self, n: int, seed: int):
        random = np.random.default_rng(seed)
        self.a = random.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = random.integers(0, 1 << 32, n, dtype=np.uint32)
        self.block = max(1, _CELLS // n)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), self.block):
            x = np.multiply.outer(self.a, short[at : at + self.block])
            x += self.b[:, None]
            np.minimum(out, x.min(1), out=out)
        return out


@functools.cache
def hashes_for(name: str, n: int) -> MinHashes:
    """The permutations of a purpose; the same in every process."""
    return MinHashes(n, sum(name.encode()) * 1_000_003 + n)


def shingles_of(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words than WORDS are one shingle."""
    words, bounds = word_hashes(texts, fold=True)
    h = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        h = h * _STEP + words[k : len(h) + k]
    h, out = mix64(h), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(h[a : b - WORDS + 1]))
        else:
            one = np.full(min(1, b - a), b - a, np.uint64)
            for w in words[a:b]:
                one = one * _STEP + w
            out.append(mix64(one))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    return hashes_for("signature", SIGNATURE)(shingles).view(np.int32)


def bits(shingles: np.ndarray) -> np.ndarray:
    """One bit of each of BITS min-hashes, as 64-bit numbers."""
    low = mix64(hashes_for("bits", BITS)(shingles).astype(np.uint64))
    return np.packbits((low & np.uint64(1)).astype(np.uint8)).view(np.int64)


def level_keys(shingles: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """The run of a document in each tree of a level."""
    low = hashes_for(f"level {depth}", depth * trees)(shingles).reshape(trees, depth).astype(np.uint64)
    key = np.arange(trees, dtype=np.uint64) * np.uint64(64) + np.uint64(depth)
    for k in range(depth):
        key = mix64(key * _STEP + low[:, k])
    return key.view(np.int64)


def _sets_of(part) -> list[np.ndarray]:
    return shingles_of([t.encode("utf-8", "replace") for t in common.texts_of(part)])


def _sketch(_, part) -> dict:
    import xxhash

    sets = _sets_of(part)
    digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    return {"doc_id": part.column("doc_id"), "n_shingles": [len(s) for s in sets], "digest": digest, "sig": [signature(s) if len(s) else None for s in sets]}


def _full(_, part) -> dict:
    return {"doc_id": part.column("doc_id"), "shingles": [s.view(np.int64) for s in _sets_of(part)]}


def _stored(part):
    column = part.column("shingles")
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])


def _bits(_, part) -> dict:
    rows = np.stack([bits(s) for s in _stored(part)])
    first = FIRST_BITS // 64
    return {"doc_id": part.column("doc_id"), **{f"b{j}": rows[:, j] for j in range(first)}, "more": list(rows[:, first:])}


def _level(depth: int, trees: int):
    return lambda _, part: {"doc_id": part.column("doc_id"), "own": [level_keys(s, depth, trees) for s in _stored(part)]}


def _agreed(a, b):
    """Places at which two arrays are equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _of_size(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _neighbours(order: DataFrame, window: int, prefix: int) -> DataFrame:
    """Pairs (a, b) of neighbours in the sorted orders whose components differ. Those that stand at the bounds of two
    partitions are left to what follows the rounds."""
    key = ["tree", *[f"h{k}" for k in range(DEPTH)], "comp", "doc_id"]

    def run(batches):
        last = None
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "n_shingles")])
            if not len(rows):
                continue
            done = 0 if last is None else len(last)
            if done:
                rows = np.vstack([last, rows])
            last, found = rows[-window:], []
            for back in range(1, min(window, len(rows) - 1) + 1):
                new = max(done, back)
                x, y = rows[new - back : len(rows) - back], rows[new:]
                small, large = np.minimum(x[:, -1], y[:, -1]), np.maximum(x[:, -1], y[:, -1])
                near = (x[:, : prefix + 1] == y[:, : prefix + 1]).all(1) & (x[:, -3] != y[:, -3]) & (100 * small >= PERCENT * large)
                found.append(np.sort(np.column_stack([x[near, -2], y[near, -2]]), 1))
            if found:
                ids = np.unique(np.vstack(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["a", "b"])

    dealt = order.select(*key, "n_shingles").repartitionByRange(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked by their full sets, as (u, v)."""
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    y = x.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    sized = y.select(F.col("a").alias("u"), F.col("b").alias("v"), both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return common.materialize(sized.filter(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("u", "v"), "near-links")


def _placed(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("doc_id"))
    return rows.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def _stars(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    return links if comps is None else links.union(comps.filter("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v")))


def _order(classes: DataFrame) -> DataFrame:
    """A row for each tree and class that shares a run there: the tree's hashes, the run, and the size of the set."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = classes.select("doc_id", "n_shingles", "sig", tree.alias("tree")).select("doc_id", "n_shingles", "tree", *[F.get("sig", F.col("tree") * DEPTH + k).alias(f"h{k}") for k in range(DEPTH)])
    rows = rows.withColumn("key", F.xxhash64("tree", *[f"h{k}" for k in range(SHALLOW)]))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return common.materialize(rows.join(shared, "key"), "near-order")


def _merged(order: DataFrame, signatures: DataFrame, sets: DataFrame, windows: tuple) -> tuple[DataFrame | None, DataFrame | None]:
    """Components after some rounds of neighbours, and the pairs (a, b) that were compared."""
    comps, seen = None, None
    for window, prefix in windows:
        pairs = _neighbours(_placed(order, comps), window, prefix)
        pairs = common.materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "near-neighbours")
        if pairs.isEmpty():
            break
        seen = pairs if seen is None else seen.union(pairs)
        alike = pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(signatures.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        links = _confirmed(alike.filter(_agreed("sig_a", "sig_b") >= LEAST_AGREED).select("a", "b"), sets)
        if not links.isEmpty():
            comps = common.materialize(components(_stars(comps, links)), "near-components")
    return comps, seen


def _rest(order: DataFrame, comps: DataFrame | None, sets: DataFrame, max_run: int) -> DataFrame:
    """All pairs (a, b) of different components that share a run and whose sketches are near."""
    leaves, rows = [], _placed(order, comps).select("doc_id", "n_shingles", "comp", "key")
    for deeper in (*LEVELS, None):
        runs = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key", "size")
        mixed = common.materialize(rows.join(runs, "key"), "near-runs")
        # A document's runs, to tell the first that a pair shares from the others.
        trace = mixed.groupBy("doc_id").agg(F.collect_set("key").alias("trace"))
        leaf = mixed.filter(F.col("size") <= max_run) if deeper else mixed
        leaves.append(leaf.join(trace, "doc_id").select("key", "doc_id", "comp", "n_shingles", "trace"))
        dense = mixed.filter(F.col("size") > max_run).select("doc_id", "comp", "n_shingles").distinct()
        if not deeper or dense.isEmpty():
            break
        keys = common.arrow_map(sets.join(dense.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id long, own array<long>", _level(*deeper))
        rows = dense.join(keys, "doc_id").select("doc_id", "n_shingles", "comp", F.explode("own").alias("key"))
    leaf = common.materialize(functools.reduce(DataFrame.union, leaves), "near-leaves")
    names = [f"b{j}" for j in range(FIRST_BITS // 64)]
    sketches = common.materialize(common.arrow_map(sets.join(leaf.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", more array<long>", _bits), "near-bits")
    rows = common.materialize(leaf.join(sketches, "doc_id"), "near-leaf-bits")
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "comp", "n_shingles", "trace", *names, "more")]) for s in "ab")
    unequal = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{n}_a").bitwiseXOR(F.col(f"{n}_b"))) for n in names])
    more = F.aggregate(F.zip_with("more_a", "more_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    alike = (unequal <= FIRST_BITS - LEAST_FIRST) & (unequal + more <= BITS - LEAST_EQUAL)
    first = F.array_min(F.array_intersect("trace_a", "trace_b")) == a["key"]
    near = (a["key"] == b["key"]) & (F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("comp_a") != F.col("comp_b")) & _of_size("n_shingles_a", "n_shingles_b") & alike & first
    return common.materialize(a.join(b, near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct(), "near-pairs")


def link(docs: DataFrame, id_col="doc_id", text_col="text", max_run: int = MAX_RUN, windows: tuple = WINDOWS) -> DataFrame:
    """n_shingles, component_id and kept of every document.

    Null, empty and blank texts have no shingles and are alone. Repeated rows give a row each (rows that share an id
    are one node, and kept together). A row whose id is null is linked with nothing and kept; its component is null. A
    text of any length is one row of the work. An empty table gives no rows; other columns are not looked at.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = common.materialize(common.arrow_map(plain, "doc_id long, n_shingles long, digest binary, sig array<int>", _sketch), "near-sketch")
    named = sketch.filter("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = common.materialize(sketch.select("doc_id", "n_shingles", "digest").join(reps, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "near-members")
    classes = named.join(members.filter("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sig")
    # Rows that share an id can differ in text; they are one node.
    equal = members.filter("rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).distinct()

    order = _order(classes)
    met = common.materialize(order.select("doc_id").distinct(), "near-ids")
    signatures = common.materialize(classes.join(met, "doc_id", "left_semi").select("doc_id", "sig"), "near-signatures")
    sets = common.materialize(common.arrow_map(plain.join(common.bounded_broadcast(met, BROADCAST_ROWS), "doc_id", "left_semi"), "doc_id long, shingles array<long>", _full), "near-sets")
    comps, edges = None, equal
    if not met.isEmpty():
        comps, seen = _merged(order, signatures, sets, windows)
        pairs = _rest(order, comps, sets, max_run)
        if seen is not None:
            pairs = common.materialize(pairs.join(seen, ["a", "b"], "left_anti"), "near-left")
        if not pairs.isEmpty():
            edges = equal.union(_confirmed(pairs, sets))
    common.discard(sets)
    final = common.materialize(components(_stars(comps, edges)), "near-final").withColumnRenamed("node", "doc_id")
    out = members.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """docs without all but the smallest of each component; of rows that share an id, the one of the least text stays.

    Ties between rows that share id and text go to the least of the other columns, in their order. Rows without an id
    all stay.
    """
    gone = common.materialize(link(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    kept = docs.join(common.bounded_broadcast(gone, BROADCAST_ROWS), docs[id_col].cast("long") == gone["__gone"], "left_anti")
    repeated = docs.filter(docs[id_col].isNotNull()).groupBy(id_col).count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    one = kept.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.min(F.struct(text_col, *rest)).alias("__row"))
    return one.select(*[F.col(id_col) if c == id_col else F.col("__row")[c].alias(c) for c in docs.columns]).union(kept.filter(F.col(id_col).isNull()))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLE: dict[str, str] = {}
