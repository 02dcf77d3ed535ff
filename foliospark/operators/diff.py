"""Line diffs: rows (pair_id, pos from 0, text) on two sides to edit scripts, hunks and reports.

Small pairs are aligned by longest common subsequence, per pair in pandas; pairs of more than ``max_cells`` cells
are trimmed: what is equal at both ends stays, the middle is replaced. Trimming is expressions alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CELLS = 25_000_000
CONTEXT = 3
SCRIPT = "pair_id long, seq long, kind string, a_pos long, b_pos long"


def intern(*sides: DataFrame) -> list[DataFrame]:
    """Each side with ``line_id``, equal for equal texts on any side."""
    words = sides[0].select("text")
    for s in sides[1:]:
        words = words.union(s.select("text"))
    ids = words.distinct().withColumn("line_id", F.xxhash64("text"))
    return [s.join(ids, "text") for s in sides]


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, a, b): lines of both sides in order; a side without lines is an empty array."""
    pack = lambda d, s: d.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x")).select("pair_id", F.col("x.text").alias(s))
    none = F.array().cast("array<string>")
    return pack(a, "a").join(pack(b, "b"), "pair_id", "full").select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))


def lcs_script(a: list, b: list) -> list[tuple[str, int, int]]:
    """Edit script of a longest common subsequence; where either step does, lines of a go first."""
    n, m = len(a), len(b)
    ids: dict = {}
    x = np.array([ids.setdefault(t, len(ids)) for t in a], np.int64)
    y = np.array([ids.setdefault(t, len(ids)) for t in b], np.int64)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        # From the right, each cell is the largest so far of what lies below and what the diagonals give.
        step = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :m] = np.maximum.accumulate(step[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(("=", i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1, j] >= best[i, j + 1]):
            out.append(("-", i, j))
            i += 1
        else:
            out.append(("+", i, j))
            j += 1
    return out


def lcs(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(p, k, *op) for p, a, b in zip(pdf["pair_id"], pdf["a"], pdf["b"], strict=True) for k, op in enumerate(lcs_script(list(a), list(b)))]
            yield pd.DataFrame(rows, columns=["pair_id", "seq", "kind", "a_pos", "b_pos"])

    return pairs.mapInPandas(run, SCRIPT)


def trim(pairs: DataFrame) -> DataFrame:
    """Edit script that replaces all between the equal start and the equal end."""
    n, m = F.size("a"), F.size("b")
    both = F.zip_with("a", "b", lambda x, y: F.when(x == y, F.lit(1)).otherwise(0))
    start = F.array_position(F.concat(both, F.array(F.lit(0))), 0).cast("int") - 1
    start = F.least(start, n, m)
    back = F.zip_with(F.reverse("a"), F.reverse("b"), lambda x, y: F.when(x == y, F.lit(1)).otherwise(0))
    end = F.array_position(F.concat(back, F.array(F.lit(0))), 0).cast("int") - 1
    sized = pairs.select("pair_id", n.alias("n"), m.alias("m"), start.alias("p"), F.least(end, n - start, m - start).alias("s"))
    run = lambda count, f: F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), f)).otherwise(F.array().cast("array<struct<kind:string,a_pos:bigint,b_pos:bigint>>"))
    op = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("a_pos"), j.cast("long").alias("b_pos"))
    c = F.col
    script = F.concat(
        run(c("p"), lambda k: op("=", k, k)),
        run(c("n") - c("s") - c("p"), lambda k: op("-", c("p") + k, c("p"))),
        run(c("m") - c("s") - c("p"), lambda k: op("+", c("n") - c("s"), c("p") + k)),
        run(c("s"), lambda k: op("=", c("n") - c("s") + k, c("m") - c("s") + k)),
    )
    return sized.select("pair_id", F.posexplode(script).alias("seq", "o")).select("pair_id", c("seq").cast("long").alias("seq"), "o.*")


def script(pairs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Edit script of every pair: kind = - +, with places on both sides from 0."""
    cells = (F.size("a").cast("long") + 1) * (F.size("b") + 1)
    return lcs(pairs.filter(cells <= max_cells)).unionByName(trim(pairs.filter(cells > max_cells)))


def hunks(ops: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Hunks of each pair's script: hunk (from 1), a_start, a_count, b_start, b_count, header.

    An operation belongs to a hunk if a change lies within ``context`` of it; hunks that touch are one. Pairs without
    changes have none.
    """
    w = Window.partitionBy("pair_id").orderBy("seq")
    change = F.when(F.col("kind") != "=", F.col("seq"))
    before, after = F.last(change, True).over(w), F.first(change, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = ops.withColumn("near", F.coalesce(F.col("seq") - before <= context, F.lit(False)) | F.coalesce(after - F.col("seq") <= context, F.lit(False))).filter("near")
    begun = near.withColumn("new", (F.coalesce(F.lag("seq").over(w), F.lit(-2)) + 1 != F.col("seq")).cast("int")).withColumn("hunk", F.sum("new").over(w))
    a, b = F.count_if(F.col("kind") != "+"), F.count_if(F.col("kind") != "-")
    h = begun.groupBy("pair_id", "hunk").agg(F.min("a_pos").alias("a0"), a.alias("a_count"), F.min("b_pos").alias("b0"), b.alias("b_count"))
    h = h.select("pair_id", "hunk", (F.col("a0") + (F.col("a_count") > 0).cast("int")).alias("a_start"), "a_count", (F.col("b0") + (F.col("b_count") > 0).cast("int")).alias("b_start"), "b_count")
    part = lambda s: F.concat(F.col(f"{s}_start").cast("string"), F.when(F.col(f"{s}_count") != 1, F.concat(F.lit(","), F.col(f"{s}_count").cast("string"))).otherwise(""))
    return h.withColumn("header", F.concat(F.lit("@@ -"), part("a"), F.lit(" +"), part("b"), F.lit(" @@")))


def report(ops: DataFrame, pairs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(pair_id, report): hunks as text; ``identical`` if there are none."""
    w = Window.partitionBy("pair_id").orderBy("seq")
    change = F.when(F.col("kind") != "=", F.col("seq"))
    before, after = F.last(change, True).over(w), F.first(change, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = ops.withColumn("near", F.coalesce(F.col("seq") - before <= context, F.lit(False)) | F.coalesce(after - F.col("seq") <= context, F.lit(False))).filter("near")
    begun = near.withColumn("new", (F.coalesce(F.lag("seq").over(w), F.lit(-2)) + 1 != F.col("seq")).cast("int")).withColumn("hunk", F.sum("new").over(w))
    line = F.concat(F.when(F.col("kind") == "=", " ").otherwise(F.col("kind")), F.when(F.col("kind") == "+", F.try_element_at("b", (F.col("b_pos") + 1).cast("int"))).otherwise(F.try_element_at("a", (F.col("a_pos") + 1).cast("int"))))
    body = begun.join(pairs, "pair_id").groupBy("pair_id", "hunk").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("x")).select("pair_id", "hunk", F.array_join(F.col("x.line"), "\n").alias("body"))
    whole = hunks(ops, context).join(body, ["pair_id", "hunk"]).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("hunk", F.concat_ws("\n", "header", "body").alias("t")))).alias("x")).select("pair_id", F.array_join(F.col("x.t"), "\n").alias("report"))
    return pairs.select("pair_id").join(whole, "pair_id", "left").select("pair_id", F.coalesce("report", F.lit("identical")).alias("report"))
