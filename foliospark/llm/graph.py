"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v); component is the smallest node reachable.

    Each round is two partial minima and two equi-joins, written to the shared folder; rounds grow with the logarithm
    of the longest path. Loops and repeated edges do no harm; an empty table gives no rows.
    """
    now = common.materialize(edges.filter("u <> v").distinct(), "cc")
    seen = None
    for _ in range(MAX_ROUNDS):
        nxt = common.materialize(_small_star(_large_star(now)), "cc")
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        mark = (row["n"], row["h"])
        common.discard(now)
        now = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
