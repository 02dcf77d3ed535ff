"""Names of transferred files, numbers as text, and characters in use."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of a name, bytes of an ending beside a number, files of a transfer.
NAME_BYTES, ENDING_BYTES, MAX_FILES = 255, 64, 1000


def is_file_name(name: Column) -> Column:
    """Neither empty nor a folder step, without slashes and zero bytes, at most NAME_BYTES in UTF-8."""
    return F.coalesce((name != "") & ~name.isin(".", "..") & ~F.regexp_like(name, F.lit(r"[\\/\x00]")) & (F.octet_length(name) <= NAME_BYTES), F.lit(False))


def cut_bytes(text: str, most: int) -> str:
    """The longest beginning of at most ``most`` UTF-8 bytes that ends between two characters."""
    return text.encode()[: max(0, most)].decode("utf-8", "ignore")


def distinct_names(names: list[str]) -> list[str]:
    """The names in order; one that is taken gets the first free number, from 2, and is cut to fit."""
    used: set[str] = set()
    out = []
    for name in names:
        stem, dot, end = name.rpartition(".")
        base, ending = (stem, dot + end) if stem else (name, "")
        free, n = name, 1
        while free in used:
            n += 1
            number = f" ({n})"
            tail = cut_bytes(ending, min(ENDING_BYTES, NAME_BYTES - len(number)))
            free = cut_bytes(base, NAME_BYTES - len(number) - len(tail.encode())) + number + tail
        used.add(free)
        out.append(free)
    return out


def transfer_names(files: DataFrame) -> DataFrame:
    """(transfer, file_no, name) with the safe_name that each file is saved as.

    A transfer of more than MAX_FILES files, or with a name that is none, gets null names: no group larger than
    MAX_FILES reaches Python.
    """
    size = files.groupBy("transfer").agg((F.count("*") <= MAX_FILES).alias("few"), F.every(is_file_name(F.col("name"))).alias("named"))
    rows = files.select("transfer", "file_no", "name").join(size, "transfer")

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("file_no")
        return group.assign(safe_name=distinct_names(list(group["name"])))[["transfer", "file_no", "name", "safe_name"]]

    kinds = dict(files.dtypes)
    schema = f"transfer {kinds['transfer']}, file_no {kinds['file_no']}, name string, safe_name string"
    good = rows.filter("few and named").groupBy("transfer").applyInPandas(number, schema)
    return good.unionByName(rows.filter("not (few and named)").select("transfer", "file_no", "name", F.lit(None).cast("string").alias("safe_name")))


def decode_utf16le(data: Column) -> Column:
    return F.decode(data, "UTF-16LE")


@F.pandas_udf(StringType())
def shortest_number(values: pd.Series) -> pd.Series:
    """The fewest digits that read back as the same number, never with an exponent."""
    return values.map(lambda x: np.format_float_positional(x, trim="-"), na_action="ignore")


def distinct_characters(text: Column) -> Column:
    """Characters of a text but line ends, in the order of their first use."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: (c != "") & (c != "\n")))


def lightest_shards(weights: dict[str, float], shards: int) -> list[list[str]]:
    """Items to shards: heaviest first (ties by name), each to the lightest shard so far (ties to the first)."""
    import heapq

    heap = [(0.0, k) for k in range(shards)]
    out: list[list[str]] = [[] for _ in range(shards)]
    for name in sorted(weights, key=lambda n: (-weights[n], n)):
        load, k = heapq.heappop(heap)
        out[k].append(name)
        heapq.heappush(heap, (load + weights[name], k))
    return out
