"""Benchmark decontamination by template canonicalisation: SQL expressions only.

Numbers, names and units become typed placeholders, so that a benchmark question and copies of it with other numbers
or names are one template. Windows of ``WINDOW`` canonical words are hashed and joined with those of the benchmark. A
document that holds enough of an item's windows is compared with it slot by slot, at each place where they meet: each
value of the item must stand for one value of the document and the other way round, else the likeness is that of a form,
not of a question. The windows of the places that pass must be enough again, each counted once.

The documents are read and canonicalised in one projection and exploded into windows that meet the benchmark's in a
hash join: broadcast if a count proves the benchmark's windows few, else shuffled by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_COVERAGE = 0.5
#: Windows with fewer literal words (not placeholders) than this are too common to count.
MIN_LITERAL = 4
BROADCAST_ROWS = 200_000
#: Units that follow a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilograms", "ton", "tons", "tonnes", "lb", "lbs", "pound", "pounds", "ounce", "ounces", "oz", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "usd", "eur", "euro", "euros", "cents", "degrees", "celsius", "fahrenheit", "kmh", "mph", "watts", "volts", "joules", "newtons", "mol")

_NAME = r"(?<=[\p{L}\p{N},;>] )(\p{Lu}\p{Ll}+)"
#: A number stands alone or with a unit; digits inside words are letters of them.
_NUMBER = r"(?<![\p{L}0-9])[0-9]+(?=(" + "|".join(UNITS) + r")?(?![\p{L}0-9]))"
_UNIT = r"(<num[0-9]+> )(" + "|".join(UNITS) + r")( |$)"


def valued(text: Column) -> Column:
    """Words, lower-cased and without punctuation, with slots as <num12>, <nameann>, <unitkg>.

    A name is a capitalised word that doesn't begin a sentence or line. Marks that only decorate words go first. Null
    counts as empty.
    """
    t = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), "<>#*$%&|_~^`", "  "), "[\\x20\\t]+", " ")
    t = F.regexp_replace(t, _NAME, "<name$1>")
    t = F.regexp_replace(t, r"(?<=[0-9])[.,](?=[0-9])", "")
    t = F.regexp_replace(t, _NUMBER, "<num$0>")
    t = F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}<>]+", " "))
    return F.regexp_replace(t, _UNIT, "$1<unit$2>$3")


def canonical(valued_text: Column) -> Column:
    return F.regexp_replace(valued_text, "<(num|name|unit)[^>]*>", "<$1>")


def _words(text: Column) -> Column:
    """Words of a text that valued() has made: one space between them."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def _windows(words: Column, size: int) -> Column:
    """Hashes of the windows of an array of words; the whole array where it is shorter."""
    count = F.greatest(F.size(words) - size + 1, F.lit(1))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, size))))


def _is_slot(word: Column) -> Column:
    return word.startswith("<")


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int, min_literal: int) -> tuple[DataFrame, DataFrame]:
    """Templates (one for items of one valued text) and their windows; of an item whose windows are all too common, all
    of them, and it counts as form_only."""
    texts = benchmark.select(F.col(id_col).cast("long").alias("item_id"), valued(F.col(text_col)).alias("v")).filter("v <> ''").groupBy("v").agg(F.min("item_id").alias("item_id"))
    words = texts.select("item_id", "v", _words(F.col("v")).alias("item_values"), _words(canonical(F.col("v"))).alias("w"))
    literal = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.size(F.filter(F.slice("w", i, window), lambda x: ~_is_slot(x))))
    least = F.least(F.lit(min_literal), F.ceil(F.size("item_values") / 2))
    rows = words.withColumn("x", F.arrays_zip(_windows(F.col("w"), window).alias("hash"), literal.alias("literal"))).withColumn("form_only", F.array_max("x.literal") < least)
    rows = rows.select("item_id", "item_values", "form_only", F.posexplode("x").alias("item_at", "x")).select("item_id", "item_values", "form_only", "item_at", F.col("x.hash").alias("hash"), F.col("x.literal").alias("literal"))
    rows = common.materialize(rows.filter((F.col("literal") >= least) | F.col("form_only")), "bench-windows")
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("item_windows"), F.first("item_values").alias("item_values"), F.first("form_only").alias("form_only"))
    return sizes, rows.select("item_id", "item_at", "hash")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window: int = WINDOW, min_coverage: float = MIN_COVERAGE, min_literal: int = MIN_LITERAL) -> DataFrame:
    """A row for each (document, item) that is contaminated: doc_id, item_id, n_windows, item_windows, coverage, n_slots,
    kind (``exact``: all slots have the item's values, else ``reparameterised``).

    Items of equal valued text count as the one of the smallest id. Null and empty texts, of documents or items, have
    no windows and no rows; items shorter than a window are looked for as they stand, and items of hardly more than
    slots only with their own values. Repeated rows of a document count once. An empty benchmark gives no rows.
    """
    sizes, windows = _items(benchmark, item_col, item_text_col, window, min_literal)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = _words(canonical(valued(F.col("text"))))
    lengths = sorted({r["n"] for r in sizes.select(F.least(F.size("item_values"), F.lit(window)).alias("n")).distinct().collect()})  # at most WINDOW values
    if not lengths:
        lengths = [window]
    exploded = plain.select("doc_id", words.alias("w"))
    parts = [exploded.select("doc_id", F.posexplode(F.when(F.size("w") >= n, _windows(F.col("w"), n))).alias("doc_at", "hash")) for n in lengths]
    right = common.bounded_broadcast(windows, BROADCAST_ROWS)
    met = parts[0].join(right, "hash")
    for p in parts[1:]:
        met = met.union(p.join(right, "hash"))
    # A copy with words put in or left out lies on several lines, and a form can be filled in more than once.
    cells = common.materialize(met.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"), "item_at").distinct(), "bench-cells")
    enough = F.col("n_windows") >= min_coverage * F.col("item_windows")
    found = cells.groupBy("doc_id", "item_id").agg(F.count_distinct("item_at").alias("n_windows")).join(sizes, "item_id").filter(enough).drop("n_windows")
    lines = cells.groupBy("doc_id", "item_id", "shift").agg(F.collect_list("item_at").alias("ats"), F.min("item_at").alias("first"), F.max("item_at").alias("last"))
    near = common.materialize(lines.join(found, ["doc_id", "item_id"]), "bench-near")
    ids = near.select("doc_id").distinct()
    sources = plain.join(common.bounded_broadcast(ids, BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", _words(valued(F.col("text"))).alias("doc_values"))
    both = near.join(sources, "doc_id")
    value = lambda words, at: F.coalesce(F.try_element_at(words, at), F.lit(""))
    kind = lambda w: F.regexp_extract(w, "^<(num|name|unit)", 1)
    places = F.filter(F.sequence(F.col("first") + 1, F.least(F.col("last") + window, F.size("item_values"))), lambda p: _is_slot(value(F.col("item_values"), p)))
    pairs = F.filter(F.transform(places, lambda p: F.struct(value(F.col("item_values"), p).alias("i"), value(F.col("doc_values"), (p + F.col("shift")).cast("int")).alias("d"))), lambda x: kind(x["i"]) == kind(x["d"]))
    # Where few of the slots meet their like, the line is no copy.
    checked = both.withColumn("pairs", pairs).filter(2 * F.size("pairs") >= F.size(places))
    one_to_one = (F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("pairs.i"))) & (F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("pairs.d")))
    exact = F.forall("pairs", lambda x: x["i"] == x["d"])
    # The longest line that passes gives the kind.
    best = F.max(F.struct(F.size("ats").alias("n"), exact.cast("int").alias("exact"), F.size("pairs").cast("long").alias("n_slots"))).alias("b")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_windows")
    rows = checked.filter((one_to_one & ~F.col("form_only")) | exact).groupBy("doc_id", "item_id").agg(covered, F.max("item_windows").alias("item_windows"), best).filter(enough)
    return rows.select("doc_id", "item_id", "n_windows", "item_windows", F.round(F.col("n_windows") / F.col("item_windows"), 6).alias("coverage"), F.col("b.n_slots").alias("n_slots"), F.when(F.col("b.exact") == 1, "exact").otherwise("reparameterised").alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """docs without those that hold a benchmark item."""
    gone = common.materialize(contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("doc_id").alias("__gone")).distinct(), "bench-gone")
    return docs.join(common.bounded_broadcast(gone, BROADCAST_ROWS), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE: dict[str, str] = {}
