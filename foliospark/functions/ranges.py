"""Page range expressions such as ``1-3,5,8-`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "[ \\t\\n\\r]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def page_alias(text: Column, pages: Column) -> Column:
    """``first`` and ``last``, in any case, as numbers; anything else stays."""
    word = F.lower(trim(text))
    return F.when(word == "first", F.lit("1")).when(word == "last", pages.cast("string")).otherwise(text)


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), trim), lambda p: p != "")


def _bounds(part: Column, pages: Column) -> Column:
    number = rf"[+-]?[0-9]+"
    low = F.try_to_number(F.regexp_extract(part, rf"^({number}){_SPACE}*(-|\z)", 1), F.lit("S999999999")).cast("int")
    single = F.regexp_like(part, F.lit(rf"^{number}\z"))
    open_ = F.regexp_like(part, F.lit(rf"^{number}{_SPACE}*-\z"))
    high = F.try_to_number(F.regexp_extract(part, rf"^{number}{_SPACE}*-{_SPACE}*({number})\z", 1), F.lit("S999999999")).cast("int")
    return F.struct(low.alias("low"), F.when(single, low).when(open_, pages).otherwise(high).alias("high"))


def expand(text: Column, pages: Column) -> Column:
    """The pages an expression names, in its order and with repeats; null if it is wrong or names none.

    Wrong: not a number, below 1, beyond the last page, or a range that runs backwards.
    """
    pages = pages.cast("int")
    runs = F.transform(_parts(text), lambda p: _bounds(p, pages))
    good = F.forall(runs, lambda r: F.coalesce((r["low"] >= 1) & (r["high"] <= pages) & (r["low"] <= r["high"]), F.lit(False)))
    out = F.flatten(F.transform(runs, lambda r: F.sequence(r["low"], r["high"])))
    return F.when((F.size(runs) > 0) & good, out)


def expand_strict(text: Column, pages: Column) -> Column:
    """expand(), raising an error where that gives null."""
    return F.coalesce(expand(text, pages), F.raise_error(F.concat(F.lit("bad page range: "), F.coalesce(text, F.lit("null")))))


def select(text: Column, pages: Column) -> Column:
    """The set of pages an expression names; the empty text and ``all`` name every page."""
    every = F.lower(trim(text)).isin("", "all")
    return F.when(every, F.sequence(F.lit(1), pages.cast("int"))).otherwise(F.array_sort(F.array_distinct(expand(page_alias(text, pages), pages))))


def order(pages: Column) -> Column:
    """A permutation as text."""
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ",")


def moved(order, page, target):
    """The order with a page moved to a place (from 0); unchanged if there is no such page or place."""
    rest = F.filter(order, lambda x: x != page)
    there = F.array_contains(order, page) & (target >= 0) & (target < F.size(order))
    return F.when(there, F.array_insert(rest, (target + 1).cast("int"), page)).otherwise(order)


def selected(pages, page, total, on=True):
    """The sorted pages with one more, or one less; unchanged if the document hasn't got it."""
    new = F.array_union(pages, F.array(page)) if on else F.array_remove(pages, page)
    return F.array_sort(F.when(page.between(1, total), new).otherwise(pages))
