"""Number rules: two-decimal rounding half away from zero, column letters, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Not F.round, which rounds the decimal text of the double."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def column_number(letters: Column) -> Column:
    """Spreadsheet letters to a 1-based number."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    """1-based number, up to 18278 (ZZZ), to letters."""
    letter = lambda n: F.char(n + 65)
    n = number.cast("long") - 1
    one, two, three = n, n - 26, n - 26 - 26 * 26
    div = lambda a, b: F.floor(a / b)
    return (
        F.when(number <= 26, letter(one))
        .when(number <= 26 + 26 * 26, F.concat(letter(div(two, 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(letter(div(three, 676)), letter(F.pmod(div(three, 26), F.lit(26))), letter(F.pmod(three, F.lit(26)))))
    )


def heading_scale(level: Column) -> Column:
    return F.when(level == 1, 2.0).when(level == 2, 1.6).when(level == 3, 1.3).otherwise(1.1)


def quarter_turns(rotate: Column) -> Column:
    return F.pmod(rotate, F.lit(360))
