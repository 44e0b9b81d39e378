"""Numbers: rounding to the nearest even of the exact binary value, short formatting, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(col: Column, n: int) -> Column:
    """Round a double at ``n`` decimals by its exact binary value, ties to even.

    Spark's ``round`` works on the shortest decimal and ``bround`` on that as well;
    ``format_number`` rounds the exact value, but as a text.  So only values next to a tie
    (or too large for the test) go that way: for all others the nearest whole number of
    units is beyond doubt, and its quotient is the double nearest to the decimal.
    """
    x, unit = col.cast("double"), float(10**n)
    exact = F.replace(F.format_number(x, n), F.lit(","), F.lit("")).cast("double")
    near_tie = (F.abs(x * unit - F.floor(x * unit) - 0.5) < 1e-6) | ~(F.abs(x) < 1e8)
    return F.when(near_tie, exact).otherwise(F.rint(x * unit) / unit)


def short_number(col: Column) -> Column:
    """A number without needless decimals: 3.0 reads 3, 2.5 reads 2.5."""
    d = col.cast("double")
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def clean_number(col: Column, low: float, high: float) -> Column:
    """The first number in a text, null outside ``low`` to ``high``; true and false are no numbers."""
    found = F.nullif(F.regexp_extract(col, r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    return F.when(found.between(low, high), found)


def clean_year(col: Column) -> Column:
    return clean_number(col, 1950, 2100).cast("int")


def months_between(y1: Column, m1: Column, y2: Column, m2: Column) -> Column:
    """Months from one month to another, both included, 1 at least."""
    return F.greatest(F.lit(1), (y2 - y1) * 12 + (m2 - m1) + 1)


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + F.coalesce(month, F.lit(1))
