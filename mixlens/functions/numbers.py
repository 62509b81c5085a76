"""Rounding of doubles as Python's round() does it: by the exact binary value, ties to the even digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mixlens.functions.text import let

#: Splits a double into two halves of 26 bits, whose products are exact (Veltkamp).
_SPLITTER = float((1 << 27) + 1)
#: From here on a double times the scale has no digits behind the point.
_WHOLE = float(1 << 52)


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * _SPLITTER - (x * _SPLITTER - x)
    return high, x - high


def rounded(value: Column | str, places: int) -> Column:
    """value, or the column of that name, to so many decimal places.

    Twice the scaled value is product + error without loss (Dekker), so its whole part, and whether anything is left, are
    exact: an even whole part rounds down, an odd one up, and an odd one with nothing left is a tie. What stands more than
    once is worked out once: by let for an expression, by generated code for a plain column.
    """
    scale = 10.0**places
    once = (lambda c, use: use(c)) if isinstance(value, str) else let

    def exactly(x: Column) -> Column:
        size = F.abs(x)
        return once(size * (2 * scale), lambda product: once(F.floor(product).cast("double"), lambda floor: once(error_of(size, product), lambda error: digits(x, product, floor, error))))

    def error_of(size: Column, product: Column) -> Column:
        (a, b), (c, d) = _halves(size), _halves(F.lit(2 * scale))
        return ((a * c - product) + a * d + b * c) + b * d

    def digits(x: Column, product: Column, floor: Column, error: Column) -> Column:
        below = (product == floor) & (error < 0)
        exact = (product == floor) & (error == 0)
        # twice the value has this whole part: what is left of it by 4 tells where the value lies between two even numbers
        whole = floor - F.when(below, 1.0).otherwise(0.0)
        left = F.pmod(whole, F.lit(4.0))
        up = (left == 3) | ((left == 1) & ~exact)
        made = (F.floor(whole / 2).cast("double") + F.when(up, 1.0).otherwise(0.0)) / scale * F.when(x < 0, -1.0).otherwise(1.0)
        return F.when(F.isnan(x) | (product >= _WHOLE), x).otherwise(made)

    return once((F.col(value) if isinstance(value, str) else value).cast("double"), exactly)
