"""Rendering of numbers and phrases as columns."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Whether the i-th tie (2 i + 1) / 200 is rounded up when its binary neighbour is written out.
_TIES = "".join("1" if f"{(2 * i + 1) / 200:.2f}" == f"{(i + 1) / 100:.2f}" else "0" for i in range(100))


def two_decimals(value: Column) -> Column:
    """Two decimals of a number in [0, 1e6), rounded to six places first, exact ties as binary floats do.

    An odd multiple of 1/200 is a tie in decimal, but its binary neighbour lies on one side or the
    other, so those come from a table made by rule (below 1; above, ties go up); everything else has
    one nearest value.
    """
    v = F.round(value, 6)
    steps = F.round(v * 200, 4)
    whole = steps.cast("long")
    below = ((whole - 1) / 2).cast("long")
    tie = (steps == whole) & (whole % 2 == 1) & (v < 1)
    up = F.substring(F.lit(_TIES), (below + 1).cast("int"), F.lit(1)).cast("int")
    hundredths = F.when(tie, below + up).otherwise(F.round(v * 100).cast("long"))
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def two_decimals_of(value: float) -> str:
    """``two_decimals`` of one number in [0, 1], for text that is made beside the number."""
    return f"{float(Decimal(repr(float(value))).quantize(Decimal('0.000001'), ROUND_HALF_UP)):.2f}"


def one_decimal_even(value: Column) -> Column:
    """One decimal, halves to even, after nine places."""
    return F.bround(F.round(value, 9).cast("decimal(20,9)"), 1)


def join_phrases(parts: Column) -> Column:
    """``a``, ``a and b`` or ``a, b, and c``; empty for no phrases."""
    n = F.size(parts)
    last = F.element_at(parts, -1)
    return (
        F.when(n <= 0, F.lit(""))
        .when(n == 1, last)
        .when(n == 2, F.concat(F.element_at(parts, 1), F.lit(" and "), last))
        .otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(", and "), last))
    )


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def flat(text: Column) -> Column:
    """White space runs as single spaces."""
    return F.regexp_replace(text, r"\s+", " ")
