"""Matches with their places, as columns: what stands where in a text, and what stands beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that mark matches while a text is cut up; in a text they count as spaces.
_OPEN, _CLOSE = "\x01", "\x02"
SPAN = "array<struct<at:int,end:int,said:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def spans(text: Column, pattern: Column | str) -> Column:
    """Array of (at, end, said) of a pattern's matches, at counted from 0: the text is cut before and after each."""
    plain = F.translate(_text(text), _OPEN + _CLOSE, "  ")
    pieces = F.split(F.regexp_replace(plain, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN)

    def step(seen: Column, piece: Column) -> Column:
        return let(
            F.instr(piece, _CLOSE) - 1,
            lambda size: F.struct(
                (seen["at"] + F.length(piece) - 1).alias("at"),
                F.concat(seen["out"], F.array(F.struct(seen["at"].alias("at"), (seen["at"] + size).alias("end"), F.substr(piece, F.lit(1), size).alias("said"))).cast(SPAN)).alias("out"),
            ),
        )

    def walk(parts: Column) -> Column:
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda seen: seen["out"])

    return let(pieces, walk)


def before(text: Column, at: Column, size: int) -> Column:
    """The ``size`` characters ahead of a place, or fewer at the start."""
    lo = F.greatest(at - size, F.lit(0))
    return F.substr(text, lo + 1, at - lo)


def after(text: Column, end: Column, size: Column | int) -> Column:
    """The ``size`` characters from a place on."""
    return F.substr(text, end + 1, F.greatest(size if isinstance(size, Column) else F.lit(size), F.lit(0)))


def ints(said: Column) -> Column:
    """The runs of digits of a text, as integers."""
    return F.transform(F.regexp_extract_all(said, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))


def group(said: Column, pattern: Column | str, number: int) -> Column:
    """A group of the pattern's first match in a text, empty without one."""
    return F.regexp_extract(said, pattern, number) if isinstance(pattern, str) else F.coalesce(F.get(F.regexp_extract_all(said, pattern, F.lit(number)), F.lit(0)), F.lit(""))
