"""Resampling by hashes: what a draw does to a unit follows from the two, so every group that a unit is in
sees the same draw, no state is kept, and any engine that has md5 draws alike."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.spans import let

#: Chances of a Poisson count of mean one, cumulated, in parts of 2^16: a draw has as many as it reaches.
STEPS = tuple(int(65536 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8))


def _words(unit: Column, label: str, count: int) -> Column:
    """``count`` numbers below 2^16 of a unit: four digits each of md5s of (unit, label, number)."""
    digits = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substr(h, 4 * j + 1, F.lit(4)), 16, 10).cast("int"))
    hashed = lambda k: F.md5(F.concat(unit.cast("string"), F.lit(label), k.cast("string")).cast("binary"))
    blocks = F.transform(F.sequence(F.lit(0), F.lit((count + 7) // 8 - 1)), lambda k: let(hashed(k), digits))
    return F.slice(F.flatten(blocks), 1, count)


def weights(unit: Column, draws: int) -> Column:
    """How often a unit is drawn in each of ``draws`` resamples: independent Poisson counts of mean one."""
    reached = lambda u: sum((u >= s).cast("int") for s in STEPS)
    return F.transform(_words(unit, ":", draws), reached)


def resampled(rows: DataFrame, group: Sequence[str], unit: str, sums: Mapping[str, Column], draws: int) -> DataFrame:
    """(group, draw, the sums): each sum with its units counted as often as the draw has them.

    Rows are added up by group and unit before draws multiply them, and draws by group before they
    are shuffled. A group that a draw leaves empty has no row for it.
    """
    per = rows.groupBy(*group, unit).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    spread = per.select(*group, *sums, F.posexplode(weights(F.col(unit), draws)).alias("draw", "w")).where("w > 0")
    return spread.groupBy(*group, "draw").agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in sums))


def interval(rows: DataFrame, group: Sequence[str], value: Column, percent: float = 95.0) -> DataFrame:
    """(group, low, high): the percentiles of a statistic over draws that leave ``percent`` between them."""
    tail = (100 - percent) / 200
    out = rows.withColumn("_v", value)
    return out.groupBy(*group).agg(F.percentile("_v", tail).alias("low"), F.percentile("_v", 1 - tail).alias("high"))


def halves(rows: DataFrame, group: Sequence[str], unit: str, sums: Mapping[str, Column], splits: int) -> DataFrame:
    """(group, split, n1, n2, and for each sum its name with 1 and 2): sums over either half of a group's units.

    A unit's half in a split is a bit of its hash, sixteen splits to a number, so the rows are read
    once and only totals and first halves are added up.
    """
    per = rows.groupBy(*group, unit).agg(*(F.sum(c).alias(n) for n, c in sums.items())).withColumn("n", F.lit(1))
    names = ["n", *sums]
    words = per.select(*group, *names, F.posexplode(_words(F.col(unit), "/", (splits + 15) // 16)).alias("word", "bits"))
    bit = lambda j: F.shiftright("bits", j).bitwiseAND(F.lit(1))
    added = words.groupBy(*group, "word").agg(*(F.sum(n).alias(n) for n in names), *(F.sum(bit(j) * F.col(n)).alias(f"{n}_{j}") for n in names for j in range(16)))
    one = lambda j: F.struct((F.col("word") * 16 + j).alias("split"), *(F.col(f"{n}_{j}").alias(f"{n}1") for n in names), *((F.col(n) - F.col(f"{n}_{j}")).alias(f"{n}2") for n in names))
    return added.select(*group, F.inline(F.array(*map(one, range(16))))).where(F.col("split") < splits)


# --- the same in DuckDB --------------------------------------------------------------------------


def words_sql(units: str, unit: str, label: str, count: int) -> str:
    """Rows (unit, word, u) of a table's units."""
    return (
        f"SELECT {unit}, 8 * k + j AS word, CAST('0x' || substr(md5(concat({unit}, '{label}', k)), 4 * j + 1, 4) AS INTEGER) AS u "
        f"FROM (SELECT DISTINCT {unit} FROM {units}), (SELECT unnest(range({(count + 7) // 8})) AS k), (SELECT unnest(range(8)) AS j) WHERE 8 * k + j < {count}"
    )


def weights_sql(units: str, unit: str, draws: int) -> str:
    """Rows (unit, draw, w) of a table's units."""
    reached = " + ".join(f"CAST(u >= {s} AS INTEGER)" for s in STEPS)
    return f"SELECT {unit}, word AS draw, {reached} AS w FROM ({words_sql(units, unit, ':', draws)})"


def halves_sql(units: str, unit: str, splits: int) -> str:
    """Rows (unit, split, first) of a table's units: whether a split puts a unit into its first half."""
    words = words_sql(units, unit, "/", (splits + 15) // 16)
    return f"SELECT {unit}, 16 * word + b AS split, (u >> b) & 1 AS first FROM ({words}), (SELECT unnest(range(16)) AS b) WHERE 16 * word + b < {splits}"
