"""How conditions move what responses do: patterns as rows, paired effects, trends that several arms share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import draws, inference
from graphspark.operators.reports import change

#: The eight kinds of change, in the order of a report.
KINDS = (
    "gain, states the answer", "gain, does not state it", "gain, truncation-driven", "gain, not significant",
    "neutral (within 1 point)", "loss, not significant", "loss, truncation-driven", "loss, other",
)


def unpivoted(rows: DataFrame, patterns: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """(keep, pattern, x): one row for each pattern that belongs to a row's task."""
    entry = lambda name: F.struct(F.lit(name).alias("pattern"), F.col(name).cast("int").alias("x"))
    return rows.select(*keep, F.inline(F.array(*map(entry, patterns)))).where("x is not null")


def pattern_shifts(long: DataFrame, keys: Sequence[str], group: Sequence[str], control: str = "none") -> DataFrame:
    """(group, condition, n, share_none, share, shift, a_only, b_only, p, q, d_truncated, n_fin, shift_fin).

    Each condition against the control on the same keys, in points; exact McNemar, adjusted over all rows of
    the result; ``fin`` is over pairs where both are finished. ``long`` has x and truncated, and ``group``
    is among its columns.
    """
    j = inference.pairs(long, [*group, *keys], "condition", control, ["x", "truncated"])
    d = F.col("x_b") - F.col("x_a")
    done = (F.col("truncated_a") == 0) & (F.col("truncated_b") == 0)
    out = j.groupBy(*group, "condition").agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg("x_a")).alias("share_none"), (100 * F.avg("x_b")).alias("share"), (100 * F.avg(d)).alias("shift"),
        F.sum((d == -1).cast("long")).alias("a_only"), F.sum((d == 1).cast("long")).alias("b_only"), (100 * F.avg(F.col("truncated_b") - F.col("truncated_a"))).alias("d_truncated"),
        F.sum(done.cast("long")).alias("n_fin"), (100 * F.avg(F.when(done, d))).alias("shift_fin"),
    )
    return inference.with_q(out.withColumn("p", binomial_two_sided(F.col("a_only"), F.col("b_only"))))


def shift_intervals(long: DataFrame, keys: Sequence[str], group: Sequence[str], unit: str, count: int, control: str = "none") -> DataFrame:
    """(group, condition, low, high) of the shifts, over draws of units that all patterns and arms share."""
    j = inference.pairs(long, [*group, *keys], "condition", control, ["x"])
    sums = {"n": F.lit(1), "d": F.col("x_b") - F.col("x_a")}
    drawn = draws.resampled(j, [*group, "condition"], unit, sums, count)
    return draws.interval(drawn, [*group, "condition"], 100 * F.col("d") / F.col("n"))


def trends(shifts: DataFrame, group: Sequence[str], arms: int = 3, rate: float = 0.05) -> DataFrame:
    """(group, sign, with_it, others): shifts that go the same way at q < ``rate`` in so many arms or more.

    ``group`` names a shift's columns but the arm. ``with_it`` and ``others`` list arms, sorted.
    """
    sign = F.when(F.col("shift") > 0, 1).when(F.col("shift") < 0, -1)
    marked = shifts.withColumn("_s", F.when(F.col("q") < rate, sign))
    both = marked.groupBy(*group).agg(
        F.collect_set("arm").alias("_all"), *(F.collect_set(F.when(F.col("_s") == s, F.col("arm"))).alias(f"_a{i}") for i, s in enumerate((1, -1)))
    )
    sides = [F.struct(F.lit(s).alias("sign"), F.array_sort(f"_a{i}").alias("with_it"), F.array_sort(F.array_except("_all", f"_a{i}")).alias("others")) for i, s in enumerate((1, -1))]
    return both.select(*group, F.inline(F.array(*sides))).where(F.size("with_it") >= arms)


def associations(long: DataFrame, found: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """(keys, arm, n_on, accuracy_on, n_off, accuracy_off): finished responses of a trend, with the pattern and without.

    ``found`` holds the keys of trends; arms with fewer than ``least`` responses on either side are left out.
    """
    rows = long.where("truncated = 0").join(found.select(*keys).distinct(), list(keys), "left_semi")
    on = F.col("x") == 1
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(*keys, "arm").agg(n(on).alias("n_on"), F.avg(F.when(on, F.col("exact"))).alias("accuracy_on"), n(~on).alias("n_off"), F.avg(F.when(~on, F.col("exact"))).alias("accuracy_off"))
    return out.where((F.col("n_on") >= least) & (F.col("n_off") >= least))


def kind_of_change(effect: Column, truncated: Column, q: Column, states: Column, rate: float = 0.05) -> Column:
    """One of KINDS. A change is driven by truncation where the truncated share moves against it by half or more."""
    significant = q < rate
    driven = -truncated * F.sign(effect) >= F.abs(effect) / 2
    up = F.when(driven, KINDS[2]).when(states, KINDS[0]).otherwise(KINDS[1])
    down = F.when(driven, KINDS[6]).otherwise(KINDS[7])
    small = F.when(F.abs(effect) <= 1, KINDS[4]).when(effect > 0, KINDS[3]).otherwise(KINDS[5])
    return F.when(significant & (effect > 0), up).when(significant, down).otherwise(small)


def changes_by_kind(joined: DataFrame, group: Sequence[str], states: Column) -> DataFrame:
    """(group, condition, effect, d_truncated, p, q, kind): pairs against the control, adjusted within ``group``."""
    out = joined.groupBy(*group, "condition").agg(*change(), (100 * (F.avg("truncated_b") - F.avg("truncated_a"))).alias("d_truncated"))
    out = inference.with_q(out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed"))), family=list(group))
    return out.withColumn("effect", F.col("delta")).withColumn("kind", kind_of_change(F.col("effect"), F.col("d_truncated"), F.col("q"), states))


def slope_with_levels(rows: DataFrame, cell: Sequence[str], level: str, x: str, y: str, unit: str, splits: int = 400) -> DataFrame:
    """(cell, n, slope, p): the slope of y on x with a level of its own for each ``level``, and its p.

    Within a level, x and y are less their means there; under the null the sign of a row's product is a
    fair one, so p comes from hashed signs of the units, with one added to both counts.
    """
    means = rows.groupBy(*cell, level).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    apart = rows.join(F.broadcast(means), [*cell, level]).select(*cell, unit, ((F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_my"))).alias("_xy"), F.pow(F.col(x) - F.col("_mx"), F.lit(2)).alias("_xx"))
    point = apart.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), (F.sum("_xy") / F.nullif(F.sum("_xx"), F.lit(0.0))).alias("slope"), F.abs(F.sum("_xy")).alias("_seen"))
    split = draws.halves(apart, cell, unit, {"s": F.col("_xy")}, splits).join(point.select(*cell, "_seen"), list(cell))
    far = split.groupBy(*cell).agg(F.sum((F.abs(F.col("s1") - F.col("s2")) >= F.col("_seen") - 1e-9).cast("long")).alias("_far"))
    return point.join(far, list(cell)).select(*cell, "n", "slope", ((F.col("_far") + 1) / F.lit(splits + 1)).alias("p"))
