"""Paired comparisons: align two conditions, count what changed, test, adjust for many tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.probability import binomial_two_sided
from graphspark.sources.shared import settled


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order: an aggregation, not a sort of each group."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def conflicts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: a check query that should return nothing."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.countDistinct(F.struct(*rest)).alias("versions")).where("versions > 1")


def pairs(rows: DataFrame, keys: Sequence[str], condition: str, control: str, values: Sequence[str]) -> DataFrame:
    """Every other condition's rows beside the control's of the same key: value_a, value_b.

    One inner join on the keys.
    """
    a = rows.where(F.col(condition) == control).select(*keys, *(F.col(v).alias(f"{v}_a") for v in values))
    b = rows.where(F.col(condition) != control).select(*keys, condition, *(F.col(v).alias(f"{v}_b") for v in values))
    return a.join(b, list(keys))


def paired_counts(joined: DataFrame, group: Sequence[str], value: str = "exact") -> DataFrame:
    """(group, n, share_a, share_b, delta, broke, fixed) of a 0/1 value; delta in percentage points."""
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    return joined.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a).alias("share_a"),
        F.avg(b).alias("share_b"),
        (100 * (F.avg(b) - F.avg(a))).alias("delta"),
        F.sum(F.when((a == 1) & (b == 0), 1).otherwise(0)).alias("broke"),
        F.sum(F.when((a == 0) & (b == 1), 1).otherwise(0)).alias("fixed"),
    )


def with_mcnemar(counts: DataFrame) -> DataFrame:
    return counts.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))


def with_q(rows: DataFrame, p: str = "p", family: Sequence[str] = (), name: str = "q", eligible: Column | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted values within a family; rows that are not eligible get null."""
    ok = (eligible if eligible is not None else F.lit(True)) & F.col(p).isNotNull()
    part = [*family, "_ok"]
    rows = rows.withColumn("_ok", ok)
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(p))
    m = F.count(F.lit(1)).over(Window.partitionBy(*part))
    rows = rows.withColumn("_raw", F.col(p) * m / rank).withColumn("_rank", rank)
    down = Window.partitionBy(*part).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col("_ok"), F.least(F.lit(1.0), F.min("_raw").over(down)))
    return rows.withColumn(name, q).drop("_ok", "_raw", "_rank")


def with_holm(rows: DataFrame, p: str = "p", family: Sequence[str] = (), name: str = "holm") -> DataFrame:
    """Holm's step-down adjusted values within a family."""
    w = Window.partitionBy(*family).orderBy(p)
    rows = rows.withColumn("_rank", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*family)))
    up = Window.partitionBy(*family).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    value = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_rank") + 1)).over(up))
    return rows.withColumn(name, value).drop("_rank", "_m")


def outcome_shares(rows: DataFrame, group: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """(group, n, correct, wrong, truncated, flagged): shares; 15 % truncated flags a cell, inclusive."""
    share = lambda v: F.avg((F.col(outcome) == v).cast("double"))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        share("correct").alias("correct"),
        share("wrong").alias("wrong"),
        share("truncated").alias("truncated"),
        (share("truncated") >= 0.15).alias("flagged"),
    )


def majority(rows: DataFrame, group: Sequence[str], value: str, largest: bool = False) -> DataFrame:
    """(group, answer, share): the commonest value; ties to the smallest, or the largest."""
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("k"))
    if largest:
        best = F.max_by(value, F.struct("k", value))
    else:
        best = F.min_by(value, F.struct(-F.col("k"), F.col(value)))
    return counts.groupBy(*group).agg(best.alias("answer"), (F.max("k") / F.sum("k")).alias("share"))


def kappa(rows: DataFrame, a: str, b: str, stratum: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of two 0/1 columns, chance agreement taken within strata."""
    per = rows.groupBy(*stratum).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("o")
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    w = F.col("n") / F.lit(1.0)
    out = per.agg((F.sum(w * F.col("o")) / F.sum(w)).alias("observed"), (F.sum(w * chance) / F.sum(w)).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def icc(rows: DataFrame, cluster: str, value: Column) -> DataFrame:
    """(icc, clusters): the one-way intraclass correlation of a value within clusters."""
    base = rows.select(F.col(cluster).alias("c"), value.cast("double").alias("x"))
    per = base.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    tot = per.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("N"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("s1"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
    )
    k, total = F.col("k"), F.col("N")
    msb = (F.col("s2") - F.col("s1") * F.col("s1") / total) / (k - 1)
    msw = F.col("ssw") / (total - k)
    n0 = (total - F.col("n2") / total) / (k - 1)
    return tot.select(((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"), k.alias("clusters"))


def balanced_accuracy(rows: DataFrame, group: Sequence[str], gold: str, exact: str) -> DataFrame:
    """(group, yes_rate, balanced): mean of the accuracies on yes and on no rows."""
    yes = F.col(gold) == 1
    hit = F.col(exact).cast("double")
    said = F.when(yes, hit).otherwise(1 - hit)
    return rows.groupBy(*group).agg(F.avg(said).alias("yes_rate"), ((F.avg(F.when(yes, hit)) + F.avg(F.when(~yes, hit))) / 2).alias("balanced"))


def length_outliers(rows: DataFrame, cell: Sequence[str], length: str) -> DataFrame:
    """``rows`` with length_outlier: longer than the cell's third quartile plus three ranges.

    Quartiles are exact and come from an aggregation joined back, so no cell is sorted in one task.
    """
    q = rows.groupBy(*cell).agg(F.percentile(length, 0.25).alias("_q1"), F.percentile(length, 0.75).alias("_q3"))
    return rows.join(q, list(cell)).withColumn("length_outlier", F.col(length) > F.col("_q3") + 3 * (F.col("_q3") - F.col("_q1"))).drop("_q1", "_q3")


def seeded_sample(rows: DataFrame, stratum: Sequence[str], key: Column, k: int) -> DataFrame:
    """The k first rows of each stratum in the order of ``key``."""
    order = Window.partitionBy(*stratum).orderBy(key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def terciles(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "tercile") -> DataFrame:
    """min(2, floor(3 (r - 1) / n)) of the r-th of n rows."""
    w = Window.partitionBy(*group)
    r = F.row_number().over(w.orderBy(*order))
    return rows.withColumn(name, F.least(F.lit(2), F.floor(3 * (r - 1) / F.count(F.lit(1)).over(w))).cast("int"))


def quartile_strata(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "stratum") -> DataFrame:
    """Quartile bins of first ranks: max(0, ceil(4 (r - 1) / (n - 1)) - 1)."""
    w = Window.partitionBy(*group)
    r, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    return rows.withColumn(name, F.when(n > 1, F.greatest(F.lit(0), F.ceil(4 * (r - 1) / (n - 1)) - 1)).otherwise(F.lit(0)).cast("int"))


def banded(value: Column, edges: Sequence[float]) -> Column:
    """The band [lo, hi) that a value falls in, as text; null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges[:-1], edges[1:]))):
        out = F.when((value >= lo) & (value < hi), F.lit(f"[{lo:g},{hi:g})")).otherwise(out)
    return out


def impute_errors(rows: DataFrame, task: str, error: str, wrong: Column) -> DataFrame:
    """``rows`` with ``error`` filled by the task's median over its wrong rows."""
    med = rows.where(wrong & F.col(error).isNotNull()).groupBy(task).agg(F.median(error).alias("_med"))
    return rows.join(F.broadcast(med), task, "left").withColumn("imputed", F.coalesce(F.col(error).cast("double"), "_med")).drop("_med")


def slope_within(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """One slope over groups, each with its own level: demean within the group, then regress."""
    w = Window.partitionBy(*group)
    d = rows.select((F.col(x) - F.avg(x).over(w)).alias("dx"), (F.col(y) - F.avg(y).over(w)).alias("dy"))
    return d.agg((F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") * F.col("dx"))).alias("slope"), F.count(F.lit(1)).alias("n"))


def running_sums(rows: DataFrame, order: str, sums: dict[str, str], group: Sequence[str] = (), following: str | None = None, bins: int = 200) -> DataFrame:
    """``rows`` with running sums (new name -> column) up to and including each row in the order of a column.

    Rows of equal ``order`` must not share a group. Values are dealt into bins at approximate
    percentiles, summed within a bin, and begin at what earlier bins hold, so that no task sorts all
    rows of a group. Group columns must not be null. ``following`` names the next row's ``order``, null for the last.
    """
    part = list(group)
    # Approximate percentiles depend on how partial results are merged: they are written down, so that every reader has the same bins.
    edges = settled(rows.groupBy(*part).agg(F.percentile_approx(order, F.array(*(F.lit(i / bins) for i in range(1, max(bins, 2))))).alias("_edges")))
    binned = rows.join(edges, part, "inner") if part else rows.crossJoin(edges)
    binned = binned.withColumn("_bin", F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(order))), F.lit(0))).drop("_edges")
    totals = binned.groupBy(*part, "_bin").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()), F.min(order).alias("_low"))
    before = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(
        *part, "_bin", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums), F.lead("_low").over(Window.partitionBy(*part).orderBy("_bin")).alias("_next")
    )
    inside = Window.partitionBy(*part, "_bin").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = binned.join(start, [*part, "_bin"]).withColumns({n: F.sum(c).over(upto) + F.col(f"_s_{n}") for n, c in sums.items()})
    if following:
        out = out.withColumn(following, F.coalesce(F.lead(order).over(inside), F.col("_next")))
    return out.drop("_bin", "_next", *(f"_s_{n}" for n in sums))
