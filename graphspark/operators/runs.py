"""Run sets: the same questions answered more than once, brought together, checked and compared."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import draws, inference
from graphspark.operators.reports import FLAG, change


def generations(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``rows`` with ``generation``: 1 for a key's first row in an order, 2 for its second, and so on."""
    return rows.withColumn("generation", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of the keys that both sides have, each value as value_a and value_b."""
    side = lambda rows, s: rows.select(*keys, *(F.col(v).alias(f"{v}_{s}") for v in values))
    return side(left, "a").join(side(right, "b"), list(keys))


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(group, left_only, right_only, both): how the keys of two sides overlap; ``group`` is among the keys."""
    mark = lambda rows, name: rows.select(*keys).distinct().withColumn(name, F.lit(1))
    both = mark(left, "_l").join(mark(right, "_r"), list(keys), "full")
    n = lambda cond: F.sum(cond.cast("long"))
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return both.groupBy(*group).agg(n(l & ~r).alias("left_only"), n(r & ~l).alias("right_only"), n(l & r).alias("both"))


def noise_floor(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, identical, changed, share): questions generated twice, equal responses, outcomes that changed.

    ``pairs`` has response and correct of either generation, as ``aligned`` gives them.
    """
    n = lambda cond: F.sum(cond.cast("long"))
    out = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), n(F.col("response_a").eqNullSafe(F.col("response_b"))).alias("identical"), n(F.col("correct_a") != F.col("correct_b")).alias("changed"))
    return out.withColumn("share", 100 * F.col("changed") / F.col("n"))


def contrasts(rows: DataFrame, runs: Sequence[str], level: str, keys: Sequence[str], conditions: Sequence[str], control: str = "none") -> DataFrame:
    """(runs, condition, n, delta, broke, fixed, p, d_truncated, left_out): a condition's effect in each run set.

    A level at which either side is cut off too often (FLAG or more, over its pairs) is left out of
    its run set's contrast and counted. ``runs`` names the columns that tell run sets apart.
    """
    joined = inference.pairs(rows.where(F.col("condition").isin(control, *conditions)), [*runs, level, *keys], "condition", control, ["correct", "truncated"])
    cut = joined.groupBy(*runs, "condition", level).agg((F.greatest(F.avg("truncated_a"), F.avg("truncated_b")) >= FLAG).alias("flagged"))
    lost = cut.groupBy(*runs, "condition").agg(F.sum(F.col("flagged").cast("long")).alias("left_out"))
    kept = joined.join(F.broadcast(cut.where("not flagged").select(*runs, "condition", level)), [*runs, "condition", level])
    out = kept.groupBy(*runs, "condition").agg(*change(), (100 * (F.avg("truncated_b") - F.avg("truncated_a"))).alias("d_truncated"))
    return out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed"))).join(lost, [*runs, "condition"])


def follow_up_problems(planned: DataFrame, rows: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """(problem, n): what keeps a follow-up run set from being what was planned.

    ``missing`` keys of the plan, ``unplanned`` ones, ``repeated`` ones, and for each column of ``same`` keys
    whose value is another than planned. Nothing but zeros is a set that can be reported.
    """
    plan = planned.select(*keys, *(F.col(c).alias(f"_p_{c}") for c in same)).distinct().withColumn("_plan", F.lit(1))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.min(c).alias(f"_lo_{c}") for c in same), *(F.max(c).alias(f"_hi_{c}") for c in same))
    both = plan.join(per, list(keys), "full")
    there, meant = F.col("_n").isNotNull(), F.col("_plan").isNotNull()
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    differ = lambda c: there & meant & ~(F.col(f"_p_{c}").eqNullSafe(F.col(f"_lo_{c}")) & F.col(f"_p_{c}").eqNullSafe(F.col(f"_hi_{c}")))
    found = both.agg(n(meant & ~there).alias("missing"), n(there & ~meant).alias("unplanned"), n(F.coalesce(F.col("_n") > 1, F.lit(False))).alias("repeated"), *(n(differ(c)).alias(f"other_{c}") for c in same))
    names = found.columns
    return found.select(F.inline(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in names))))


# --- relational division -------------------------------------------------------------------------


def _wanted(rows: DataFrame, factors: Mapping[str, Sequence]) -> DataFrame:
    keep = F.lit(True)
    for name, levels in factors.items():
        keep = keep & F.col(name).isin(*levels)
    return rows.where(keep)


def divided(rows: DataFrame, unit: Sequence[str], factors: Mapping[str, Sequence]) -> DataFrame:
    """The rows, at wanted levels, of the units that have a row for every combination of the factors' levels.

    One aggregation of distinct combinations by unit, and a join back: no combination is written out.
    """
    wanted, need = _wanted(rows, factors), 1
    for levels in factors.values():
        need *= len(levels)
    whole = wanted.groupBy(*unit).agg(F.count_distinct(F.struct(*factors)).alias("_k")).where(F.col("_k") == need)
    return wanted.join(whole.select(*unit), list(unit), "left_semi")


def fallout(rows: DataFrame, unit: Sequence[str], factors: Mapping[str, Sequence], group: Sequence[str] = ()) -> DataFrame:
    """(group, factor, level, lacking): units without any row at a level, and (null, null) those that lack something.

    A unit counts if it has a row at a wanted combination. ``group`` is among the unit's columns.
    """
    wanted, need = _wanted(rows, factors), 1
    for levels in factors.values():
        need *= len(levels)
    has = {(name, level): F.max((F.col(name) == level).cast("int")) for name, levels in factors.items() for level in levels}
    per = wanted.groupBy(*unit).agg(F.count_distinct(F.struct(*factors)).alias("_k"), *(c.alias(f"_h{i}") for i, c in enumerate(has.values())))
    n = lambda cond: F.sum(cond.cast("long"))
    out = per.groupBy(*group).agg(n(F.col("_k") < need).alias("_any"), *(n(F.col(f"_h{i}") == 0).alias(f"_n{i}") for i in range(len(has))))
    text = lambda x: F.lit(None if x is None else str(x)).cast("string")
    entry = lambda name, level, value: F.struct(text(name).alias("factor"), text(level).alias("level"), value.alias("lacking"))
    entries = [entry(None, None, F.col("_any")), *(entry(name, level, F.col(f"_n{i}")) for i, (name, level) in enumerate(has))]
    return out.select(*group, F.inline(F.array(*entries)))


# --- clustered tests by hashed signs -------------------------------------------------------------


def sign_test(joined: DataFrame, group: Sequence[str], cluster: str, splits: int = 400, value: str = "correct") -> DataFrame:
    """(group, clusters, p): a cluster's differences change sign together, by bits of its hash.

    p has one added to both counts. Each sign pattern is one halving of the clusters: the sum over
    one half less that over the other.
    """
    d = F.col(f"{value}_b") - F.col(f"{value}_a")
    split = draws.halves(joined, group, cluster, {"d": d}, splits)
    seen = joined.groupBy(*group).agg(F.sum(d).alias("_seen"), F.count_distinct(cluster).alias("clusters"))
    far = (F.abs(F.col("d1") - F.col("d2")) >= F.abs(F.col("_seen"))).cast("long")
    out = split.join(seen, list(group)).groupBy(*group, "clusters").agg(F.sum(far).alias("_far"))
    return out.withColumn("p", (F.col("_far") + 1) / F.lit(splits + 1)).drop("_far")


def unstable(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of questions whose outcome changed between two generations."""
    return pairs.where("correct_a <> correct_b").select(*keys).distinct()


def flips_by_group(joined: DataFrame, group: Sequence[str], member: Column) -> DataFrame:
    """(group, n, members, flips, member_flips, share_in, share_out): how often a condition changes members' outcomes and others'."""
    flip, inside = (F.col("correct_a") != F.col("correct_b")).cast("long"), member.cast("long")
    out = joined.withColumns({"_f": flip, "_m": inside}).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("_m").alias("members"), F.sum("_f").alias("flips"), F.sum(F.col("_f") * F.col("_m")).alias("member_flips"))
    share = lambda k, n: F.when(n > 0, 100 * k / n)
    rest = F.col("n") - F.col("members")
    return out.withColumns({"share_in": share(F.col("member_flips"), F.col("members")), "share_out": share(F.col("flips") - F.col("member_flips"), rest)})
