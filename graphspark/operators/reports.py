"""Report blocks over a study's frame: each a query plan of a few aggregations, one row a reported line.

A frame has a row for every scored response (arm, task, density, graph_id, condition, correct,
truncated, exact, pred, gold, ...); pairs have two conditions of one graph side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.probability import binomial_two_sided, mde_points
from graphspark.operators import inference, statistics

#: Bands of the accuracy without a primer; the share of truncation that flags a cell.
BANDS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.01)
FLAG, CARRIES = 0.15, 0.85
VARYING = ("node_degree", "edge_count", "edge_existence", "connected_nodes")
CELL = ["arm", "task", "density", "condition"]


def change(value: str = "correct") -> list[Column]:
    """n, delta (points), broke and fixed of a paired 0/1 value."""
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    return [
        F.count(F.lit(1)).alias("n"), (100 * (F.avg(b) - F.avg(a))).alias("delta"), F.sum(((a == 1) & (b == 0)).cast("long")).alias("broke"),
        F.sum(((a == 0) & (b == 1)).cast("long")).alias("fixed"),
    ]


def tested(joined: DataFrame, group: Sequence[str], family: Sequence[str] = (), value: str = "correct") -> DataFrame:
    """(group, n, delta, broke, fixed, p, q): exact p, adjusted within a family."""
    out = joined.groupBy(*group).agg(*change(value)).withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))
    return inference.with_q(out, family=family)


def cells(joined: DataFrame, bars: DataFrame) -> DataFrame:
    """One row a cell: effect, accuracy without and with, truncation, flag, and what a reader of the primer scores."""
    per = joined.where(F.col("task").isin(*VARYING)).groupBy(*CELL).agg(
        *change(), F.avg("correct_a").alias("baseline"), F.avg("correct_b").alias("acc"), F.avg("truncated_a").alias("trunc_a"), F.avg("truncated_b").alias("trunc_b"),
        F.avg((F.col("correct_a") != F.col("correct_b")).cast("double")).alias("discordance"),
    )
    worst = F.greatest("trunc_a", "trunc_b")
    return per.join(F.broadcast(bars), ["task", "condition"], "left").withColumns({"flagged": worst >= FLAG, "tmax": worst, "carries": F.coalesce(F.col("bar") >= CARRIES, F.lit(False))})


def fold() -> Column:
    """Which half a graph belongs to: by pairs of fours of its id, which the densities go through."""
    return F.floor(F.col("graph_id") / 4) % 2


def banded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("band", inference.banded(F.col("baseline"), BANDS))


def by_band(rows: DataFrame) -> DataFrame:
    """(band, carries, cells, delta): the mean effect of cells."""
    return banded(rows).groupBy("band", "carries").agg(F.count(F.lit(1)).alias("cells"), F.avg("delta").alias("delta"))


def by_band_and_threshold(rows: DataFrame, thresholds: Sequence[float] = (0.05, 0.1, 0.15, 0.3, 0.5, 1.01)) -> DataFrame:
    """The same, keeping the cells whose larger truncated share is below each threshold."""
    limits = F.explode(F.array(*(F.lit(t) for t in thresholds)))
    wide = rows.withColumn("threshold", limits).where("tmax < threshold")
    return banded(wide).groupBy("threshold", "band", "carries").agg(F.count(F.lit(1)).alias("cells"), F.avg("delta").alias("delta"))


def split_half(joined: DataFrame, bars: DataFrame) -> DataFrame:
    """(band, carries, points, delta): cells binned on the graphs of one parity, measured on the other's, both ways."""
    even = fold() == 0
    half = lambda c, keep: F.avg(F.when(keep, F.col(c)))
    per = joined.where(F.col("task").isin(*VARYING)).groupBy(*CELL).agg(
        F.greatest(F.avg("truncated_a"), F.avg("truncated_b")).alias("tmax"),
        F.array(
            F.struct(half("correct_a", even).alias("baseline"), (100 * (half("correct_b", ~even) - half("correct_a", ~even))).alias("delta")),
            F.struct(half("correct_a", ~even).alias("baseline"), (100 * (half("correct_b", even) - half("correct_a", even))).alias("delta")),
        ).alias("folds"),
    )
    points = per.where(F.col("tmax") < FLAG).join(F.broadcast(bars), ["task", "condition"], "left").select("task", "condition", (F.col("bar") >= CARRIES).alias("carries"), F.explode("folds").alias("f"))
    flat = points.select("task", "condition", "carries", "f.*").where("baseline is not null and delta is not null")
    return banded(flat).groupBy("band", "carries").agg(F.count(F.lit(1)).alias("points"), F.avg("delta").alias("delta"))


def crossfit(joined: DataFrame, route_tasks: Sequence[tuple[str, str]]) -> DataFrame:
    """(task, points, r, slope): effect on one parity's graphs against the accuracy without on the other's, route cells only."""
    even = fold() == 0
    half = lambda c, keep: F.avg(F.when(keep, F.col(c)))
    keep = F.lit(False)
    for t, c in route_tasks:
        keep = keep | ((F.col("task") == t) & (F.col("condition") == c))
    per = joined.where(keep).groupBy(*CELL).agg(
        F.greatest(F.avg("truncated_a"), F.avg("truncated_b")).alias("tmax"),
        F.array(
            F.struct(half("correct_a", even).alias("base"), (100 * (half("correct_b", ~even) - half("correct_a", ~even))).alias("eff")),
            F.struct(half("correct_a", ~even).alias("base"), (100 * (half("correct_b", even) - half("correct_a", even))).alias("eff")),
        ).alias("folds"),
    )
    points = per.where(F.col("tmax") < FLAG).select("task", F.explode("folds").alias("f")).select("task", "f.*").where("base is not null and eff is not null")
    both = points.unionByName(points.withColumn("task", F.lit("pooled")))
    return statistics.pearson(both, ["task"], "base", "eff").select("task", F.col("n").alias("points"), "r", "slope", "p")


def arm_medians(rows: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(arm, cells, median, inside, below) of the accuracy without a primer, unflagged cells."""
    b = F.col("baseline")
    return rows.where("not flagged").groupBy("arm").agg(
        F.count(F.lit(1)).alias("cells"), F.median("baseline").alias("median"), F.sum(((b >= low) & (b < high)).cast("long")).alias("inside"), F.sum((b < low).cast("long")).alias("below")
    )


def outcome_table(frame: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, correct, wrong, truncated, exact_finished, wording, relative_error) of integer answers."""
    share = lambda v: F.avg((F.col("outcome") == v).cast("double"))
    done = F.col("truncated") == 0
    p, g = F.col("pred").try_cast("double"), F.col("gold").try_cast("double")
    return frame.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), share("correct").alias("correct"), share("wrong").alias("wrong"), share("truncated").alias("truncated"), F.avg(F.when(done, F.col("exact"))).alias("exact_finished"),
        F.avg(F.when(done, F.col("uses_degree_sum"))).alias("wording"), F.median(F.when(done & p.isNotNull() & (g != 0), F.abs(p - g) / g)).alias("relative_error"),
    )


def yes_rates(frame: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, yes, balanced, truncated, tokens) of edge questions: yes-rate and tokens of finished, balanced accuracy of all."""
    done, yes = F.col("truncated") == 0, F.col("gold_is_yes") == 1
    return frame.where("task = 'edge_existence'").groupBy(*group).agg(
        F.avg(F.when(done, F.coalesce(F.col("pred") == "Yes", F.lit(False)).cast("double"))).alias("yes"),
        (0.5 * (F.avg(F.when(yes, F.col("correct"))) + F.avg(F.when(~yes, F.col("correct"))))).alias("balanced"),
        F.avg("truncated").alias("truncated"), F.median(F.when(done, F.col("n_tokens"))).alias("tokens"),
    )


def balanced_change(joined: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, delta): the paired change of balanced accuracy in points."""
    yes = F.col("gold_is_yes") == 1
    d = F.col("correct_b") - F.col("correct_a")
    return joined.where("task = 'edge_existence'").groupBy(*group).agg(F.count(F.lit(1)).alias("n"), (50 * (F.avg(F.when(yes, d)) + F.avg(F.when(~yes, d)))).alias("delta"))


def false_alarms(joined: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, delta, removed, added, p): paired change of the yes-rate on non-edges, both finished."""
    rows = joined.where("task = 'edge_existence' and gold_is_yes = 0 and truncated_a = 0 and truncated_b = 0")
    said = lambda s: F.coalesce(F.col(f"pred_{s}") == "Yes", F.lit(False)).cast("int").alias(f"fa_{s}")
    out = rows.select(*group, said("a"), said("b")).groupBy(*group).agg(*change("fa"))
    return out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed"))).withColumnsRenamed({"broke": "removed", "fixed": "added"})


def hint(joined: DataFrame, group: Sequence[str], expected: Column) -> DataFrame:
    """(group, wrong, closer, farther, p, fixes, over): do answers wrong under both move to an expected value?

    ``over`` is how many fixed answers over-counted before.
    """
    rows = joined.where("truncated_a = 0 and truncated_b = 0")
    far = lambda s: F.abs(F.col(f"pred_{s}").try_cast("double") - expected)
    wrong = (F.col("correct_a") == 0) & (F.col("correct_b") == 0)
    fix = (F.col("correct_a") == 0) & (F.col("correct_b") == 1)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = rows.groupBy(*group).agg(
        n(wrong).alias("wrong"), n(wrong & (far("b") < far("a"))).alias("closer"), n(wrong & (far("b") > far("a"))).alias("farther"), n(fix).alias("fixes"), n(fix & (F.col("signed_error_a") > 0)).alias("over")
    )
    return out.withColumn("p", binomial_two_sided(F.col("closer"), F.col("farther")))


def bundle(rows: DataFrame, parts: Sequence[str] = ("degree", "clustering", "rwse"), whole: str = "all") -> DataFrame:
    """(combinations, excess): the whole primer's effect less the mean of its parts', where no cell is flagged."""
    wanted = rows.where(F.col("condition").isin(*parts, whole))
    per = wanted.groupBy("arm", "task", "density").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.col("flagged").cast("int")).alias("f"), F.avg(F.when(F.col("condition") != whole, F.col("delta"))).alias("m"), F.max(F.when(F.col("condition") == whole, F.col("delta"))).alias("w")
    )
    return per.where((F.col("k") == len(parts) + 1) & (F.col("f") == 0)).agg(F.count(F.lit(1)).alias("combinations"), F.avg(F.col("w") - F.col("m")).alias("excess"))


def length_slopes(joined: DataFrame, chars: DataFrame) -> DataFrame:
    """(arm, task, slope, filler_gap): points per 1,000 characters over primers, and the filler's distance from the line.

    ``chars`` is (condition, kchars); combinations with a flagged condition are left out.
    """
    per = joined.where(F.col("task").isin(*VARYING)).groupBy("arm", "task", "condition").agg(*change(), F.greatest(F.avg("truncated_a"), F.avg("truncated_b")).alias("tmax"))
    rows = per.join(F.broadcast(chars), "condition")
    line = F.col("condition") != "filler"
    x, y = F.when(line, F.col("kchars")), F.when(line, F.col("delta"))
    out = rows.groupBy("arm", "task").agg(
        F.max("tmax").alias("tmax"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icpt"), F.max(F.when(~line, F.col("delta"))).alias("fd"), F.max(F.when(~line, F.col("kchars"))).alias("fk")
    )
    return out.where(F.col("tmax") < FLAG).select("arm", "task", "slope", (F.col("fd") - (F.col("icpt") + F.col("slope") * F.col("fk"))).alias("filler_gap"))


def exact_against_f1(joined: DataFrame) -> DataFrame:
    """(arm, condition, exact, f1, same_way): finished pairs of neighbour lists."""
    rows = joined.where("task = 'connected_nodes' and truncated_a = 0 and truncated_b = 0")
    out = rows.groupBy("arm", "condition").agg((100 * (F.avg("correct_b") - F.avg("correct_a"))).alias("exact"), (100 * (F.avg("f1_b") - F.avg("f1_a"))).alias("f1"))
    return out.withColumn("same_way", F.col("exact") * F.col("f1") > 0)


def power(rows: DataFrame, pairs: int = 100) -> DataFrame:
    """(cells, discordance, mde): the median discordance of unflagged cells and the effect it can show."""
    out = rows.where("not flagged").agg(F.count(F.lit(1)).alias("cells"), F.median("discordance").alias("discordance"))
    return out.withColumn("mde", mde_points(F.col("discordance"), F.lit(pairs)))


def detectability(joined: DataFrame) -> DataFrame:
    """(arm, null_cells, blocked, median_mde): comparisons that show nothing, and how many could not have.

    A comparison is blocked where the accuracy without leaves less room either way than the effect it
    can detect; the median is over those that leave room for a gain.
    """
    per = joined.groupBy("arm", "task", "condition").agg(
        *change(), F.avg("correct_a").alias("base"), F.avg((F.col("correct_a") != F.col("correct_b")).cast("double")).alias("disc"), F.greatest(F.avg("truncated_a"), F.avg("truncated_b")).alias("tmax")
    )
    per = inference.with_q(per.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed"))), family=["arm", "task"])
    null = per.where((F.col("q") >= 0.05) & (F.col("tmax") < FLAG)).withColumn("mde", mde_points(F.greatest(F.col("disc"), 1 / F.col("n")), F.col("n")))
    gain, harm = 100 * (1 - F.col("base")) < F.col("mde"), 100 * F.col("base") < F.col("mde")
    return null.groupBy("arm").agg(F.count(F.lit(1)).alias("null_cells"), F.sum((gain | harm).cast("long")).alias("blocked"), F.median(F.when(~gain, F.col("mde"))).alias("median_mde"))


def band_log_odds(rows: DataFrame) -> DataFrame:
    """(band, kind, cells, fixed, broke, log_odds) over unflagged cells: filler, carrying or side information."""
    kind = F.when(F.col("condition") == "filler", "filler").when(F.col("carries"), "carrying").otherwise("side")
    out = banded(rows.where("not flagged")).withColumn("kind", kind).groupBy("band", "kind").agg(F.count(F.lit(1)).alias("cells"), F.sum("fixed").alias("fixed"), F.sum("broke").alias("broke"))
    return out.withColumn("log_odds", statistics.log_odds(F.col("broke"), F.col("fixed")))


def position_gap(rows: DataFrame, group: Sequence[str], early: Column) -> DataFrame:
    """(group, n, gap): accuracy of early less late rows in points, within densities, weighted by their rows."""
    per = rows.groupBy(*group, "density").agg(F.count(F.lit(1)).alias("k"), F.avg(F.when(early, F.col("exact"))).alias("e"), F.avg(F.when(~early, F.col("exact"))).alias("l"))
    per = per.where("e is not null and l is not null")
    return per.groupBy(*group).agg(F.sum("k").alias("n"), (100 * F.sum((F.col("e") - F.col("l")) * F.col("k")) / F.sum("k")).alias("gap"))


def joint(frame: DataFrame) -> DataFrame:
    """(arm, condition, n, both, consistent): degree and neighbours of one node, both right, or at least agreeing."""
    keys = ["arm", "density", "graph_id", "condition"]
    pick = lambda task, s: frame.where(F.col("task") == task).select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("correct", "truncated", "parsed", "pred")))
    j = pick("node_degree", "d").join(pick("connected_nodes", "n"), keys)
    ids = F.when(F.col("pred_n").rlike(r"(?i)\bno\s+nodes?\b"), 0).otherwise(F.size(F.array_distinct(F.regexp_extract_all("pred_n", F.lit("-?[0-9]+"), F.lit(0)))))
    agree = (F.col("truncated_d") == 0) & (F.col("truncated_n") == 0) & (F.col("parsed_d") == 1) & (F.col("parsed_n") == 1) & (F.col("pred_d").try_cast("int") == ids)
    return j.groupBy("arm", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("correct_d") * F.col("correct_n")).cast("double")).alias("both"), F.avg(F.coalesce(agree, F.lit(False)).cast("double")).alias("consistent")
    )


def best_by_fold(joined: DataFrame) -> DataFrame:
    """(arm, task, condition, chosen, kept): the condition with the largest gain on even graphs, and its gain on odd ones."""
    even = fold() == 0
    d = F.col("correct_b") - F.col("correct_a")
    per = joined.groupBy("arm", "task", "condition").agg((100 * F.avg(F.when(even, d))).alias("x"), (100 * F.avg(F.when(~even, d))).alias("y")).where("x is not null and y is not null")
    best = F.min_by(F.struct("condition", "x", "y"), F.struct(-F.col("x"), F.col("condition")))
    return per.groupBy("arm", "task").agg(best.alias("b")).select("arm", "task", "b.condition", F.col("b.x").alias("chosen"), F.col("b.y").alias("kept"))


def significant_by_scope(joined: DataFrame, rate: float = 0.05) -> DataFrame:
    """(scope, tests, significant): adjusted over all tests, within arms, and within arm and task."""
    base = joined.groupBy("arm", "task", "condition").agg(*change()).withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))
    out = None
    for scope, family in (("all", []), ("arm", ["arm"]), ("task", ["arm", "task"])):
        one = inference.with_q(base, family=family).agg(F.count(F.lit(1)).alias("tests"), F.sum((F.col("q") < rate).cast("long")).alias("significant")).select(F.lit(scope).alias("scope"), "tests", "significant")
        out = one if out is None else out.unionByName(one)
    return out


def cross_arm(frame: DataFrame, one: str, other: str) -> DataFrame:
    """(task, condition, n, delta, broke, fixed, p, gap_closed): another arm against one on the same graphs.

    ``gap_closed`` is the gain as a share of what the first arm misses.
    """
    keys = ["task", "density", "graph_id", "condition"]
    pick = lambda arm, s: frame.where(F.col("arm") == arm).select(*keys, F.col("correct").alias(f"correct_{s}"))
    j = pick(one, "a").join(pick(other, "b"), keys)
    out = j.groupBy("task", "condition").agg(*change(), F.avg("correct_a").alias("_base")).withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))
    return out.withColumn("gap_closed", F.when(F.col("_base") < 1, F.col("delta") / (100 * (1 - F.col("_base"))))).drop("_base")


def agreement(frame: DataFrame, one: str, other: str) -> DataFrame:
    """(task, n, observed, expected, kappa) of two arms' correctness, chance taken within density and condition."""
    keys = ["task", "density", "graph_id", "condition"]
    pick = lambda arm, s: frame.where(F.col("arm") == arm).select(*keys, F.col("correct").alias(f"correct_{s}"))
    j = pick(one, "a").join(pick(other, "b"), keys)
    per = j.groupBy("task", "density", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("pa"), F.avg("correct_b").alias("pb"), F.avg((F.col("correct_a") == F.col("correct_b")).cast("double")).alias("o")
    )
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    out = per.groupBy("task").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("o")) / F.sum("n")).alias("observed"), (F.sum(F.col("n") * chance) / F.sum("n")).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def churn(frame: DataFrame) -> DataFrame:
    """(arm, task, units, always, never, mixed): graphs with several conditions, by how many of them are right."""
    per = frame.groupBy("arm", "task", "density", "graph_id").agg(F.count(F.lit(1)).alias("k"), F.sum("correct").alias("c")).where("k >= 2")
    n = lambda cond: F.sum(cond.cast("long"))
    return per.groupBy("arm", "task").agg(
        F.count(F.lit(1)).alias("units"), n(F.col("c") == F.col("k")).alias("always"), n(F.col("c") == 0).alias("never"), n((F.col("c") > 0) & (F.col("c") < F.col("k"))).alias("mixed")
    )


def broken_overlap(joined: DataFrame) -> DataFrame:
    """(arm, task, first, second, broke_first, broke_second, both): graphs that two conditions break alike."""
    rows = joined.where("correct_a = 1").select("arm", "task", "density", "graph_id", "condition", (F.col("correct_b") == 0).alias("x"))
    left = rows.withColumnsRenamed({"condition": "first", "x": "y"})
    right = rows.withColumnsRenamed({"condition": "second", "x": "z"})
    j = left.join(right, ["arm", "task", "density", "graph_id"]).where("first < second")
    n = lambda c: F.sum(c.cast("long"))
    return j.groupBy("arm", "task", "first", "second").agg(n(F.col("y")).alias("broke_first"), n(F.col("z")).alias("broke_second"), n(F.col("y") & F.col("z")).alias("both"))


def off_by(frame: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, n, one, three, over): wrong finished integer answers, how far off and how many too high."""
    rows = frame.where("truncated = 0 and exact = 0 and signed_error is not null")
    e = F.abs("signed_error")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg((e <= 1).cast("double")).alias("one"), F.avg((e <= 3).cast("double")).alias("three"), F.avg((F.col("signed_error") > 0).cast("double")).alias("over"))


def effect_by_tercile(joined: DataFrame, order: Sequence[str]) -> DataFrame:
    """(condition, tercile, n, delta): the effect by thirds of a value within density."""
    ranked = inference.terciles(joined, ["condition", "density"], list(order))
    return ranked.groupBy("condition", "tercile").agg(F.count(F.lit(1)).alias("n"), (100 * (F.avg("correct_b") - F.avg("correct_a"))).alias("delta"))


def levels(joined: DataFrame) -> DataFrame:
    """(condition, density, n, delta, broke, fixed, p): effects by density and, where density is null, pooled."""
    out = joined.groupingSets([["condition", "density"], ["condition"]], "condition", "density").agg(*change())
    return out.select("condition", "density", "n", "delta", "broke", "fixed").withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))


def density_slope(rows: DataFrame) -> DataFrame:
    """(arm, task, condition, slope, between): how a cell's effect moves with density: points per unit, and spread."""
    out = rows.groupBy("arm", "task", "condition").agg(F.regr_slope("delta", F.col("density") / 100).alias("slope"), F.var_pop("delta").alias("between"), F.count(F.lit(1)).alias("levels"))
    return out.where("levels >= 2")


def by_strata(frame: DataFrame, value: str, bins: Sequence[float]) -> DataFrame:
    """(task, bin, n, accuracy): a histogram of a value over fixed edges with the accuracy of each bin."""
    rows = frame.withColumn("bin", inference.banded(F.col(value).cast("double"), bins)).where("bin is not null")
    return rows.groupBy("task", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))


def evenly_spaced(rows: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows of each group at even distances in an order, the first among them."""
    w = Window.partitionBy(*group)
    r, n = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    placed = rows.withColumn("_r", r).withColumn("_n", n)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return placed.where((F.col("_r") % step == 0) & (F.col("_r") / step < k)).drop("_r", "_n")
