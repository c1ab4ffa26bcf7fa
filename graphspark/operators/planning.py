"""Which corpora are worth running: screens of graph families, length regimes, room in a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions.fmt import two_decimals
from graphspark.operators.rewire import rewire
from graphspark.operators.structure import clustering, modal_degree_share
from graphspark.sources.graphs import fixed_size_random
from graphspark.sources.shared import settled

#: Fixed values: (nodes, mean degree, prompt tokens) of the difficulty rungs.
RUNGS = (
    (40, 8, 1691), (80, 4, 2197), (40, 12, 2290), (60, 8, 2569), (40, 16, 2893), (120, 4, 3430),
    (80, 8, 3448), (60, 12, 3489), (60, 16, 4407), (80, 12, 4688), (120, 8, 5409), (80, 16, 5931),
    (120, 12, 7373), (160, 8, 7576), (120, 16, 9344), (160, 12, 10330), (200, 12, 13277), (300, 8, 15136),
)
#: What reading a primer alone gives away of a task, as audited: the answer, part of it, or nothing.
SHORTCUT_AUDIT = {
    ("degree", "node_count"): "shortcut", ("clustering", "node_count"): "shortcut", ("rwse", "node_count"): "shortcut", ("filler", "node_count"): "shortcut", ("components", "node_count"): "none",
    ("degree", "edge_count"): "shortcut", ("clustering", "edge_count"): "partial", ("rwse", "edge_count"): "none", ("filler", "edge_count"): "none", ("components", "edge_count"): "none",
    ("degree", "node_degree"): "shortcut", ("clustering", "node_degree"): "none", ("rwse", "node_degree"): "partial", ("filler", "node_degree"): "none", ("components", "node_degree"): "none",
    ("degree", "cycle_check"): "partial", ("clustering", "cycle_check"): "partial", ("rwse", "cycle_check"): "partial", ("filler", "cycle_check"): "none", ("components", "cycle_check"): "shortcut",
    ("degree", "edge_existence"): "partial", ("clustering", "edge_existence"): "partial", ("rwse", "edge_existence"): "partial", ("filler", "edge_existence"): "none", ("components", "edge_existence"): "none",
    ("degree", "connected_nodes"): "partial", ("clustering", "connected_nodes"): "none", ("rwse", "connected_nodes"): "none", ("filler", "connected_nodes"): "none", ("components", "connected_nodes"): "none",
}
#: Tokens at which reading starts to fail, is known to fail, and fails in the middle.
READING = (1505, 3105, 6305)


def rungs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNGS, "n int, mean_degree int, tokens int")


def reading_zone(tokens: Column) -> Column:
    clean, degraded, collapse = READING
    return F.when(tokens <= clean, "clean").when(tokens <= degraded, "bracket-1").when(tokens <= collapse, "bracket-2").otherwise("collapsed")


def headroom(tokens: Column, max_context: Column, max_new: Column) -> Column:
    """Tokens of context left after prompt and answer; negative where a row would not fit."""
    return max_context - max_new - tokens


def feasible(rows: DataFrame, max_context: int, max_new: int, multiplier: float = 2.0) -> DataFrame:
    """Rungs that fit when a primer multiplies the prompt."""
    return rows.where(headroom((F.col("tokens") * multiplier).cast("int"), F.lit(max_context), F.lit(max_new)) >= 0)


def band(accuracy: Column, ceiling: float = 0.9, floor: float = 0.2) -> Column:
    """Whether a rung leaves room in both directions."""
    return F.when(accuracy >= ceiling, "ceiling").when(accuracy <= floor, "floor").otherwise("informative")


def model_bands(rows: DataFrame, accuracies: DataFrame, limits: DataFrame) -> DataFrame:
    """(model, rung…, band, readable, valid) for accuracies (model, n, mean_degree, accuracy).

    ``limits`` is (model, reading_limit); a model without one reads any length.
    """
    out = accuracies.join(F.broadcast(rows), ["n", "mean_degree"]).join(F.broadcast(limits), "model", "left")
    out = out.withColumn("band", band(F.col("accuracy"))).withColumn("readable", F.coalesce(F.col("tokens") <= F.col("reading_limit"), F.lit(True)))
    return out.withColumn("valid", (F.col("band") == "informative") & F.col("readable"))


def screen(spark: SparkSession, n: int, mean_degree: float, graphs: int = 8, seed: int = 0, blind_above: float = 0.5, silent_below: float = 0.05) -> DataFrame:
    """One row on a family of random graphs: modal degree share and spread of rendered clustering.

    Blind if the commonest degree answers too much, silent if clustering barely varies even after
    rewiring towards triangles.
    """
    if graphs < 2:
        raise ValueError("a screen needs at least two graphs")
    keys = spark.range(graphs).select((F.col("id") + seed).alias("graph_id"))
    edges = settled(fixed_size_random(n, round(mean_degree * n / 2), keys))
    nodes = keys.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("node"))
    spread = lambda e: clustering(e, nodes).groupBy("graph_id").agg(F.stddev_pop(two_decimals(F.col("clustering")).cast("double")).alias("sd"))
    share = modal_degree_share(edges, nodes).agg(F.avg("share").alias("modal_share"), F.stddev_pop("share").alias("modal_share_sd"))
    raw = spread(edges).agg(F.avg("sd").alias("spread"))
    high = spread(rewire(edges, nodes, up=True, seed=seed)).agg(F.avg("sd").alias("spread_rewired"), F.stddev_pop("sd").alias("spread_rewired_sd"))
    out = share.crossJoin(raw).crossJoin(high).withColumn("blind", F.col("modal_share") > blind_above)
    return out.withColumn("silent", F.col("spread_rewired") < silent_below)


def verdict(tokens: Column | None = None, limit: int | None = None) -> Column:
    """``pass``, or ``fail:`` and the reasons, of a row of ``screen``."""
    reasons = [F.when(F.col("blind"), F.lit("blind")), F.when(F.col("silent"), F.lit("silent"))]
    if tokens is not None and limit is not None:
        reasons.append(F.when(tokens > limit, F.lit("unreadable")))
    said = F.array_join(F.filter(F.array(*reasons), lambda r: r.isNotNull()), ",")
    return F.when(said == "", "pass").otherwise(F.concat(F.lit("fail:"), said))


def approximate_tokens(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, tokens): a quarter of the median length."""
    return rows.groupBy(group).agg(F.floor(F.median(F.length(text)) / 4).alias("tokens"))


def route_gains(bars: DataFrame, threshold: float = 0.05, degenerate: tuple[str, ...] = ()) -> DataFrame:
    """(task, condition, gain, offers) from bars (task, condition, bar), against condition ``none``.

    Tasks whose answers hardly vary gain nothing.
    """
    base = bars.where("condition = 'none'").select("task", F.col("bar").alias("none"))
    gain = F.when(F.col("task").isin(*degenerate), 0.0).otherwise(F.col("bar") - F.col("none")) if degenerate else F.col("bar") - F.col("none")
    return bars.where("condition <> 'none'").join(base, "task").select("task", "condition", gain.alias("gain"), (gain > threshold).alias("offers"))


def instance_parts(instance_id: Column) -> Column:
    """struct(task, size, density, seed, index) of ``<task>/size<n>/p<density>[/s<seed>]/<index>``."""
    part = lambda rx, kind: F.nullif(F.regexp_extract(instance_id, rx, 1), F.lit("")).cast(kind)
    return F.struct(
        F.regexp_extract(instance_id, "^([^/]+)/", 1).alias("task"),
        part(r"/(?:size|n)([0-9]+)(?:/|k)", "int").alias("size"),
        part(r"/p([0-9]+(?:\.[0-9]+)?)/", "double").alias("density"),
        part(r"/s([0-9]+)/", "long").alias("seed"),
        part(r"/([0-9]+)$", "int").alias("idx"),
    )


def yes_no_metrics(rows: DataFrame, target: str, prediction: str) -> DataFrame:
    """(accuracy, ambiguous, indeterminate) of first lines against targets that say yes or no.

    A target with both words or neither raises.
    """
    t, p = F.lower(target), F.lower(F.element_at(F.split(prediction, r"\r\n|[\n\r]"), 1))
    bad = t.contains("yes") == t.contains("no")
    want = F.when(bad, F.raise_error(F.concat(F.lit("unclear target: "), F.col(target))).cast("boolean")).otherwise(t.contains("yes"))
    yes, no = p.contains("yes"), p.contains("no")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return rows.agg(share((yes != no) & (yes == want)).alias("accuracy"), share(yes & no).alias("ambiguous"), share(~yes & ~no).alias("indeterminate"))


#: Replicates, permutations and bisection steps of a search for the detectable effect.
MDE_PRESETS = {"fast": (50, 200, 5), "full": (200, 500, 8)}


def mde_settings(preset: str = "fast", replicates: int | None = None, permutations: int | None = None, steps: int | None = None) -> dict[str, int]:
    """A preset with single values replaced; values must be positive."""
    if preset not in MDE_PRESETS:
        raise ValueError(f"unknown preset {preset!r}")
    given = dict(zip(("replicates", "permutations", "steps"), (replicates, permutations, steps)))
    out = {k: v if given[k] is None else given[k] for k, v in zip(given, MDE_PRESETS[preset])}
    if min(out.values()) < 1:
        raise ValueError("settings must be positive")
    return out


def task_delta_range(joined: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, low, high): the smallest and largest mean change over tasks."""
    per = joined.groupBy(*group, "task").agg((F.avg(F.col(b).cast("double")) - F.avg(F.col(a).cast("double"))).alias("d"))
    return per.groupBy(*group).agg(F.min("d").alias("low"), F.max("d").alias("high"))


def forced_rows(frame: DataFrame, group: list[str]) -> DataFrame:
    """(group, forced_wrong, looped): endless rows that score 0 though they were right, and those that repeat a right answer."""
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return frame.groupBy(*group).agg(count("truncated_but_correct").alias("forced_wrong"), count("looped_on_correct_answer").alias("looped"))


def recommended_count(cells: DataFrame, delta: float, pilot: int) -> DataFrame:
    """``cells`` (mde, flagged) with the pairs that would show a change of ``delta``, null with a reason where none can be said."""
    reason = F.when(F.col("mde").isNull(), "nothing changed").when(F.col("flagged"), "truncated").otherwise(F.lit(None).cast("string"))
    return cells.withColumn("reason", reason).withColumn("count", F.when(reason.isNull(), F.ceil(F.pow(F.col("mde") / delta, 2) * pilot).cast("long")))


def ladder_matrix(rows: DataFrame, rungs: DataFrame, carries: float = 0.85) -> DataFrame:
    """(model, rung, accuracy, n, dropped, band): accuracy by rung of difficulty, capped and overflown rows counted apart."""
    lost = F.coalesce("hit_cap", F.lit(False)) | F.coalesce("overflow", F.lit(False))
    per = rows.groupBy("model", "rung").agg(F.avg(F.when(~lost, F.col("exact").cast("double"))).alias("accuracy"), F.sum((~lost).cast("long")).alias("n"), F.sum(lost.cast("long")).alias("dropped"))
    band = F.when(F.col("accuracy").isNull(), "unread").when(F.col("accuracy") >= carries, "ceiling").when(F.col("accuracy") < 0.25, "floor").otherwise("readable")
    return per.join(F.broadcast(rungs), "rung").withColumn("band", band)


def retrieval_matrix(rows: DataFrame) -> DataFrame:
    """(model, k, position, magnitude, accuracy, n, dropped) with pooled rows, where position or magnitude is null."""
    lost = F.coalesce("hit_cap", F.lit(False))
    sets = [["model", "k", "position", "magnitude"], ["model", "k", "position"], ["model", "k"]]
    out = rows.withColumn("_lost", lost).groupingSets(sets, "model", "k", "position", "magnitude").agg(
        F.avg(F.when(~F.col("_lost"), F.col("exact").cast("double"))).alias("accuracy"), F.sum((~F.col("_lost")).cast("long")).alias("n"), F.sum(F.col("_lost").cast("long")).alias("dropped")
    )
    return out.select("model", "k", "position", "magnitude", "accuracy", "n", "dropped")


# --- what a primer alone answers -----------------------------------------------------------------


def audit(spark: SparkSession) -> DataFrame:
    """(condition, task, label): what a primer alone gives away, as audited by hand."""
    return spark.createDataFrame([(c, t, label) for (c, t), label in SHORTCUT_AUDIT.items()], "condition string, task string, label string")


def verdicts(cells: DataFrame, decided: float = 0.99) -> DataFrame:
    """``cells`` (condition, task, rung, baseline, shortcut) with ``gap`` in points, ``decided`` and ``label``.

    A cell is decided where the shortcut answers nearly all: a model run adds nothing there. ``label`` is
    the audit's, null for conditions outside it.
    """
    known = audit(cells.sparkSession)
    out = cells.join(F.broadcast(known), ["condition", "task"], "left")
    return out.withColumns({"gap": 100 * (F.col("shortcut") - F.col("baseline")), "decided": F.col("shortcut") >= decided})


def best_arm(scores: DataFrame, group: list[str], arm: str, score: str, tolerance: float = 1e-12) -> DataFrame:
    """(group, arm, score): the best arm of each group; of those within ``tolerance`` of it the first by name."""
    top = scores.groupBy(*group).agg(F.max(score).alias("_top"))
    near = scores.join(top, group).where(F.col(score) >= F.col("_top") - tolerance)
    return near.groupBy(*group).agg(F.min_by(F.struct(arm, score), arm).alias("_b")).select(*group, F.col(f"_b.{arm}").alias(arm), F.col(f"_b.{score}").alias(score))
