"""Registered report blocks over the study, each beside the DuckDB SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.functions import answers, claims, detect
from graphspark.operators import encode, features, inference, prompts, reports, solver, statistics, structure, tasks
from graphspark.plans import study
from graphspark.plans.oracle import GRAPHS, REACH
from graphspark.sources import graphs
from graphspark.sources.shared import derived, settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WITH = f"WITH RECURSIVE {GRAPHS} {REACH} {study.FRAME_SQL}"
#: Exact two-sided sign test of broke and fixed.
_P = """CASE WHEN broke = fixed THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(broke, fixed) + 1),
  lambda i: exp(lgamma(broke + fixed + 1) - lgamma(i + 1) - lgamma(broke + fixed - i + 1) - (broke + fixed) * ln(2.0))))) END"""
_CHANGE = """count(*) AS n, 100 * (avg({v}_b) - avg({v}_a)) AS delta, CAST(sum(CASE WHEN {v}_a = 1 AND {v}_b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broke,
  CAST(sum(CASE WHEN {v}_a = 0 AND {v}_b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fixed"""
_EFF = _CHANGE.format(v="correct")
_VARYING = "task IN ('node_degree', 'edge_count', 'edge_existence', 'connected_nodes')"
_BAND = "CASE WHEN baseline < 0.25 THEN '[0,0.25)' WHEN baseline < 0.5 THEN '[0.25,0.5)' WHEN baseline < 0.75 THEN '[0.5,0.75)' WHEN baseline < 0.9 THEN '[0.75,0.9)' ELSE '[0.9,1.01)' END"
_CELLS = f""", cells AS (SELECT p.arm, p.task, p.density, p.condition, {_EFF}, avg(correct_a) AS baseline, avg(correct_b) AS acc, avg(truncated_a) AS trunc_a, avg(truncated_b) AS trunc_b,
  avg(abs(correct_a - correct_b)) AS discordance, greatest(avg(truncated_a), avg(truncated_b)) AS tmax, greatest(avg(truncated_a), avg(truncated_b)) >= 0.15 AS flagged, any_value(bar) AS bar, any_value(bar) >= 0.85 AS carries
  FROM paired p JOIN bars USING (task, condition) WHERE p.{_VARYING} GROUP BY ALL)"""


def _q(source: str, part: str = "", name: str = "adj") -> str:
    over = f"PARTITION BY {part}" if part else ""
    return f""", {name}_t AS (SELECT *, {_P} AS p FROM {source}), {name}_r AS (SELECT *, row_number() OVER ({over} ORDER BY p) AS rk, count(*) OVER ({over}) AS m FROM {name}_t),
  {name} AS (SELECT *, least(1.0, min(p * m / rk) OVER ({over} ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM {name}_r)"""


def report(body: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL after the frame's CTEs."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if body is not None:
            # Spark's rounding has no negative zero.
            SQL[fn.__name__] = f"{_WITH} {body}".replace(" round(", " 0.0 + round(")
        return fn

    return add


def _round(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(study.bar_rows(), "task string, condition string, bar double")


_VALUES = ("correct", "truncated", "gold_is_yes", "pred", "gold", "exact", "abs_error", "signed_error", "n_tokens", "f1", "response", "a", "target_degree", "n_nodes", "n_components")


def _pairs(spark: SparkSession, d: str, control: str = "none") -> DataFrame:
    out = study.pairs(study.frame(spark, d), control, _VALUES)
    same = ("gold_is_yes", "a", "target_degree", "n_nodes", "n_components")
    return out.withColumnsRenamed({f"{c}_a": c for c in same}).drop(*(f"{c}_b" for c in same))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return reports.cells(_pairs(spark, d), _bars(spark))


# --- the frame --------------------------------------------------------------------------------


@report("SELECT event_id, arm, task, condition, density, graph_id, pred, exact, round(f1, 9) AS f1, coalesce(abs_error, -1) AS abs_error, coalesce(signed_error, 0) AS signed_error, parsed, outcome, coalesce(gold_is_yes, -1) AS gold_is_yes, uses_degree_sum, narrates_neighbors, n_node_mentions, resp_chars, target_degree, n_nodes, n_edges FROM frame")
def frame_main(spark, d):
    """Scored responses of all tasks with the facts of their graphs."""
    rows = study.frame(spark, d).select(
        "event_id", "arm", "task", "condition", "density", "graph_id", "pred", "exact", "f1", "abs_error", "signed_error", "parsed", "outcome", "gold_is_yes", "uses_degree_sum", "narrates_neighbors",
        "n_node_mentions", "resp_chars", "target_degree", "n_nodes", "n_edges",
    )
    rows = rows.withColumns({"abs_error": F.coalesce("abs_error", F.lit(-1)), "signed_error": F.coalesce("signed_error", F.lit(0)), "gold_is_yes": F.coalesce("gold_is_yes", F.lit(-1))})
    return _round(rows, "f1")


@report("SELECT task, arm, count(*) AS n, round(avg(parsed) FILTER (NOT hit_cap), 9) AS parsed, round(avg(f1), 9) AS f1, round(avg(abs_error), 9) AS mae, count(DISTINCT graph_id) AS graphs, max(n_tokens) AS longest FROM frame GROUP BY ALL")
def report_setup(spark, d):
    """Counts, parsed shares and means by task and arm."""
    rows = study.frame(spark, d).groupBy("task", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(~F.col("hit_cap"), F.col("parsed"))).alias("parsed"), F.avg("f1").alias("f1"), F.avg("abs_error").alias("mae"),
        F.count_distinct("graph_id").alias("graphs"), F.max("n_tokens").alias("longest"),
    )
    return _round(rows, "parsed", "f1", "mae")


@report("SELECT arm, task, condition, density, count(*) AS rows FROM frame GROUP BY ALL HAVING count(*) < 3")
def check_cells(spark, d):
    """Cells of fewer than three rows."""
    return study.frame(spark, d).groupBy("arm", "task", "condition", "density").agg(F.count(F.lit(1)).alias("rows")).where("rows < 3")


# --- cells and bands ---------------------------------------------------------------------------


@report(_CELLS + " SELECT arm, task, density, condition, n, round(delta, 9) AS delta, broke, fixed, round(baseline, 9) AS baseline, round(acc, 9) AS acc, round(trunc_a, 9) AS trunc_a, round(trunc_b, 9) AS trunc_b, flagged, carries FROM cells")
def report_cells(spark, d):
    rows = _cells(spark, d).select("arm", "task", "density", "condition", "n", "delta", "broke", "fixed", "baseline", "acc", "trunc_a", "trunc_b", "flagged", "carries")
    return _round(rows, "delta", "baseline", "acc", "trunc_a", "trunc_b")


@report(_CELLS + f" SELECT {_BAND} AS band, carries, count(*) AS cells, round(avg(delta), 9) AS delta FROM cells WHERE NOT flagged GROUP BY ALL")
def report_bands(spark, d):
    return _round(reports.by_band(_cells(spark, d).where("not flagged")), "delta")


@report(_CELLS + f", t(threshold) AS (VALUES (0.05), (0.1), (0.15), (0.3), (0.5), (1.01)) SELECT CAST(threshold AS DOUBLE) AS threshold, {_BAND} AS band, carries, count(*) AS cells, round(avg(delta), 9) AS delta FROM cells JOIN t ON tmax < CAST(threshold AS DOUBLE) GROUP BY ALL")
def report_bandsens(spark, d):
    return _round(reports.by_band_and_threshold(_cells(spark, d)), "delta")


@report(_CELLS + " SELECT arm, task, condition, density, round(100 * baseline, 6) AS base, round(100 * trunc_a, 6) AS cut_a, round(100 * acc, 6) AS acc, round(100 * trunc_b, 6) AS cut_b, round(delta, 6) AS delta FROM cells WHERE flagged")
def report_flagged(spark, d):
    c = _cells(spark, d).where("flagged")
    pct = lambda name, to: F.round(100 * F.col(name), 6).alias(to)
    return c.select("arm", "task", "condition", "density", pct("baseline", "base"), pct("trunc_a", "cut_a"), pct("acc", "acc"), pct("trunc_b", "cut_b"), F.round("delta", 6).alias("delta"))


_FOLDS = f""", halves AS (SELECT arm, task, density, condition, greatest(avg(truncated_a), avg(truncated_b)) AS tmax,
  avg(correct_a) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 0) AS b0, 100 * (avg(correct_b) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 1) - avg(correct_a) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 1)) AS d0,
  avg(correct_a) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 1) AS b1, 100 * (avg(correct_b) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 0) - avg(correct_a) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 0)) AS d1 FROM paired WHERE {_VARYING} GROUP BY ALL),
  points AS (SELECT task, condition, b0 AS baseline, d0 AS delta FROM halves WHERE tmax < 0.15 UNION ALL SELECT task, condition, b1, d1 FROM halves WHERE tmax < 0.15)"""


@report(
    _FOLDS
    + """, routes AS (SELECT * FROM points WHERE ((task = 'node_degree' AND condition IN ('degree', 'all', 'rwse')) OR (task = 'edge_count' AND condition IN ('degree', 'all'))) AND baseline IS NOT NULL AND delta IS NOT NULL),
  pooled AS (SELECT task, baseline, delta FROM routes UNION ALL SELECT 'pooled', baseline, delta FROM routes)
  SELECT task, count(*) AS points, round(corr(baseline, delta), 9) AS r, round(regr_slope(delta, baseline), 6) AS slope FROM pooled GROUP BY task"""
)
def report_lcross(spark, d):
    """Cross-fitted baseline against effect on cells whose primer gives a route."""
    gains = [(t, c) for t, c, bar in study.bar_rows() if bar - study.BASE_BARS[t] > study.GAIN and t in ("node_degree", "edge_count")]
    return _round(_round(reports.crossfit(_pairs(spark, d), gains).drop("p"), "r"), "slope", places=6)


@report(_CELLS + " SELECT arm, count(*) AS cells, round(median(baseline), 9) AS median, count(*) FILTER (baseline >= 0.25 AND baseline < 0.75) AS inside, count(*) FILTER (baseline < 0.25) AS below FROM cells WHERE NOT flagged GROUP BY arm")
def report_arms(spark, d):
    return _round(reports.arm_medians(_cells(spark, d)), "median")


@report(f", e AS (SELECT arm, task, condition, {_EFF} FROM paired WHERE task IN ('node_degree', 'edge_existence', 'connected_nodes') AND condition <> 'filler' GROUP BY ALL) SELECT arm, round(max(abs(delta)), 9) AS largest FROM e GROUP BY arm")
def report_null(spark, d):
    """The largest effect of any primer on three tasks, by arm."""
    rows = _pairs(spark, d).where("task in ('node_degree', 'edge_existence', 'connected_nodes') and condition <> 'filler'")
    return _round(rows.groupBy("arm", "task", "condition").agg(*reports.change()).groupBy("arm").agg(F.max(F.abs("delta")).alias("largest")), "largest")


@report(f", e AS (SELECT arm, condition, density, {_EFF} FROM paired WHERE task = 'node_degree' AND condition IN ('degree', 'all') GROUP BY ALL) {_q('e', 'arm')} SELECT arm, condition, density, n, round(delta, 9) AS delta, broke, fixed, round(p, 9) AS p, round(q, 9) AS q FROM adj")
def report_flip(spark, d):
    rows = _pairs(spark, d).where("task = 'node_degree' and condition in ('degree', 'all')")
    return _round(reports.tested(rows, ["arm", "condition", "density"], ["arm"]), "delta", "p", "q")


# --- procedures --------------------------------------------------------------------------------

_ROUTE = r"""CASE WHEN NOT regexp_matches(response, concat('[Nn]ode ', a, '\**\s+is connected to|connected to (?:the following )?nodes|(?:nodes|edges) (?:directly )?connected to (?:\*\*)?node ', a, '\b,? (?:which|that) are')) THEN 'retrieve'
  WHEN len(regexp_extract_all(response, '(?m)^\s*(?:[0-9]+\.|[-*])\s*\**[0-9]+\**\s*$')) >= 5 THEN 'enumerate' ELSE 'assert' END"""
_CONFLICT = r"regexp_matches(regexp_replace(response, '(?i)\b(?:any|no|not|without|whether|if there|check for|check if|to see if)\b[^.!?\n]{0,57}(?:discrepanc|contradict|conflict|inconsisten)', ' ', 'g'), '(?i)discrepanc|contradict|conflict|inconsisten')"


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return study.frame(spark, d).where("task = 'node_degree'").withColumn("route", detect.route(F.col("response"), F.col("a")))


@report(f", r AS (SELECT *, {_ROUTE} AS route FROM frame WHERE task = 'node_degree' AND NOT hit_cap) SELECT arm, condition, route, count(*) AS n, round(avg(exact), 9) AS accuracy FROM r GROUP BY ALL")
def report_route(spark, d):
    rows = _routed(spark, d).where("not hit_cap").groupBy("arm", "condition", "route").agg(F.count(F.lit(1)).alias("n"), F.avg("exact").alias("accuracy"))
    return _round(rows, "accuracy")


@report(f", r AS (SELECT *, {_CONFLICT} AS c FROM frame) SELECT arm, task, condition, count(*) AS n, round(avg(CAST(c AS INTEGER)), 9) AS reported, round(avg(exact) FILTER (c), 9) AS accuracy FROM r GROUP BY ALL")
def report_verify(spark, d):
    """How often a discrepancy is reported, and how often the answer is right then."""
    rows = study.frame(spark, d).withColumn("c", detect.reports_conflict(F.col("response")))
    return _round(rows.groupBy("arm", "task", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("c").cast("int")).alias("reported"), F.avg(F.when(F.col("c"), F.col("exact"))).alias("accuracy")), "reported", "accuracy")


@report("SELECT arm, task, condition, count(*) AS n, CAST(sum(truncated) AS BIGINT) AS cut FROM frame GROUP BY ALL")
def report_trunc(spark, d):
    return study.frame(spark, d).groupBy("arm", "task", "condition").agg(F.count(F.lit(1)).alias("n"), F.sum("truncated").alias("cut"))


@report("SELECT arm, task, count(*) AS n, round(avg(correct_a), 9) AS without, round(avg(correct_b), 9) AS stated FROM paired JOIN bars USING (task, condition) WHERE bar >= 1 AND condition = 'degree' GROUP BY ALL")
def report_recover(spark, d):
    """Accuracy where the primer states the answer, and without it."""
    rows = _pairs(spark, d).join(F.broadcast(_bars(spark)), ["task", "condition"]).where("bar >= 1 and condition = 'degree'")
    return _round(rows.groupBy("arm", "task").agg(F.count(F.lit(1)).alias("n"), F.avg("correct_a").alias("without"), F.avg("correct_b").alias("stated")), "without", "stated")


@report(
    """SELECT arm, condition, count(*) AS n, round(avg(CAST(outcome = 'correct' AS INTEGER)), 9) AS correct, round(avg(CAST(outcome = 'wrong' AS INTEGER)), 9) AS wrong, round(avg(truncated), 9) AS truncated,
  round(avg(exact) FILTER (NOT hit_cap), 9) AS exact_finished, round(avg(uses_degree_sum) FILTER (NOT hit_cap), 9) AS wording,
  round(median(abs(CAST(pred AS DOUBLE) - CAST(gold AS DOUBLE)) / CAST(gold AS DOUBLE)) FILTER (NOT hit_cap AND pred IS NOT NULL AND gold <> '0'), 9) AS relative_error FROM frame WHERE task = 'edge_count' GROUP BY ALL"""
)
def report_edgecount(spark, d):
    rows = reports.outcome_table(study.frame(spark, d).where("task = 'edge_count'"), ["arm", "condition"])
    return _round(rows, "correct", "wrong", "truncated", "exact_finished", "wording", "relative_error")


@report(f", r AS (SELECT *, {_ROUTE.replace('response', 'response_a')} AS ra, {_ROUTE.replace('response', 'response_b')} AS rb FROM paired WHERE task = 'node_degree' AND condition IN ('degree', 'all')) SELECT arm, condition, round(100 * avg(correct_b - correct_a), 9) AS total, round(100 * coalesce(sum(correct_b - correct_a) FILTER (ra <> rb), 0) / count(*), 9) AS switch, round(100 * avg(correct_b - correct_a) - 100 * coalesce(sum(correct_b - correct_a) FILTER (ra <> rb), 0) / count(*), 9) AS stay FROM r GROUP BY ALL")
def report_routesplit(spark, d):
    rows = _pairs(spark, d).where("task = 'node_degree' and condition in ('degree', 'all')")
    routed = rows.withColumns({f"route_{s}": detect.route(F.col(f"response_{s}"), F.col("a")) for s in "ab"})
    return _round(statistics.route_split(routed, ["arm", "condition"]).drop("by_route"), "total", "switch", "stay")


@report(
    f""", r AS (SELECT *, {_ROUTE} AS route FROM frame WHERE task = 'node_degree' AND NOT hit_cap), k AS (SELECT arm, density, count(*) AS k, avg(exact) FILTER (a < 10) AS e, avg(exact) FILTER (a >= 10) AS l FROM r WHERE route = 'retrieve' GROUP BY ALL)
  SELECT arm, CAST(sum(k) AS BIGINT) AS n, round(100 * sum((e - l) * k) / sum(k), 9) AS gap FROM k WHERE e IS NOT NULL AND l IS NOT NULL GROUP BY arm"""
)
def report_position(spark, d):
    """Accuracy of retrievals for queried nodes 0 to 9 less that for the others."""
    rows = _routed(spark, d).where("not hit_cap and route = 'retrieve'")
    return _round(reports.position_gap(rows, ["arm"], F.col("a") < 10), "gap")


# --- yes and no --------------------------------------------------------------------------------


@report(
    """SELECT arm, density, condition, round(avg(CAST(coalesce(pred = 'Yes', false) AS INTEGER)) FILTER (NOT hit_cap), 9) AS yes, round(0.5 * (avg(correct) FILTER (gold_is_yes = 1) + avg(correct) FILTER (gold_is_yes = 0)), 9) AS balanced,
  round(avg(truncated), 9) AS truncated, median(n_tokens) FILTER (NOT hit_cap) AS tokens FROM frame WHERE task = 'edge_existence' GROUP BY ALL"""
)
def report_collapse(spark, d):
    return _round(reports.yes_rates(study.frame(spark, d), ["arm", "density", "condition"]), "yes", "balanced", "truncated")


@report("SELECT arm, condition, count(*) AS n, round(50 * (avg(correct_b - correct_a) FILTER (gold_is_yes = 1) + avg(correct_b - correct_a) FILTER (gold_is_yes = 0)), 9) AS delta FROM paired WHERE task = 'edge_existence' GROUP BY ALL")
def report_eemain(spark, d):
    return _round(reports.balanced_change(_pairs(spark, d), ["arm", "condition"]), "delta")


@report()
def report_eemain_p(spark, d):
    """The same with the exact p of swapping each pair's conditions."""
    rows = _pairs(spark, d).where("task = 'edge_existence'")
    return _round(statistics.balanced_effects(rows, ["arm", "condition"], "gold_is_yes"), "delta", "p")


@report(
    f""", f AS (SELECT arm, condition, CAST(coalesce(pred_a = 'Yes', false) AS INTEGER) AS fa_a, CAST(coalesce(pred_b = 'Yes', false) AS INTEGER) AS fa_b FROM paired WHERE task = 'edge_existence' AND gold_is_yes = 0 AND truncated_a = 0 AND truncated_b = 0),
  e AS (SELECT arm, condition, {_CHANGE.format(v='fa')} FROM f GROUP BY ALL) SELECT arm, condition, n, round(delta, 9) AS delta, broke AS removed, fixed AS added, round({_P}, 9) AS p FROM e"""
)
def report_fa(spark, d):
    return _round(reports.false_alarms(_pairs(spark, d), ["arm", "condition"]), "delta", "p")


@report("SELECT density, count(*) AS n, round(avg(gold_is_yes), 9) AS edges FROM frame WHERE task = 'edge_existence' AND condition = 'none' GROUP BY density")
def report_goldshare(spark, d):
    rows = study.frame(spark, d).where("task = 'edge_existence' and condition = 'none'")
    return _round(rows.groupBy("density").agg(F.count(F.lit(1)).alias("n"), F.avg("gold_is_yes").alias("edges")), "edges")


@report(
    """, e AS (SELECT arm, density, graph_id, condition, pred AS m FROM frame WHERE task = 'edge_count')
  SELECT c.arm, c.condition, count(*) AS n, count(e.m) AS counted, round(avg(CAST((c.pred = 'Yes') = (CAST(e.m AS BIGINT) >= c.n_nodes) AS INTEGER)), 9) AS agree FROM frame c LEFT JOIN e USING (arm, density, graph_id, condition) WHERE c.task = 'cycle_check' AND c.pred IS NOT NULL GROUP BY ALL"""
)
def report_cyclecons(spark, d):
    """Does a yes to a cycle agree with the arm's own edge count against the nodes?"""
    f = study.frame(spark, d)
    counted = f.where("task = 'edge_count'").select("arm", "density", "graph_id", "condition", F.col("pred").alias("m"))
    j = f.where("task = 'cycle_check' and pred is not null").join(counted, ["arm", "density", "graph_id", "condition"], "left")
    agree = ((F.col("pred") == "Yes") == (F.col("m").cast("long") >= F.col("n_nodes"))).cast("int")
    return _round(j.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("counted"), F.avg(agree).alias("agree")), "agree")


@report(
    r""", st AS (SELECT event_id, graph_id, arm, unnest(regexp_extract_all(response, '(?i)\bnode [0-9]+ is connected to node [0-9]+\.')) AS s FROM frame WHERE task = 'edge_existence'),
  k AS (SELECT arm, graph_id, CAST(regexp_extract_all(s, '[0-9]+')[1] AS INTEGER) AS x, CAST(regexp_extract_all(s, '[0-9]+')[2] AS INTEGER) AS y FROM st)
  SELECT arm, count(*) AS claims, count(e.u) AS real FROM k LEFT JOIN edges e ON e.graph_id = k.graph_id AND e.u = least(x, y) AND e.v = greatest(x, y) GROUP BY arm"""
)
def report_eeclaims(spark, d):
    """Edges that answers state, and how many of them the graph has."""
    rows = study.frame(spark, d).where("task = 'edge_existence'").select("arm", "graph_id", F.explode(claims.statements("response")).alias("s"))
    flat = rows.select("arm", "graph_id", F.col("s.node").alias("x"), F.explode("s.nbrs").alias("y"))
    edges, _ = graphs.order_graphs(spark, d)
    j = flat.select("arm", "graph_id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).join(edges.withColumn("hit", F.lit(1)), ["graph_id", "u", "v"], "left")
    return j.groupBy("arm").agg(F.count(F.lit(1)).alias("claims"), F.count("hit").alias("real"))


# --- effects -----------------------------------------------------------------------------------


@report(f", e AS (SELECT arm, condition, {_EFF} FROM paired WHERE task = 'node_degree' AND density >= 35 GROUP BY ALL) {_q('e', 'arm')} SELECT arm, condition, n, round(delta, 9) AS delta, broke, fixed, round(p, 9) AS p, round(q, 9) AS q FROM adj")
def report_clusthi(spark, d):
    rows = _pairs(spark, d).where("task = 'node_degree' and density >= 35")
    return _round(reports.tested(rows, ["arm", "condition"], ["arm"]), "delta", "p", "q")


@report(
    f""", h AS (SELECT *, (n_nodes - 1) * density / 100.0 AS x FROM paired WHERE task = 'node_degree' AND truncated_a = 0 AND truncated_b = 0),
  e AS (SELECT arm, condition, count(*) FILTER (correct_a + correct_b = 0) AS wrong, count(*) FILTER (correct_a + correct_b = 0 AND abs(CAST(pred_b AS DOUBLE) - x) < abs(CAST(pred_a AS DOUBLE) - x)) AS closer,
    count(*) FILTER (correct_a + correct_b = 0 AND abs(CAST(pred_b AS DOUBLE) - x) > abs(CAST(pred_a AS DOUBLE) - x)) AS farther, count(*) FILTER (correct_a = 0 AND correct_b = 1) AS fixes,
    count(*) FILTER (correct_a = 0 AND correct_b = 1 AND signed_error_a > 0) AS "over" FROM h GROUP BY ALL)
  SELECT arm, condition, wrong, closer, farther, fixes, "over", round({_P.replace('broke', 'closer').replace('fixed', 'farther')}, 9) AS p FROM e"""
)
def report_prior(spark, d):
    """Do wrong degrees move to what the density alone suggests?"""
    rows = _pairs(spark, d).where("task = 'node_degree'")
    return _round(reports.hint(rows, ["arm", "condition"], (F.col("n_nodes") - 1) * F.col("density") / 100.0), "p")


@report("SELECT density, count(*) AS n, round(100 * (avg(correct_b) - avg(correct_a)), 9) AS delta, count(*) FILTER (n_components > 1) AS several FROM paired WHERE task = 'connected_nodes' AND condition = 'components' GROUP BY density")
def report_comp(spark, d):
    rows = _pairs(spark, d).where("task = 'connected_nodes' and condition = 'components'")
    out = rows.groupBy("density").agg(F.count(F.lit(1)).alias("n"), (100 * (F.avg("correct_b") - F.avg("correct_a"))).alias("delta"), F.sum((F.col("n_components") > 1).cast("long")).alias("several"))
    return _round(out, "delta")


#: Thousands of characters that a primer of forty nodes has.
KCHARS = {"components": 0.037, "degree": 0.891, "clustering": 1.629, "filler": 1.829, "rwse": 2.949, "all": 4.691}


@report("SELECT arm, condition, count(*) AS n, round(avg(CAST(coalesce(TRY_CAST(pred AS BIGINT) = n_nodes - 1, false) AS INTEGER)), 9) AS one_less, round(avg(exact), 9) AS exact FROM frame WHERE task = 'node_count' AND NOT hit_cap GROUP BY ALL")
def report_nodecount(spark, d):
    rows = study.frame(spark, d).where("task = 'node_count' and not hit_cap")
    less = F.coalesce(F.col("pred").try_cast("long") == F.col("n_nodes") - 1, F.lit(False)).cast("int")
    return _round(rows.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(less).alias("one_less"), F.avg("exact").alias("exact")), "one_less", "exact")


@report(", e AS (SELECT arm, condition, 100 * (avg(correct_b) - avg(correct_a)) AS exact, 100 * (avg(f1_b) - avg(f1_a)) AS f1 FROM paired WHERE task = 'connected_nodes' AND truncated_a = 0 AND truncated_b = 0 GROUP BY ALL) SELECT arm, condition, round(exact, 6) AS exact, round(f1, 6) AS f1 FROM e")
def report_f1(spark, d):
    return _round(reports.exact_against_f1(_pairs(spark, d)).drop("same_way"), "exact", "f1", places=6)


@report(_CELLS + " SELECT count(*) AS cells, round(median(discordance), 9) AS discordance, round(100 * (1.959964 + 0.841621) * sqrt(median(discordance) / 100), 6) AS mde FROM cells WHERE NOT flagged")
def report_power(spark, d):
    return _round(_round(reports.power(_cells(spark, d)), "discordance"), "mde", places=6)


@report(
    f""", l AS (SELECT arm, task, condition, {_EFF}, avg(correct_a) AS base, avg(abs(correct_a - correct_b)) AS disc, greatest(avg(truncated_a), avg(truncated_b)) AS tmax FROM paired GROUP BY ALL) {_q('l', 'arm, task')},
  u AS (SELECT *, 100 * (1.959964 + 0.841621) * sqrt(greatest(disc, 1.0 / n) / n) AS mde FROM adj WHERE q >= 0.05 AND tmax < 0.15)
  SELECT arm, count(*) AS null_cells, count(*) FILTER (100 * (1 - base) < mde OR 100 * base < mde) AS blocked, round(median(mde) FILTER (100 * (1 - base) >= mde), 6) AS median_mde FROM u GROUP BY arm"""
)
def report_lmde(spark, d):
    return _round(reports.detectability(_pairs(spark, d)), "median_mde", places=6)


@report(
    """, j AS (SELECT d.arm, d.condition, d.correct AS cd, n.correct AS cn, d.truncated + n.truncated = 0 AND d.parsed + n.parsed = 2 AND TRY_CAST(d.pred AS INTEGER) = CASE WHEN regexp_matches(n.pred, '(?i)no nodes?') THEN 0 ELSE len(list_distinct(regexp_extract_all(n.pred, '-?[0-9]+'))) END AS agree
  FROM frame d JOIN frame n USING (arm, density, graph_id, condition) WHERE d.task = 'node_degree' AND n.task = 'connected_nodes')
  SELECT arm, condition, count(*) AS n, round(avg(cd * cn), 9) AS "both", round(avg(CAST(coalesce(agree, false) AS INTEGER)), 9) AS consistent FROM j GROUP BY ALL"""
)
def report_joint(spark, d):
    return _round(reports.joint(study.frame(spark, d)), "both", "consistent")


_MAIN = f""", two AS (SELECT arm, task, density, graph_id, 'none' AS control, condition, correct_a, correct_b, truncated_a, truncated_b, abs_error_a, abs_error_b FROM paired UNION ALL
  SELECT a.arm, a.task, a.density, a.graph_id, 'filler', b.condition, a.correct, b.correct, a.truncated, b.truncated, a.abs_error, b.abs_error FROM frame a JOIN frame b USING (arm, task, density, graph_id) WHERE a.condition = 'filler' AND b.condition NOT IN ('filler', 'none')),
  e AS (SELECT arm, task, control, condition, {_EFF}, 100 * (avg(truncated_b) - avg(truncated_a)) AS d_truncated, avg(abs_error_b) - avg(abs_error_a) AS d_error, greatest(avg(truncated_a), avg(truncated_b)) >= 0.15 AS flagged FROM two GROUP BY ALL)"""


def _main(spark: SparkSession, d: str) -> DataFrame:
    f = study.frame(spark, d)
    values = ("correct", "truncated", "abs_error")
    none = study.pairs(f, "none", values).withColumn("control", F.lit("none"))
    filler = study.pairs(f.where("condition <> 'none'"), "filler", values).withColumn("control", F.lit("filler"))
    return none.unionByName(filler)


@report(_MAIN + _q("e", "arm, task, control") + " SELECT arm, task, control, condition, n, round(delta, 9) AS delta, broke, fixed, round(d_truncated, 9) AS d_truncated, round(d_error, 9) AS d_error, flagged, round(p, 9) AS p, round(q, 9) AS q FROM adj")
def report_main(spark, d):
    """The main table: every arm, task and condition against no primer and against filler."""
    group = ["arm", "task", "control", "condition"]
    rows = _main(spark, d).groupBy(*group).agg(
        *reports.change(), (100 * (F.avg("truncated_b") - F.avg("truncated_a"))).alias("d_truncated"), (F.avg("abs_error_b") - F.avg("abs_error_a")).alias("d_error"),
        (F.greatest(F.avg("truncated_a"), F.avg("truncated_b")) >= reports.FLAG).alias("flagged"),
    )
    out = inference.with_q(inference.with_mcnemar(rows), family=["arm", "task", "control"])
    return _round(out, "delta", "d_truncated", "d_error", "p", "q")


@report("SELECT task, condition, bar FROM bars WHERE bar > 0.5")
def report_bars(spark, d):
    return _bars(spark).where("bar > 0.5")


@report(f", j AS (SELECT a.task, a.condition, a.correct AS correct_a, b.correct AS correct_b FROM frame a JOIN frame b USING (task, density, graph_id, condition) WHERE a.arm = 'm0' AND b.arm = 'm1'), e AS (SELECT task, condition, {_EFF}, avg(correct_a) AS base FROM j GROUP BY ALL) SELECT task, condition, n, round(delta, 9) AS delta, broke, fixed, round({_P}, 9) AS p, round(CASE WHEN base < 1 THEN delta / (100 * (1 - base)) END, 9) AS gap_closed FROM e")
def report_vsthink(spark, d):
    return _round(reports.cross_arm(study.frame(spark, d), "m0", "m1"), "delta", "p", "gap_closed")


@report()
def report_vsequiv(spark, d):
    """Which conditions change nothing: a 90 % interval within three points."""
    rows = _pairs(spark, d)
    return _round(statistics.equivalent(rows, ["task", "condition"], ["density"], draws=1000), "delta", "low", "high", "p")


@report(", g AS (SELECT arm, task, condition, 100 * avg(correct_b - correct_a) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 0) AS x, 100 * avg(correct_b - correct_a) FILTER (CAST(floor(graph_id / 4) AS BIGINT) % 2 = 1) AS y FROM paired GROUP BY ALL) SELECT arm, task, condition, round(x, 9) AS chosen, round(y, 9) AS kept FROM g WHERE x IS NOT NULL AND y IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm, task ORDER BY x DESC, condition) = 1")
def report_vscross(spark, d):
    return _round(reports.best_by_fold(_pairs(spark, d)), "chosen", "kept")


@report(
    f", e AS (SELECT arm, task, condition, {_EFF} FROM paired GROUP BY ALL) {_q('e', '', 'a0')} {_q('e', 'arm', 'a1')} {_q('e', 'arm, task', 'a2')} SELECT 'all' AS scope, count(*) AS tests, count(*) FILTER (q < 0.05) AS significant FROM a0 UNION ALL SELECT 'arm', count(*), count(*) FILTER (q < 0.05) FROM a1 UNION ALL SELECT 'task', count(*), count(*) FILTER (q < 0.05) FROM a2"
)
def report_globalbh(spark, d):
    return reports.significant_by_scope(_pairs(spark, d))


# --- robustness and directions -----------------------------------------------------------------


@report(", u AS (SELECT arm, task, density, graph_id, count(*) AS k, sum(correct) AS c FROM frame GROUP BY ALL HAVING count(*) >= 2) SELECT arm, task, count(*) AS units, count(*) FILTER (c = k) AS always, count(*) FILTER (c = 0) AS never, count(*) FILTER (c > 0 AND c < k) AS mixed FROM u GROUP BY ALL")
def report_churn(spark, d):
    return reports.churn(study.frame(spark, d))


@report(", r AS (SELECT arm, task, density, graph_id, condition, correct_b = 0 AS x FROM paired WHERE correct_a = 1) SELECT a.arm, a.task, a.condition AS \"first\", b.condition AS \"second\", count(*) FILTER (a.x) AS broke_first, count(*) FILTER (b.x) AS broke_second, count(*) FILTER (a.x AND b.x) AS \"both\" FROM r a JOIN r b USING (arm, task, density, graph_id) WHERE a.condition < b.condition GROUP BY ALL")
def report_overlap(spark, d):
    return reports.broken_overlap(_pairs(spark, d))


@report(
    """, j AS (SELECT a.task, a.density, a.condition, a.correct AS x, b.correct AS y FROM frame a JOIN frame b USING (task, density, graph_id, condition) WHERE a.arm = 'm0' AND b.arm = 'm1'),
  s AS (SELECT task, density, condition, count(*) AS n, avg(x) AS pa, avg(y) AS pb, avg(CAST(x = y AS INTEGER)) AS o FROM j GROUP BY ALL), t AS (SELECT task, sum(n) AS n, sum(n * o) / sum(n) AS ob, sum(n * (pa * pb + (1 - pa) * (1 - pb))) / sum(n) AS ex FROM s GROUP BY task)
  SELECT task, CAST(n AS BIGINT) AS n, round(ob, 9) AS observed, round(ex, 9) AS expected, round(CASE WHEN ex < 1 THEN (ob - ex) / (1 - ex) END, 9) AS kappa FROM t"""
)
def report_crossarm(spark, d):
    return _round(reports.agreement(study.frame(spark, d), "m0", "m1"), "observed", "expected", "kappa")


@report("SELECT task, condition, median(n_tokens) FILTER (correct = 1) AS right_tokens, median(n_tokens) FILTER (correct = 0) AS wrong_tokens FROM frame WHERE NOT hit_cap GROUP BY ALL")
def report_lenmed(spark, d):
    rows = study.frame(spark, d).where("not hit_cap")
    return rows.groupBy("task", "condition").agg(F.median(F.when(F.col("correct") == 1, F.col("n_tokens"))).alias("right_tokens"), F.median(F.when(F.col("correct") == 0, F.col("n_tokens"))).alias("wrong_tokens"))


@report()
def report_lentest(spark, d):
    """Do wrong answers differ in length? Rank sums by task."""
    rows = study.frame(spark, d).where("not hit_cap")
    return _round(statistics.mann_whitney(rows, ["task"], "correct", "n_tokens"), "p")


@report(
    """, s AS (SELECT task, n_tokens, correct, rank() OVER (PARTITION BY task ORDER BY n_tokens) + (count(*) OVER (PARTITION BY task, n_tokens) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY task ORDER BY correct) + (count(*) OVER (PARTITION BY task, correct) - 1) / 2.0 AS rc FROM frame WHERE NOT hit_cap) SELECT task, count(*) AS n, round(corr(rt, rc), 9) AS r FROM s GROUP BY task"""
)
def report_lencorr(spark, d):
    """Rank correlation of length and correctness."""
    rows = study.frame(spark, d).where("not hit_cap")
    return _round(statistics.spearman(rows, ["task"], "n_tokens", "correct").drop("p"), "r")


@report(_CELLS + f" SELECT {_BAND} AS band, count(*) AS cells, round(avg(delta), 9) AS delta FROM cells WHERE condition = 'filler' AND NOT flagged GROUP BY ALL")
def report_fillerband(spark, d):
    rows = _cells(spark, d).where("condition = 'filler' and not flagged")
    return _round(reports.by_band(rows).groupBy("band").agg(F.sum("cells").alias("cells"), (F.sum(F.col("delta") * F.col("cells")) / F.sum("cells")).alias("delta")), "delta")


@report("SELECT task, arm, count(*) AS n, round(avg(CAST(abs(signed_error) <= 1 AS INTEGER)), 9) AS one, round(avg(CAST(abs(signed_error) <= 3 AS INTEGER)), 9) AS three, round(avg(CAST(signed_error > 0 AS INTEGER)), 9) AS \"over\" FROM frame WHERE NOT hit_cap AND exact = 0 AND signed_error IS NOT NULL GROUP BY ALL")
def report_errors(spark, d):
    return _round(reports.off_by(study.frame(spark, d), ["task", "arm"]), "one", "three", "over")


@report(
    """, t AS (SELECT *, least(2, floor(3 * (row_number() OVER (PARTITION BY condition, density ORDER BY target_degree, arm, graph_id) - 1) / count(*) OVER (PARTITION BY condition, density))) AS t FROM paired WHERE task = 'node_degree')
  SELECT condition, CAST(t AS INTEGER) AS tercile, count(*) AS n, round(100 * (avg(correct_b) - avg(correct_a)), 9) AS delta FROM t GROUP BY ALL"""
)
def report_pdnode(spark, d):
    """The effect by thirds of the queried node's degree."""
    rows = _pairs(spark, d).where("task = 'node_degree'")
    return _round(reports.effect_by_tercile(rows, ["target_degree", "arm", "graph_id"]), "delta")


@report("SELECT condition, CAST(floor(a / 10) AS BIGINT) AS quarter, count(*) AS n, round(avg(correct), 9) AS accuracy FROM frame WHERE task = 'node_degree' GROUP BY ALL")
def report_pdposition(spark, d):
    rows = study.frame(spark, d).where("task = 'node_degree'").groupBy("condition", F.floor(F.col("a") / 10).alias("quarter"))
    return _round(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy")), "accuracy")


@report(
    rf""", s AS (SELECT arm, condition, pred, gold, {_CONFLICT} AS c, list_filter(list_concat(regexp_extract_all(response, '(?i)\b(?:that(?:''s| is)|total(?: of)?|there are)\s*([0-9]+)\b', 1), regexp_extract_all(response, '(?i)\b([0-9]+)\s+(?:nodes|neighbou?rs|connections|edges)\b', 1)), lambda x: len(x) > 0) AS own
  FROM (SELECT arm, condition, pred, gold, replace(response, '*', '') AS response FROM frame WHERE task = 'node_degree' AND NOT hit_cap AND pred IS NOT NULL))
  SELECT arm, condition, CASE WHEN pred = gold THEN 'stated' WHEN list_contains(own, pred) THEN 'own' ELSE 'other' END AS source, count(*) AS n FROM s WHERE c GROUP BY ALL"""
)
def report_pdsource(spark, d):
    """Where the answers of responses that report a conflict come from."""
    rows = study.frame(spark, d).where("task = 'node_degree' and not hit_cap and pred is not null").where(detect.reports_conflict(F.col("response")))
    kind = claims.answer_source(F.col("pred").cast("int"), F.col("gold").cast("int"), claims.stated_values("response"))
    return rows.select("arm", "condition", kind.alias("source")).groupBy("arm", "condition", "source").agg(F.count(F.lit(1)).alias("n"))


@report(f", e AS (SELECT condition, density, {_EFF} FROM paired GROUP BY GROUPING SETS ((condition, density), (condition))) SELECT condition, coalesce(density, 0) AS density, n, round(delta, 9) AS delta, broke, fixed, round({_P}, 9) AS p FROM e")
def report_levels(spark, d):
    """Effects by density, and pooled as density 0."""
    return _round(reports.levels(_pairs(spark, d)).withColumn("density", F.coalesce("density", F.lit(0))), "delta", "p")


@report(_CELLS + " SELECT arm, task, condition, round(regr_slope(delta, density / 100.0), 6) AS slope, round(var_pop(delta), 6) AS \"between\", count(*) AS levels FROM cells GROUP BY ALL HAVING count(*) >= 2")
def report_dxhet(spark, d):
    """How effects move with density."""
    return _round(reports.density_slope(_cells(spark, d)), "slope", "between", places=6)


@report()
def report_trend(spark, d):
    """The same by permutation over graphs: slope and spread between densities."""
    rows = _pairs(spark, d).withColumn("d", F.col("correct_b") - F.col("correct_a"))
    return _round(statistics.trend(rows, ["condition"], "density", "d", draws=200), "slope", "between", "p_slope", "p_between")


@report("SELECT task, CASE WHEN resp_chars < 20 THEN '[0,20)' WHEN resp_chars < 40 THEN '[20,40)' WHEN resp_chars < 80 THEN '[40,80)' ELSE '[80,1000)' END AS bin, count(*) AS n, round(avg(correct), 9) AS accuracy FROM frame GROUP BY ALL")
def report_histogram(spark, d):
    return _round(reports.by_strata(study.frame(spark, d), "resp_chars", [0, 20, 40, 80, 1000]), "accuracy")


@report(", s AS (SELECT arm, task, event_id, row_number() OVER (PARTITION BY arm, task ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY arm, task) AS n FROM frame WHERE outcome = 'wrong') SELECT arm, task, event_id FROM s WHERE r % greatest(1, CAST(floor(n / 4) AS BIGINT)) = 0 AND r / greatest(1, CAST(floor(n / 4) AS BIGINT)) < 4")
def report_sample(spark, d):
    """Four wrong answers of each arm and task at even distances."""
    rows = study.frame(spark, d).where("outcome = 'wrong'")
    return reports.evenly_spaced(rows, ["arm", "task"], ["event_id"], 4).select("arm", "task", "event_id")


_FLAGS = {
    "names_components": r"\bcomponents?\b", "names_degree": r"\bdegrees?\b", "degree_sum": r"divide[d]?\s+by\s+2|divided by two|sum of (?:the )?degrees|handshak", "hedges": r"\b(?:likely|unlikely|probably)\b",
    "tree_bound": r"\bn\s*-\s*1\b",
}


@report("SELECT task, " + ", ".join(f"CAST(sum(CAST(regexp_matches(response, '(?i){rx}') AS INTEGER)) AS BIGINT) AS {n}" for n, rx in _FLAGS.items() if n in ("names_components", "names_degree", "degree_sum")) + " FROM frame WHERE task = 'edge_count' GROUP BY task")
def report_patterns(spark, d):
    """How many responses show a pattern."""
    rows = study.frame(spark, d).where("task = 'edge_count'").withColumn("targets", F.array("a"))
    flags = rows.select("task", *detect.pattern_flags(F.col("response"), F.col("targets"), F.col("task")))
    return flags.groupBy("task").agg(*(F.sum(n).alias(n) for n in ("names_components", "names_degree", "degree_sum")))


@report(
    r""", tok AS (SELECT event_id, arm, condition, regexp_extract_all(regexp_replace(regexp_replace(lower(response), '[0-9]+\.[0-9]+', '<dec>', 'g'), '[0-9]+', '<num>', 'g'), '<dec>|<num>|[a-z]+|[+=→|/×*√]') AS w FROM frame WHERE condition IN ('none', 'degree')),
  g AS (SELECT DISTINCT event_id, condition, concat(w[i], ' ', w[i + 1]) AS gram FROM (SELECT event_id, condition, w, unnest(range(1, len(w))) AS i FROM tok)), n AS (SELECT condition, count(*) AS n FROM tok GROUP BY ALL)
  SELECT gram, round(count(*) FILTER (condition = 'degree') / (SELECT n FROM n WHERE condition = 'degree') - count(*) FILTER (condition = 'none') / (SELECT n FROM n WHERE condition = 'none'), 9) AS shift FROM g GROUP BY gram"""
)
def report_contrast(spark, d):
    """Word pairs by how their share of responses moves from no primer to degrees."""
    rows = study.frame(spark, d).where("condition in ('none', 'degree')")
    total = F.broadcast(rows.agg(*(F.sum((F.col("condition") == c).cast("long")).alias(f"n_{c}") for c in ("none", "degree"))))
    grams = rows.select("condition", F.explode(detect.ngrams(F.col("response"), 2)).alias("gram")).groupBy("gram").agg(*(F.sum((F.col("condition") == c).cast("long")).alias(c) for c in ("none", "degree")))
    return _round(grams.crossJoin(total).select("gram", (F.col("degree") / F.col("n_degree") - F.col("none") / F.col("n_none")).alias("shift")), "shift")


# --- answers held against the graph ------------------------------------------------------------


@report(
    """, c AS (SELECT arm, condition, density, graph_id, ids, pred FROM frame WHERE task = 'connected_nodes' AND NOT hit_cap AND pred IS NOT NULL)
  SELECT e.arm, e.condition, count(*) AS n, round(avg(CAST((NOT regexp_matches(c.pred, '(?i)no nodes?') AND list_contains(c.ids, CAST(e.b AS VARCHAR))) = (e.pred = 'Yes') AS INTEGER)), 9) AS agree
  FROM frame e JOIN c USING (arm, condition, density, graph_id) WHERE e.task = 'edge_existence' AND NOT e.hit_cap AND e.pred IS NOT NULL GROUP BY ALL"""
)
def report_pdconsist(spark, d):
    """Does an answer on an edge agree with the arm's own list of the node's neighbours?"""
    f = study.frame(spark, d).where("not hit_cap and pred is not null")
    keys = ["arm", "condition", "density", "graph_id"]
    lists = f.where("task = 'connected_nodes'").select(*keys, answers.node_set(F.col("pred")).alias("ids"))
    j = f.where("task = 'edge_existence'").join(lists, keys)
    agree = claims.consistent(F.col("ids"), F.col("b"), F.col("pred") == "Yes").cast("int")
    return _round(j.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(agree).alias("agree")), "agree")


@report(
    r""", s AS (SELECT arm, condition, target_degree, gold, regexp_extract(response, '(?i)\bnode [0-9]+ is connected to nodes ([0-9]+(?:, [0-9]+)*)\.', 1) AS l FROM frame WHERE task = 'connected_nodes')
  SELECT arm, condition, count(*) AS lists, count(*) FILTER (l = gold) AS "right", round(avg(len(string_split(l, ', ')) - target_degree), 9) AS excess FROM s WHERE l <> '' GROUP BY ALL"""
)
def report_ndlist(spark, d):
    """Lists of neighbours as answers state them, against the graph's."""
    rows = study.frame(spark, d).where("task = 'connected_nodes'").select("arm", "condition", "nbrs", F.explode(claims.statements("response")).alias("s"))
    right = (F.array_sort("s.nbrs") == F.array_sort("nbrs")).cast("long")
    return _round(rows.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("lists"), F.sum(right).alias("right"), F.avg(F.size("s.nbrs") - F.size("nbrs")).alias("excess")), "excess")


@report(
    """, q AS (SELECT p.*, x.degree + y.degree AS ds FROM paired p JOIN tg USING (graph_id) JOIN deg x ON x.graph_id = p.graph_id AND x.node = tg.a JOIN deg y ON y.graph_id = p.graph_id AND y.node = tg.b WHERE task = 'edge_existence' AND gold_is_yes = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY density ORDER BY ds, arm, graph_id, condition) AS k, count(*) OVER (PARTITION BY density) AS m FROM q)
  SELECT CAST(CASE WHEN m > 1 THEN greatest(0, ceil(4 * (k - 1) / (m - 1)) - 1) ELSE 0 END AS INTEGER) AS stratum, count(*) AS n, round(avg(CAST(coalesce(pred_a = 'Yes', false) AS INTEGER)), 9) AS without, round(avg(CAST(coalesce(pred_b = 'Yes', false) AS INTEGER)), 9) AS stated FROM r GROUP BY 1"""
)
def report_eedegree(spark, d):
    """False alarms by quarters of the pair's degree sum within density."""
    edges, nodes = graphs.order_graphs(spark, d)
    asked = tasks.targets(nodes).where("b is not null")
    values = structure.degrees(edges, nodes).select("graph_id", "node", F.col("degree").cast("string").alias("degree"), F.lit("0").alias("clustering"), F.lit("0").alias("rwse2"))
    sums = features.pair_features(values, asked).select("graph_id", "degree_sum")
    rows = _pairs(spark, d).where("task = 'edge_existence' and gold_is_yes = 0").join(sums, "graph_id")
    ranked = inference.quartile_strata(rows, ["density"], ["degree_sum", "arm", "graph_id", "condition"])
    yes = lambda s: F.avg(F.coalesce(F.col(f"pred_{s}") == "Yes", F.lit(False)).cast("int"))
    return _round(ranked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), yes("a").alias("without"), yes("b").alias("stated")), "without", "stated")


@report(
    """, r AS (SELECT graph_id, node, least(2, floor(3 * (rank() OVER (PARTITION BY graph_id ORDER BY degree) + (count(*) OVER (PARTITION BY graph_id, degree) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY graph_id))) AS t FROM deg)
  SELECT condition, CAST(t AS INTEGER) AS tercile, count(*) AS n, round(100 * (avg(correct_b) - avg(correct_a)), 9) AS delta FROM paired p JOIN r ON r.graph_id = p.graph_id AND r.node = p.a WHERE task = 'node_degree' GROUP BY ALL"""
)
def report_pdtercile(spark, d):
    """The effect by where the queried node's degree ranks in its graph."""
    thirds = features.degree_terciles(*graphs.order_graphs(spark, d)).withColumnRenamed("node", "a")
    rows = _pairs(spark, d).where("task = 'node_degree'").join(thirds, ["graph_id", "a"])
    return _round(rows.groupBy("condition", "tercile").agg(F.count(F.lit(1)).alias("n"), (100 * (F.avg("correct_b") - F.avg("correct_a"))).alias("delta")), "delta")


def report_informativeness(spark, d):
    """How far printed clustering pins the degrees of a graph."""
    values = features.printed_values(*graphs.order_graphs(spark, d))
    return _round(features.informativeness(values, ["clustering"]), "share", "gain")


def report_blindbar(spark, d):
    """A lookup of degrees by printed clustering, fitted on even graphs, against the majority on odd ones."""
    edges, nodes = graphs.order_graphs(spark, d)
    values = features.printed_values(edges, nodes).select("graph_id", F.col("node").alias("a"), F.col("clustering").alias("key"), F.col("degree").alias("gold"))
    rows = values.join(tasks.targets(nodes).select("graph_id", "a"), ["graph_id", "a"])
    fit, test = rows.where("graph_id % 2 = 0"), rows.where("graph_id % 2 = 1")
    base = F.broadcast(inference.majority(fit, [], "gold", largest=True).select(F.col("answer").alias("base")))
    judged = solver.apply_lookup(test, solver.fit_lookup(fit, ["key"]), ["key"]).crossJoin(base)
    hit = lambda c: F.avg((c == F.col("gold")).cast("double"))
    return _round(judged.agg(F.count(F.lit(1)).alias("n"), hit(F.coalesce("answer", "base")).alias("lookup"), hit(F.col("base")).alias("majority")), "lookup", "majority")


# --- prompts read back, rules fitted -----------------------------------------------------------


def _on_graphs(body: str, reach: bool = False) -> str:
    return f"WITH {'RECURSIVE' if reach else ''} {GRAPHS} {REACH if reach else ''} {body}"


def parse_incident(spark, d):
    """Edges read back from the one-line-a-node text of every graph."""
    texts = encode.encode(*graphs.order_graphs(spark, d), "incident")
    return prompts.edge_table(texts.select("graph_id", prompts.incident_edges(F.col("text")).alias("edges")))


def parse_adjacency(spark, d):
    """Edges read back from the list-of-pairs text of every graph."""
    texts = encode.encode(*graphs.order_graphs(spark, d), "adjacency")
    return prompts.edge_table(texts.select("graph_id", prompts.adjacency_edges(F.col("text")).alias("edges")))


def parse_prompts(spark, d):
    """Nodes, edges, lines and targets read off whole prompts, by task."""
    edges, nodes = graphs.order_graphs(spark, d)
    built = prompts.build_corpus(edges, nodes, ["node_degree", "edge_existence"], ["none", "degree"])
    read = prompts.graphs_of_prompts(built)
    out = read.select("instance_id", F.size("nodes").alias("n"), F.size("edges").alias("m"), F.size("lines").alias("listed"), F.concat_ws(",", F.transform("targets", lambda t: t.cast("string"))).alias("targets"), "gold")
    return out


def retrieval_probe(spark, d):
    """Degree statements without a graph: which one is asked, and what it says."""
    return prompts.retrieval_probe(spark, [10, 40], [0.1, 0.5, 0.9], 20).select("instance_id", "gold", F.regexp_extract("prompt", r"degree of node ([0-9]+)\?", 1).alias("asked"), prompts.stated(F.col("prompt"), "degree").alias("said")).select(
        "instance_id", "asked", (F.try_element_at("said", F.col("asked").cast("int")).cast("string") == F.col("gold")).alias("found"), F.size("said").alias("statements")
    )


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """What the whole primer of every graph states, as parsed: a table that a session derives once, whatever tasks read it."""
    from graphspark.operators import primer

    make = lambda: primer.parse(primer.render(*graphs.order_graphs(spark, d), "all")).drop("primer")
    return derived(spark, "parsed-primers", [f"{d}/{t}.parquet" for t in ("orders", "lineitem")], make)


def _known_contexts(spark: SparkSession, d: str, task: str) -> DataFrame:
    """Contexts with the statistics that a primer states, as parsed, folds by parity."""
    edges, nodes = graphs.order_graphs(spark, d)
    asked = tasks.targets(nodes)
    gold = tasks.gold(task, edges, nodes, asked).select("graph_id", "a", "b", F.substring_index("gold", ",", 1 if task == "cycle_check" else -1).alias("gold"))
    rows = _parsed(spark, d).join(gold, "graph_id").where("b is not null").withColumn("m", F.lit(None).cast("int")).withColumn("fold", F.col("graph_id") % 2)
    return rows.withColumn("n", F.size("ns").cast("int"))


def _feature_rows(spark: SparkSession, d: str, task: str) -> DataFrame:
    """What the rules of a task read, written down, as fits read it often."""
    return settled(solver.with_features(_known_contexts(spark, d, task), task))


def solver_ranked(spark, d):
    """Fitted rules in their order, with coverage and accuracy on the other half of the graphs."""
    out = None
    for task in ("edge_existence", "node_count"):
        rows = _feature_rows(spark, d, task)
        one = solver.rule_table(rows.where("fold = 0"), rows.where("fold = 1"), task).select(F.lit(task).alias("task"), "rule", "how", "coverage", "accuracy")
        out = one if out is None else out.unionByName(one)
    return _round(out, "coverage", "accuracy")


def solver_inflation(spark, d):
    """A lookup's accuracy on the graphs it was fitted on, and on others."""
    rows = _feature_rows(spark, d, "node_count")
    return _round(solver.inflation(rows.where("fold = 0"), rows.where("fold = 1"), "node_count"), "in_sample", "out_of_sample")


def solver_cells(spark, d):
    """The bar of each task: majority, and the solver with theorems, fitted rules and majority behind them."""
    out = None
    for task in ("edge_existence", "node_degree", "edge_count", "node_count"):
        rows = _feature_rows(spark, d, task)
        one = solver.score_cell(rows.where("fold = 0"), rows.where("fold = 1"), task).select(F.lit(task).alias("task"), "rows", "baseline_answer", "baseline", "shortcut")
        out = one if out is None else out.unionByName(one)
    return _round(out, "baseline", "shortcut")


def solver_reconstruction(spark, d):
    """How many neighbour lists a whole primer leaves as the only one, and how many of those are right."""
    rows = solver.apply_theorems(_known_contexts(spark, d, "connected_nodes"), "connected_nodes")
    return rows.groupBy("theorem").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("theorem_answer") == F.col("gold")).cast("long")).alias("right"))


def island_bounds(spark, d):
    """On all graphs of five nodes: what degrees alone leave open on an edge and on the first node's neighbours."""
    g = graphs.labelled_graphs(spark, 5)
    edge = F.when(F.exists("edges", lambda e: (e[0] == 0) & (e[1] == 1)), "Yes").otherwise("No")
    near = F.array_join(F.transform(F.filter("edges", lambda e: e[0] == 0), lambda e: e[1].cast("string")), ", ")
    out = None
    for task, answer in (("edge_existence", edge), ("connected_nodes", near)):
        one = solver.island_bounds(solver.island_answers(g, answer)).select(F.lit(task).alias("task"), "rows", "determined", "bayes")
        out = one if out is None else out.unionByName(one)
    return _round(out, "determined", "bayes")


QUERIES |= {
    f.__name__: f
    for f in (parse_incident, parse_adjacency, parse_prompts, retrieval_probe, solver_ranked, solver_inflation, solver_cells, solver_reconstruction, island_bounds, report_informativeness, report_blindbar)
}
_PRINTED = "printf('%.2f', round(clustering, 6))"
SQL |= {
    "report_informativeness": _on_graphs(
        f""", v AS (SELECT graph_id, {_PRINTED} AS c, degree FROM clus), k AS (SELECT graph_id, c, degree, count(*) AS k FROM v GROUP BY ALL), h AS (SELECT graph_id, sum(k) AS h FROM (SELECT graph_id, c, max(k) AS k FROM k GROUP BY ALL) GROUP BY graph_id),
        b AS (SELECT graph_id, max(k) AS mode, sum(k) AS n FROM (SELECT graph_id, degree, count(*) AS k FROM v GROUP BY ALL) GROUP BY graph_id)
        SELECT graph_id, round(h / n, 9) AS share, round(CASE WHEN mode < n THEN (h / n - mode / n) / (1 - mode / n) ELSE 0.0 END, 9) AS gain FROM h JOIN b USING (graph_id)"""
    ),
    "report_blindbar": _on_graphs(
        f""", v AS (SELECT c.graph_id, {_PRINTED} AS key, CAST(c.degree AS VARCHAR) AS gold FROM clus c JOIN tg ON tg.graph_id = c.graph_id AND tg.a = c.node),
        k AS (SELECT key, gold, count(*) AS n FROM v WHERE graph_id % 2 = 0 GROUP BY ALL), t AS (SELECT key, gold AS said FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, gold DESC) = 1),
        m AS (SELECT gold AS base FROM v WHERE graph_id % 2 = 0 GROUP BY gold ORDER BY count(*) DESC, gold DESC LIMIT 1)
        SELECT count(*) AS n, round(avg(CAST(coalesce(said, base) = gold AS INTEGER)), 9) AS lookup, round(avg(CAST(base = gold AS INTEGER)), 9) AS majority FROM v CROSS JOIN m LEFT JOIN t USING (key) WHERE graph_id % 2 = 1"""
    ),
    "parse_incident": _on_graphs("SELECT graph_id, u, v FROM edges"),
    "parse_adjacency": _on_graphs("SELECT graph_id, u, v FROM edges"),
    "parse_prompts": _on_graphs(
        """, n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL), l AS (SELECT graph_id, count(DISTINCT node) AS l FROM arcs GROUP BY ALL),
        g AS (SELECT t.graph_id, t.a, t.b, n, coalesce(m, 0) AS m, coalesce(l, 0) AS l, d.degree, CASE WHEN e.u IS NULL THEN 'No' ELSE 'Yes' END AS edge FROM tg t JOIN n USING (graph_id) LEFT JOIN m USING (graph_id) LEFT JOIN l USING (graph_id)
          JOIN deg d ON d.graph_id = t.graph_id AND d.node = t.a LEFT JOIN edges e ON e.graph_id = t.graph_id AND e.u = least(t.a, t.b) AND e.v = greatest(t.a, t.b))
        SELECT 'node_degree/graph/' || graph_id AS instance_id, CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m, CAST(l AS INTEGER) AS listed, CAST(a AS VARCHAR) AS targets, CAST(degree AS VARCHAR) AS gold FROM g
        UNION ALL SELECT 'edge_existence/graph/' || graph_id, CAST(n AS INTEGER), CAST(m AS INTEGER), CAST(l AS INTEGER), a || ',' || b, edge FROM g WHERE b IS NOT NULL"""
    ),
    "retrieval_probe": """
        SELECT 'retrieval/k' || k || '/pos' || p || '/' || mag || '/' || i AS instance_id, CAST(least(k - 1, greatest(0, CAST(round_even(CAST(p AS DOUBLE) * (k - 1), 0) AS INTEGER))) AS VARCHAR) AS asked, true AS found, CAST(k AS INTEGER) AS statements
        FROM (VALUES (10), (40)) a(k), (VALUES ('0.1'), ('0.5'), ('0.9')) b(p), (VALUES ('small'), ('large')) c(mag), range(20) d(i)""",
    "solver_inflation": _on_graphs(
        """, r AS (SELECT graph_id % 2 AS fold, count(*) AS gold, max(degree) AS k FROM deg JOIN tg USING (graph_id) WHERE b IS NOT NULL GROUP BY graph_id),
        c AS (SELECT fold, k, gold, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT fold, k, gold AS said FROM c QUALIFY row_number() OVER (PARTITION BY fold, k ORDER BY n DESC, CAST(gold AS VARCHAR) DESC) = 1),
        maj AS (SELECT gold FROM r WHERE fold = 0 GROUP BY gold ORDER BY count(*) DESC, CAST(gold AS VARCHAR) DESC LIMIT 1)
        SELECT 'node_count_from_max_degree' AS rule, round(avg(CAST(coalesce(i.said, (SELECT gold FROM maj)) = r.gold AS INTEGER)), 9) AS in_sample, round(avg(CAST(coalesce(o.said, (SELECT gold FROM maj)) = r.gold AS INTEGER)), 9) AS out_of_sample
        FROM r LEFT JOIN t i ON i.fold = 1 AND i.k = r.k LEFT JOIN t o ON o.fold = 0 AND o.k = r.k WHERE r.fold = 1"""
    ),
    "island_bounds": """
        WITH p AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS i, a, b FROM range(5) x(a), range(5) y(b) WHERE a < b),
        d AS (SELECT mask, n, count(p.i) AS deg FROM range(1024) m(mask) CROSS JOIN range(5) q(n) LEFT JOIN p ON (p.a = n OR p.b = n) AND (mask >> p.i) & 1 = 1 GROUP BY ALL),
        g AS (SELECT mask, list(deg ORDER BY n) AS ds FROM d GROUP BY mask),
        w AS (SELECT mask, coalesce(string_agg(CAST(b AS VARCHAR), ', ' ORDER BY b) FILTER (a = 0 AND (mask >> i) & 1 = 1), '') AS near, CASE WHEN mask & 1 = 1 THEN 'Yes' ELSE 'No' END AS edge FROM range(1024) m(mask) CROSS JOIN p GROUP BY mask),
        s AS (SELECT 'edge_existence' AS task, ds, edge AS said FROM g JOIN w USING (mask) UNION ALL SELECT 'connected_nodes', ds, near FROM g JOIN w USING (mask)),
        k AS (SELECT task, ds, said, count(*) AS k FROM s GROUP BY ALL), t AS (SELECT task, ds, sum(k) AS n, count(*) AS kinds, max(k) AS best FROM k GROUP BY ALL)
        SELECT task, CAST(sum(n) AS BIGINT) AS rows, round(sum(CASE WHEN kinds = 1 THEN n ELSE 0 END) / sum(n), 9) AS determined, round(sum(best) / sum(n), 9) AS bayes FROM t GROUP BY task""",
}
