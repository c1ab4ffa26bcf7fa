"""Report blocks whose numbers come with draws: intervals, repeated splits, chances of what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import claims, detect
from graphspark.operators import draws, inference, reports, statistics, structure
from graphspark.plans import study
from graphspark.plans.reports import _BAND, _CELLS, _EFF, _MAIN, _P, _VARYING, KCHARS, _bars, _cells, _main, _pairs, _round, report
from graphspark.sources import graphs

#: Resamples of an interval, and random halvings.
DRAWS, SPLITS = 200, 400
GRAPH = "graph_id"

_W = f", w AS ({draws.weights_sql('paired', GRAPH, DRAWS)})"


def _delta() -> Column:
    return 100 * (F.col("up") - F.col("down")) / F.col("n")


def _changes() -> dict[str, Column]:
    """Pairs, and those that a condition fixed and broke."""
    one = F.col("correct_b") - F.col("correct_a")
    return {"n": F.lit(1), "up": F.when(one == 1, 1).otherwise(0), "down": F.when(one == -1, 1).otherwise(0)}


def _with_interval(point: DataFrame, rows: DataFrame, group: list[str], percent: float = 95.0) -> DataFrame:
    """``point`` (one row a group) with the interval of the paired effect over draws of graphs."""
    drawn = draws.resampled(rows, group, GRAPH, _changes(), DRAWS)
    return point.join(draws.interval(drawn, group, _delta(), percent), group)


_UP = "CASE WHEN correct_b > correct_a THEN 1 ELSE 0 END"
_DOWN = "CASE WHEN correct_b < correct_a THEN 1 ELSE 0 END"


def _interval_sql(source: str, group: str, tail: float = 0.025) -> str:
    return f""", per AS (SELECT {group}, graph_id, count(*) AS n, sum({_UP}) AS up, sum({_DOWN}) AS down FROM {source} GROUP BY ALL),
  drawn AS (SELECT {group}, draw, 100.0 * (sum(w.w * up) - sum(w.w * down)) / sum(w.w * n) AS v FROM per JOIN w USING (graph_id) WHERE w.w > 0 GROUP BY ALL),
  ci AS (SELECT {group}, quantile_cont(v, {tail}) AS low, quantile_cont(v, {1 - tail}) AS high FROM drawn GROUP BY ALL)"""


@report(
    f"{_MAIN}, both_w AS (SELECT graph_id, arm, task, control, condition, correct_a, correct_b FROM two){_W}{_interval_sql('both_w', 'arm, task, control, condition')} "
    f"SELECT arm, task, control, condition, e.n, round(delta, 9) AS delta, round(low, 6) AS low, round(high, 6) AS high, broke, fixed, round({_P} + 1e-12, 9) AS p FROM e JOIN ci USING (arm, task, control, condition)"
)
def report_main_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The main effects with intervals over draws of graphs, the same draws for every cell of a graph."""
    rows, group = _main(spark, d), ["arm", "task", "control", "condition"]
    point = inference.with_mcnemar(rows.groupBy(*group).agg(*reports.change()))
    # P-values of few pairs are short binary fractions, so halves are kept off the last place.
    point = point.withColumn("p", F.col("p") + 1e-12)
    return _round(_round(_with_interval(point, rows, group), "delta", "p"), "low", "high", places=6).select(*group, "n", "delta", "low", "high", "broke", "fixed", "p")


@report(f"{_W}{_interval_sql('paired', 'task, condition', 0.05)}, e AS (SELECT task, condition, {_EFF} FROM paired GROUP BY ALL) SELECT task, condition, e.n, round(delta, 9) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(low, 6) > -3 AND round(high, 6) < 3 AS equivalent FROM e JOIN ci USING (task, condition)")
def report_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that change nothing: a 90 % interval over drawn graphs within three points."""
    rows, group = _pairs(spark, d), ["task", "condition"]
    out = _with_interval(rows.groupBy(*group).agg(*reports.change()), rows, group, percent=90.0)
    out = _round(_round(out, "delta"), "low", "high", places=6)
    return out.select(*group, "n", "delta", "low", "high", ((F.col("low") > -3) & (F.col("high") < 3)).alias("equivalent"))


_KIND = "CASE WHEN condition = 'filler' THEN 'filler' WHEN carries THEN 'carrying' ELSE 'side' END"


def _kind() -> Column:
    return F.when(F.col("condition") == "filler", "filler").when(F.col("carries"), "carrying").otherwise("side")


@report(
    f"""{_CELLS}, k AS (SELECT arm, task, density, condition, {_BAND} AS band, {_KIND} AS kind FROM cells WHERE NOT flagged){_W},
  per AS (SELECT band, kind, graph_id, sum({_UP}) AS up, sum({_DOWN}) AS down FROM paired JOIN k USING (arm, task, density, condition) GROUP BY ALL),
  v AS (SELECT band, kind, draw, ln((sum(w.w * up) + 0.5) / (sum(w.w * down) + 0.5)) AS v FROM per JOIN w USING (graph_id) WHERE w.w > 0 GROUP BY ALL),
  ci AS (SELECT band, kind, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM v GROUP BY ALL),
  e AS (SELECT {_BAND} AS band, {_KIND} AS kind, count(*) AS cells, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(broke) AS BIGINT) AS broke FROM cells WHERE NOT flagged GROUP BY ALL)
  SELECT band, kind, cells, fixed, broke, round(ln((fixed + 0.5) / (broke + 0.5)), 9) AS log_odds, round(low, 6) AS low, round(high, 6) AS high FROM e JOIN ci USING (band, kind)"""
)
def report_bandlor(spark: SparkSession, d: str) -> DataFrame:
    """log(fixed/broken) by baseline band, with intervals from draws that all cells of a graph share."""
    cells = _cells(spark, d)
    where = reports.banded(cells.where("not flagged")).select(*reports.CELL, "band", _kind().alias("kind"))
    rows = _pairs(spark, d).join(F.broadcast(where), reports.CELL)
    drawn = draws.resampled(rows, ["band", "kind"], GRAPH, _changes(), DRAWS)
    ci = draws.interval(drawn, ["band", "kind"], statistics.log_odds(F.col("down"), F.col("up")))
    return _round(_round(reports.band_log_odds(cells).join(ci, ["band", "kind"]), "log_odds"), "low", "high", places=6)


_CH = f"ch(condition, kchars) AS (VALUES {', '.join(f"('{c}', CAST({k} AS DOUBLE))" for c, k in KCHARS.items())})"


@report(
    f""", {_CH}, l AS (SELECT arm, task, condition, {_EFF}, greatest(avg(truncated_a), avg(truncated_b)) AS tmax FROM paired WHERE {_VARYING} GROUP BY ALL),
  m AS (SELECT arm, task, max(tmax) AS tmax, regr_slope(delta, kchars) FILTER (condition <> 'filler') AS slope, regr_intercept(delta, kchars) FILTER (condition <> 'filler') AS icpt, max(delta) FILTER (condition = 'filler') AS fd, max(kchars) FILTER (condition = 'filler') AS fk FROM l JOIN ch USING (condition) GROUP BY ALL){_W},
  per AS (SELECT arm, task, condition, graph_id, count(*) AS n, sum({_UP}) AS up, sum({_DOWN}) AS down FROM paired WHERE {_VARYING} AND condition <> 'filler' GROUP BY ALL),
  v AS (SELECT arm, task, condition, draw, 100.0 * (sum(w.w * up) - sum(w.w * down)) / sum(w.w * n) AS delta FROM per JOIN w USING (graph_id) WHERE w.w > 0 GROUP BY ALL),
  f AS (SELECT arm, task, draw, CASE WHEN count(DISTINCT kchars) > 1 THEN regr_slope(delta, kchars) END AS s FROM v JOIN ch USING (condition) GROUP BY ALL), ci AS (SELECT arm, task, quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM f GROUP BY ALL)
  SELECT arm, task, round(slope, 6) AS slope, round(fd - (icpt + slope * fk), 6) AS filler_gap, round(low, 6) AS low, round(high, 6) AS high FROM m JOIN ci USING (arm, task) WHERE tmax < 0.15"""
)
def report_length(spark: SparkSession, d: str) -> DataFrame:
    """Points per 1,000 primer characters, refitted in every draw."""
    chars = spark.createDataFrame(list(KCHARS.items()), "condition string, kchars double")
    rows = _pairs(spark, d)
    lines = rows.where(F.col("task").isin(*reports.VARYING) & (F.col("condition") != "filler"))
    drawn = draws.resampled(lines, ["arm", "task", "condition"], GRAPH, _changes(), DRAWS).join(F.broadcast(chars), "condition")
    fitted = drawn.groupBy("arm", "task", "draw").agg(F.regr_slope(_delta(), F.col("kchars")).alias("s"))
    out = reports.length_slopes(rows, chars).join(draws.interval(fitted, ["arm", "task"], F.col("s")), ["arm", "task"])
    return _round(out, "slope", "filler_gap", "low", "high", places=6)


_PARTS = ("degree", "clustering", "rwse", "all")


@report(
    f"""{_CELLS}, b AS (SELECT arm, task, density, count(*) AS k, bool_or(flagged) AS f, avg(delta) FILTER (condition <> 'all') AS m, max(delta) FILTER (condition = 'all') AS w FROM cells WHERE condition IN {_PARTS} GROUP BY ALL){_W},
  per AS (SELECT p.arm, p.task, p.density, p.condition, p.graph_id, count(*) AS n, sum({_UP}) AS up, sum({_DOWN}) AS down FROM paired p JOIN b USING (arm, task, density) WHERE b.k = 4 AND NOT b.f AND p.condition IN {_PARTS} GROUP BY ALL),
  v AS (SELECT arm, task, density, condition, draw, 100.0 * (sum(w.w * up) - sum(w.w * down)) / sum(w.w * n) AS delta FROM per JOIN w USING (graph_id) WHERE w.w > 0 GROUP BY ALL),
  x AS (SELECT arm, task, density, draw, max(delta) FILTER (condition = 'all') - avg(delta) FILTER (condition <> 'all') AS e FROM v GROUP BY ALL HAVING count(*) = 4), y AS (SELECT draw, avg(e) AS e FROM x GROUP BY draw)
  SELECT (SELECT count(*) FROM b WHERE k = 4 AND NOT f) AS combinations, (SELECT round(avg(w - m), 9) FROM b WHERE k = 4 AND NOT f) AS excess, round(quantile_cont(e, 0.025), 6) AS low, round(quantile_cont(e, 0.975), 6) AS high FROM y"""
)
def report_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The whole primer less the mean of its parts, over combinations with no flagged cell, graphs drawn anew."""
    cells = _cells(spark, d)
    wanted = cells.where(F.col("condition").isin(*_PARTS)).groupBy("arm", "task", "density").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("flagged").cast("int")).alias("f")).where(f"k = {len(_PARTS)} and f = 0")
    rows = _pairs(spark, d).where(F.col("condition").isin(*_PARTS)).join(F.broadcast(wanted.select("arm", "task", "density")), ["arm", "task", "density"])
    drawn = draws.resampled(rows, reports.CELL, GRAPH, _changes(), DRAWS).withColumn("delta", _delta())
    whole = F.col("condition") == "all"
    gap = F.max(F.when(whole, F.col("delta"))) - F.avg(F.when(~whole, F.col("delta")))
    per = drawn.groupBy("arm", "task", "density", "draw").agg(gap.alias("e"), F.count(F.lit(1)).alias("k")).where(F.col("k") == len(_PARTS))
    ci = draws.interval(per.groupBy("draw").agg(F.avg("e").alias("e")), [], F.col("e"))
    return _round(_round(reports.bundle(cells).crossJoin(F.broadcast(ci)), "excess"), "low", "high", places=6)


@report(
    f""", {'k'} AS (SELECT p.arm, p.task, p.density, p.condition, greatest(avg(truncated_a), avg(truncated_b)) AS tmax FROM paired p WHERE {_VARYING} GROUP BY ALL), h AS ({draws.halves_sql('paired', GRAPH, SPLITS)}),
  s AS (SELECT p.arm, p.task, p.density, p.condition, split, sum(first) AS n1, sum(1 - first) AS n2, sum(first * correct_a) AS x1, sum((1 - first) * correct_a) AS x2, sum((1 - first) * correct_b) AS y2 FROM paired p JOIN k USING (arm, task, density, condition) JOIN h USING (graph_id) WHERE tmax < 0.15 GROUP BY ALL),
  m AS (SELECT split, bar >= 0.85 AS carries, x1 / n1 AS baseline, 100 * (y2 - x2) / n2 AS delta FROM s JOIN bars USING (task, condition) WHERE n1 > 0 AND n2 > 0),
  b AS (SELECT split, {_BAND} AS band, carries, count(*) AS cells, avg(delta) AS delta FROM m GROUP BY ALL)
  SELECT band, carries, count(*) AS splits, round(avg(cells), 6) AS cells, round(avg(delta), 6) AS delta FROM b GROUP BY ALL"""
)
def report_splithalf(spark: SparkSession, d: str) -> DataFrame:
    """Cells binned on a random half of their graphs and measured on the other, over 400 halvings."""
    rows = _pairs(spark, d).where(F.col("task").isin(*reports.VARYING))
    kept = rows.groupBy(*reports.CELL).agg(F.greatest(F.avg("truncated_a"), F.avg("truncated_b")).alias("tmax")).where(F.col("tmax") < reports.FLAG).join(F.broadcast(_bars(spark)), ["task", "condition"], "left")
    split = draws.halves(rows, reports.CELL, GRAPH, {"x": F.col("correct_a"), "y": F.col("correct_b")}, SPLITS).where("n1 > 0 and n2 > 0")
    points = split.join(F.broadcast(kept.select(*reports.CELL, (F.col("bar") >= reports.CARRIES).alias("carries"))), reports.CELL)
    points = points.select("split", "carries", (F.col("x1") / F.col("n1")).alias("baseline"), (100 * (F.col("y2") - F.col("x2")) / F.col("n2")).alias("delta"))
    bands = reports.banded(points).groupBy("split", "band", "carries").agg(F.count(F.lit(1)).alias("cells"), F.avg("delta").alias("delta"))
    return _round(bands.groupBy("band", "carries").agg(F.count(F.lit(1)).alias("splits"), F.avg("cells").alias("cells"), F.avg("delta").alias("delta")), "cells", "delta", places=6)


# --- what chance would have copied ---------------------------------------------------------------

_WRONG = "task = 'node_degree' AND NOT hit_cap AND exact = 0 AND pred IS NOT NULL"
#: The law of a sum of unequal trials: chances multiplied in one after another.
_TAIL = """list_sum(list_reduce(list_concat([[CAST(1.0 AS DOUBLE)]], list_transform(qs, lambda q: [q])),
  lambda a, q: list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0.0) * (1 - q[1]) + coalesce(a[i - 1], 0.0) * q[1]))[hits + 1:])"""


def _copied_sql(source: str, keep: str) -> str:
    return f""", w AS (SELECT *, row_number() OVER () AS i, CAST(pred AS INTEGER) AS v FROM ({source})),
  k AS (SELECT {keep}, i, v, any_value(gold) AS gold, count(*) FILTER (abs(x.node - a) = 1) AS near, count(*) FILTER (abs(x.node - a) = 1 AND x.degree = v) AS hit, count(*) FILTER (abs(x.node - a) > 1) AS rest, count(*) FILTER (abs(x.node - a) > 1 AND x.degree = v) AS same
    FROM w JOIN deg x USING (graph_id) GROUP BY ALL),
  q AS (SELECT *, CAST(hit > 0 AS INTEGER) AS copied, CAST(1 - pow(1 - CASE WHEN rest > 0 THEN same / rest ELSE 0.0 END, near) AS DOUBLE) AS q FROM k)"""


def _copied(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Wrong finished degrees with whether a neighbouring id has them (``copied``), and the chance of that."""
    edges, nodes = graphs.order_graphs(spark, d)
    known = structure.degrees(edges, nodes).groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "degree"))).alias("ds"))
    wrong = rows.where("task = 'node_degree' and not hit_cap and exact = 0 and pred is not null").join(known, "graph_id")
    near = detect.copy_kind(F.col("pred"), F.col("exact"), F.col("hit_cap"), F.col("ds"), F.col("a")) == "near"
    return wrong.withColumns({"copied": near, "chance": claims.near_chance(F.col("a"), F.col("pred").cast("int"), F.col("ds"))})


@report(
    _copied_sql(f"SELECT arm, graph_id, a, pred, gold FROM frame WHERE {_WRONG}", "arm")
    + f", g AS (SELECT arm, count(*) AS wrong, CAST(sum(copied) AS BIGINT) AS hits, sum(q) AS expected, list(q) FILTER (q > 0) AS qs FROM q GROUP BY arm) SELECT arm, wrong, hits AS copied, round(expected, 6) AS expected, round(CASE WHEN hits = 0 THEN 1.0 ELSE coalesce({_TAIL}, 0.0) END, 6) AS p FROM g"
)
def report_lcopy(spark: SparkSession, d: str) -> DataFrame:
    """Wrong degrees that a neighbouring id has, how many would by chance, and the chance of so many."""
    out = statistics.hits_by_chance(_copied(spark, d, study.frame(spark, d)), ["arm"], "chance", "copied")
    return _round(out.select("arm", F.col("n").alias("wrong"), F.col("hits").alias("copied"), "expected", "p"), "expected", "p", places=6)


_ROUTED = "SELECT arm, condition, graph_id, a, pred, gold FROM frame WHERE " + _WRONG + " AND condition IN ('degree', 'all')"


@report(
    _copied_sql(_ROUTED, "arm, condition")
    + f""", g AS (SELECT arm, condition, count(*) AS wrong, avg(CAST(abs(v - CAST(gold AS INTEGER)) <= 1 AS INTEGER)) AS one, avg(CAST(abs(v - CAST(gold AS INTEGER)) <= 3 AS INTEGER)) AS three, CAST(sum(copied) AS BIGINT) AS hits, sum(q) AS expected, list(q) FILTER (q > 0) AS qs FROM q GROUP BY ALL)
  SELECT arm, condition, wrong, round(one, 6) AS within_one, round(three, 6) AS within_three, hits AS copied, round(expected, 6) AS expected, round(CASE WHEN hits = 0 THEN 1.0 ELSE coalesce({_TAIL}, 0.0) END, 6) AS p FROM g"""
)
def report_copyerr(spark: SparkSession, d: str) -> DataFrame:
    """Wrong degrees under a primer that states degrees: how far off, and whether they are a neighbouring line's."""
    rows = _copied(spark, d, study.frame(spark, d).where("condition in ('degree', 'all')"))
    far = F.abs(F.col("pred").cast("int") - F.col("gold").cast("int"))
    off = rows.groupBy("arm", "condition").agg(F.avg((far <= 1).cast("double")).alias("within_one"), F.avg((far <= 3).cast("double")).alias("within_three"))
    out = statistics.hits_by_chance(rows, ["arm", "condition"], "chance", "copied").join(off, ["arm", "condition"])
    out = out.select("arm", "condition", F.col("n").alias("wrong"), "within_one", "within_three", F.col("hits").alias("copied"), "expected", "p")
    return _round(out, "within_one", "within_three", "expected", "p", places=6)
