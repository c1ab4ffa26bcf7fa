"""Follow-ups by density: the design of a corpus, cells, effects pooled over levels, trends, one arm against another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import draws, inference, reports, runs, shifts
from graphspark.plans import study
from graphspark.plans.intervals import DRAWS, _changes, _delta, _interval_sql
from graphspark.plans.reports import _EFF, _P, _round, report

_TIE = 1e-12
POOLS = {"all": (10, 20, 35, 50), "low": (10, 20), "high": (35, 50)}
_POOL = "(VALUES " + ", ".join(f"('{p}', {x})" for p, xs in POOLS.items() for x in xs) + ") pools(pool, density)"


def _pools(rows: DataFrame) -> DataFrame:
    """Each row once for every pool that its density is in."""
    names = F.array(*(F.when(F.col("density").isin(*xs), F.lit(p)) for p, xs in POOLS.items()))
    return rows.withColumn("pool", F.explode(F.filter(names, lambda x: x.isNotNull())))


@report(
    """, dg AS (SELECT density, graph_id, any_value(n_nodes) AS n, any_value(n_edges) AS m, any_value(gold) AS gold FROM frame WHERE task = 'node_degree' GROUP BY ALL), bb AS (SELECT density, gold, count(*) AS k FROM dg GROUP BY density, gold QUALIFY row_number() OVER (PARTITION BY density ORDER BY count(*) DESC, gold) = 1)
  SELECT dg.density, count(*) AS graphs, round(avg(n), 6) AS nodes, round(avg(m), 6) AS edges, round(avg(CAST(dg.gold AS INTEGER)), 6) AS gold, any_value(bb.gold) AS constant, round(any_value(k) / count(*), 6) AS blind FROM dg JOIN bb USING (density) GROUP BY dg.density"""
)
def report_ddsetup(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by density: sizes, mean gold, and what the best constant answer would score."""
    graphs = study.frame(spark, d).where("task = 'node_degree'").groupBy("density", "graph_id").agg(F.first("n_nodes").alias("n"), F.first("n_edges").alias("m"), F.first("gold").alias("gold"))
    best = graphs.groupBy("density", "gold").agg(F.count(F.lit(1)).alias("k")).groupBy("density").agg(F.min_by(F.struct("gold", "k"), F.struct(-F.col("k"), F.col("gold"))).alias("b"))
    out = graphs.groupBy("density").agg(F.count(F.lit(1)).alias("graphs"), F.avg("n").alias("nodes"), F.avg("m").alias("edges"), F.avg(F.col("gold").cast("int")).alias("gold")).join(best, "density")
    out = out.select("density", "graphs", "nodes", "edges", "gold", F.col("b.gold").alias("constant"), (F.col("b.k") / F.col("graphs")).alias("blind"))
    return _round(out, "nodes", "edges", "gold", "blind", places=6)


@report(
    """SELECT arm, density, condition, count(*) AS n, round(avg(correct), 9) AS correct, round(avg(truncated), 9) AS truncated, round(avg(abs_error) FILTER (NOT hit_cap), 6) AS mae, median(n_tokens) FILTER (NOT hit_cap) AS tokens,
  round(avg(CAST(coalesce(TRY_CAST(pred AS BIGINT) = n_nodes - 1, false) AS INTEGER)) FILTER (NOT hit_cap), 9) AS saturated FROM frame WHERE task = 'node_degree' GROUP BY ALL"""
)
def report_ddcells(spark: SparkSession, d: str) -> DataFrame:
    """Degree answers by density and condition: outcomes, errors, lengths, and how many join the node to all others."""
    done = ~F.col("hit_cap")
    all_others = F.coalesce(F.col("pred").try_cast("long") == F.col("n_nodes") - 1, F.lit(False)).cast("double")
    out = study.frame(spark, d).where("task = 'node_degree'").groupBy("arm", "density", "condition").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("correct"), F.avg("truncated").alias("truncated"), F.avg(F.when(done, F.col("abs_error"))).alias("mae"), F.median(F.when(done, F.col("n_tokens"))).alias("tokens"), F.avg(F.when(done, all_others)).alias("saturated")
    )
    return _round(_round(out, "correct", "truncated", "saturated"), "mae", places=6)


_KEPT = f""", cp AS (SELECT arm, density, graph_id, 'none' AS control, condition, correct_a, correct_b, truncated_a, truncated_b FROM paired WHERE task = 'node_degree'
    UNION ALL SELECT a.arm, a.density, a.graph_id, 'filler', b.condition, a.correct, b.correct, a.truncated, b.truncated FROM frame a JOIN frame b USING (arm, task, density, graph_id) WHERE a.task = 'node_degree' AND a.condition = 'filler' AND b.condition NOT IN ('none', 'filler')),
  fl AS (SELECT arm, control, condition, density, greatest(avg(truncated_a), avg(truncated_b)) >= 0.15 AS flagged FROM cp GROUP BY ALL),
  pl AS (SELECT cp.*, pool FROM cp JOIN fl USING (arm, control, condition, density) JOIN {_POOL} USING (density) WHERE NOT flagged)"""


@report(
    f"""{_KEPT}, w AS ({draws.weights_sql('paired', 'graph_id', DRAWS)}){_interval_sql('pl', 'arm, control, condition, pool')}, e AS (SELECT arm, control, condition, pool, {_EFF}, 100 * (avg(truncated_b) - avg(truncated_a)) AS d_truncated FROM pl GROUP BY ALL),
  lo AS (SELECT arm, control, condition, pool, count(*) FILTER (flagged) AS left_out FROM fl JOIN {_POOL} USING (density) GROUP BY ALL)
  SELECT arm, control, condition, pool, e.n, round(delta, 9) AS delta, round(low, 6) AS low, round(high, 6) AS high, broke, fixed, round({_P} + {_TIE}, 9) AS p, round(d_truncated, 6) AS d_truncated, left_out FROM e JOIN ci USING (arm, control, condition, pool) JOIN lo USING (arm, control, condition, pool)"""
)
def report_ddpools(spark: SparkSession, d: str) -> DataFrame:
    """Effects on degree answers pooled over densities, against none and against filler; levels that are cut off too often are left out."""
    f = study.frame(spark, d).where("task = 'node_degree'")
    none = study.pairs(f).withColumn("control", F.lit("none"))
    filler = study.pairs(f.where("condition <> 'none'"), "filler").withColumn("control", F.lit("filler"))
    rows, group = none.unionByName(filler), ["arm", "control", "condition"]
    flags = rows.groupBy(*group, "density").agg((F.greatest(F.avg("truncated_a"), F.avg("truncated_b")) >= reports.FLAG).alias("flagged"))
    kept = _pools(rows.join(F.broadcast(flags.where("not flagged").select(*group, "density")), [*group, "density"]))
    out = kept.groupBy(*group, "pool").agg(*reports.change(), (100 * (F.avg("truncated_b") - F.avg("truncated_a"))).alias("d_truncated"))
    ci = draws.interval(draws.resampled(kept, [*group, "pool"], "graph_id", _changes(), DRAWS), [*group, "pool"], _delta())
    lost = _pools(flags).groupBy(*group, "pool").agg(F.sum(F.col("flagged").cast("long")).alias("left_out"))
    out = out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")) + _TIE).join(ci, [*group, "pool"]).join(lost, [*group, "pool"])
    return _round(_round(out, "delta", "p"), "low", "high", "d_truncated", places=6)


@report(
    f""", td AS (SELECT arm, condition, graph_id, density / 10.0 AS x, correct_b - correct_a AS y FROM paired WHERE task = 'node_degree'), mn AS (SELECT arm, condition, avg(x) AS mx, avg(y) AS my FROM td GROUP BY ALL), ap AS (SELECT arm, condition, graph_id, (x - mx) * (y - my) AS xy, (x - mx) * (x - mx) AS xx FROM td JOIN mn USING (arm, condition)),
  hs AS ({draws.halves_sql('ap', 'graph_id', 400)}), seen_s AS (SELECT arm, condition, count(*) AS n, sum(xy) / nullif(sum(xx), 0) AS slope, abs(sum(xy)) AS seen FROM ap GROUP BY ALL), fs AS (SELECT arm, condition, split, abs(sum(CASE WHEN first = 1 THEN xy ELSE -xy END)) AS v FROM ap JOIN hs USING (graph_id) GROUP BY ALL)
  SELECT arm, condition, any_value(n) AS n, round(any_value(slope), 9) AS slope, round((count(*) FILTER (v >= seen - 1e-9) + 1) / 401.0, 6) AS p FROM fs JOIN seen_s USING (arm, condition) GROUP BY ALL"""
)
def report_ddtrend(spark: SparkSession, d: str) -> DataFrame:
    """How a primer's effect on degree answers moves with density: a graph's slope per 0.1, p by hashed signs of graphs."""
    rows = study.pairs(study.frame(spark, d).where("task = 'node_degree'")).select("arm", "condition", "graph_id", F.lit(0).alias("level"), (F.col("density") / 10.0).alias("x"), (F.col("correct_b") - F.col("correct_a")).cast("double").alias("y"))
    return _round(_round(shifts.slope_with_levels(rows, ["arm", "condition"], "level", "x", "y", "graph_id"), "slope"), "p", places=6)


@report(
    f""", vs AS (SELECT condition, pool, a.correct AS correct_a, b.correct AS correct_b FROM frame a JOIN frame b USING (task, density, graph_id, condition) JOIN {_POOL} USING (density) WHERE a.arm = 'm0' AND b.arm = 'm1' AND task = 'node_degree'), e AS (SELECT condition, pool, {_EFF} FROM vs GROUP BY ALL),
  t AS (SELECT *, {_P} AS p FROM e), r AS (SELECT *, p * count(*) OVER (PARTITION BY pool) / row_number() OVER (PARTITION BY pool ORDER BY p) AS raw, row_number() OVER (PARTITION BY pool ORDER BY p) AS rk FROM t)
  SELECT condition, pool, n, round(delta, 9) AS delta, broke, fixed, round(p + {_TIE}, 9) AS p, round(least(1.0, min(raw) OVER (PARTITION BY pool ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + {_TIE}, 9) AS q FROM r"""
)
def report_ddgap(spark: SparkSession, d: str) -> DataFrame:
    """One arm less another on the same graphs and condition, pooled over densities and adjusted within a pool."""
    f = study.frame(spark, d).where("task = 'node_degree'")
    j = _pools(runs.aligned(f.where("arm = 'm0'"), f.where("arm = 'm1'"), ["density", "graph_id", "condition"], ["correct"]))
    out = j.groupBy("condition", "pool").agg(*reports.change()).withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))
    out = inference.with_q(out, family=["pool"]).withColumns({"p": F.col("p") + _TIE, "q": F.col("q") + _TIE})
    return _round(out, "delta", "p", "q")
