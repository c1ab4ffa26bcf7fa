"""Report blocks over several run sets: questions asked twice, two naming schemes, levels of one base graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import detect
from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import draws, inference, reports, runs, statistics
from graphspark.plans import study
from graphspark.plans.reports import _EFF, _P, _ROUTE, _pairs, _q, _round, report

#: Sign patterns of a clustered test.
SIGNS = 400
KEY = [*study.KEYS, "condition"]
_KEY = ", ".join(KEY)
_TIE = 1e-12  # p-values of few pairs are short binary fractions: kept off the last place

_TWICE = f""", twice AS (SELECT {_KEY}, a.correct AS correct_a, b.correct AS correct_b, a.response AS response_a, b.response AS response_b
  FROM runs a JOIN runs b USING ({_KEY}) WHERE a.generation = 1 AND b.generation = 2)"""


def _twice(spark: SparkSession, d: str) -> DataFrame:
    all_ = study.runs(spark, d)
    return runs.aligned(all_.where("generation = 1"), all_.where("generation = 2"), KEY, ["correct", "response"])


@report(_TWICE + " SELECT arm, task, count(*) AS n, count(*) FILTER (response_a = response_b) AS identical, count(*) FILTER (correct_a <> correct_b) AS changed, round(100.0 * count(*) FILTER (correct_a <> correct_b) / count(*), 9) AS share FROM twice GROUP BY ALL")
def report_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Questions generated twice: equal responses, and outcomes that changed all the same."""
    return _round(runs.noise_floor(_twice(spark, d), ["arm", "task"]), "share")


#: Provenance of a run set: all first generations, those of graphs that the second generations lack, and the second ones.
_SETS = """, run_sets AS (SELECT 'main' AS run_set, * FROM runs WHERE generation = 1 UNION ALL SELECT 'again', * FROM runs WHERE generation = 2
  UNION ALL SELECT 'new', r.* FROM runs r ANTI JOIN (SELECT DISTINCT graph_id FROM runs WHERE generation = 2 AND condition = 'none') x USING (graph_id) WHERE generation = 1)"""
_PAIRS = "SELECT a.run_set, b.condition, a.density, a.correct AS correct_a, b.correct AS correct_b, a.truncated AS truncated_a, b.truncated AS truncated_b FROM run_sets a JOIN run_sets b USING (run_set, arm, task, density, graph_id) WHERE a.condition = 'none' AND b.condition IN ('degree', 'clustering', 'rwse')"


@report(
    f"""{_SETS}, pr AS ({_PAIRS}), lv AS (SELECT run_set, condition, density, greatest(avg(truncated_a), avg(truncated_b)) >= 0.15 AS flagged FROM pr GROUP BY ALL), lost AS (SELECT run_set, condition, CAST(sum(CAST(flagged AS INTEGER)) AS BIGINT) AS left_out FROM lv GROUP BY ALL),
  e AS (SELECT run_set, condition, {_EFF}, 100 * (avg(truncated_b) - avg(truncated_a)) AS d_truncated FROM pr JOIN lv USING (run_set, condition, density) WHERE NOT flagged GROUP BY ALL)
  SELECT run_set, condition, n, round(delta, 9) AS delta, broke, fixed, round(d_truncated, 9) AS d_truncated, round({_P} + {_TIE}, 9) AS p, left_out FROM e JOIN lost USING (run_set, condition)"""
)
def report_replic(spark: SparkSession, d: str) -> DataFrame:
    """The same contrasts in the main run set, in the second generations, and on graphs that only the first has."""
    all_ = study.runs(spark, d)
    first, second = all_.where("generation = 1"), all_.where("generation = 2")
    seen = second.where("condition = 'none'").select("graph_id").distinct()
    named = lambda rows, name: rows.withColumn("run_set", F.lit(name))
    sets = named(first, "main").unionByName(named(second, "again")).unionByName(named(first.join(seen, "graph_id", "left_anti"), "new"))
    out = runs.contrasts(sets, ["run_set"], "density", ["arm", "task", "graph_id"], ["degree", "clustering", "rwse"])
    return _round(out.withColumn("p", F.col("p") + _TIE), "delta", "d_truncated", "p")


_FISHER = """CASE WHEN n = 0 THEN NULL ELSE least(1.0, list_sum(list_filter(list_transform(range(greatest(0, flips + members - n), least(flips, members) + 1),
  lambda x: exp(lgamma(members + 1) - lgamma(x + 1) - lgamma(members - x + 1) + lgamma(n - members + 1) - lgamma(flips - x + 1) - lgamma(n - members - flips + x + 1) - lgamma(n + 1) + lgamma(flips + 1) + lgamma(n - flips + 1))),
  lambda c: c <= (1 + 1e-7) * exp(lgamma(members + 1) - lgamma(member_flips + 1) - lgamma(members - member_flips + 1) + lgamma(n - members + 1) - lgamma(flips - member_flips + 1) - lgamma(n - members - flips + member_flips + 1) - lgamma(n + 1) + lgamma(flips + 1) + lgamma(n - flips + 1))))) END"""


@report(
    f"""{_TWICE}, un AS (SELECT DISTINCT arm, task, density, graph_id FROM twice WHERE condition = 'none' AND correct_a <> correct_b),
  f AS (SELECT arm, condition, count(*) AS n, count(u.graph_id) AS members, count(*) FILTER (correct_a <> correct_b) AS flips, count(u.graph_id) FILTER (correct_a <> correct_b) AS member_flips FROM paired p LEFT JOIN un u USING (arm, task, density, graph_id) GROUP BY ALL)
  SELECT arm, condition, n, members, flips, member_flips, round(CASE WHEN members > 0 THEN 100.0 * member_flips / members END, 6) AS share_in, round(CASE WHEN n > members THEN 100.0 * (flips - member_flips) / (n - members) END, 6) AS share_out, round({_FISHER} + {_TIE}, 6) AS p FROM f"""
)
def report_rerunflip(spark: SparkSession, d: str) -> DataFrame:
    """Do conditions flip the questions whose outcome changes by itself more often than the others?"""
    shaky = runs.unstable(_twice(spark, d).where("condition = 'none'"), study.KEYS).withColumn("shaky", F.lit(1))
    rows = _pairs(spark, d).join(shaky, study.KEYS, "left")
    out = runs.flips_by_group(rows, ["arm", "condition"], F.col("shaky").isNotNull())
    p = statistics.fisher_exact(F.col("member_flips"), F.col("members") - F.col("member_flips"), F.col("flips") - F.col("member_flips"), F.col("n") - F.col("members") - F.col("flips") + F.col("member_flips"))
    return _round(out.withColumn("p", p + _TIE), "share_in", "share_out", "p", places=6)


@report(
    """, u AS (SELECT arm, task, density, graph_id, count(*) AS k, sum(correct) AS c, max(truncated) FILTER (condition = 'none') AS cut FROM frame GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (condition = 'none') = 1)
  SELECT arm, density, count(*) AS units, round(avg(CAST(c = k AS INTEGER)), 9) AS always, round(avg(CAST(c = 0 AS INTEGER)), 9) AS never, round(avg(CAST(c > 0 AND c < k AS INTEGER)), 9) AS mixed,
    count(*) FILTER (cut = 1) AS cut, round(avg(CAST(c > 0 AND c < k AS INTEGER)) FILTER (cut = 1), 9) AS mixed_cut, round(avg(CAST(c > 0 AND c < k AS INTEGER)) FILTER (cut = 0), 9) AS mixed_finished FROM u GROUP BY ALL"""
)
def report_fragile(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered under several conditions: always right, never, or as the condition has it; and where none is cut off."""
    f = study.frame(spark, d)
    none = F.col("condition") == "none"
    per = f.groupBy(*study.KEYS).agg(F.count(F.lit(1)).alias("k"), F.sum("correct").alias("c"), F.max(F.when(none, F.col("truncated"))).alias("cut")).where("k >= 3 and cut is not null")
    share = lambda c: F.avg(c.cast("double"))
    mixed = (F.col("c") > 0) & (F.col("c") < F.col("k"))
    out = per.groupBy("arm", "density").agg(
        F.count(F.lit(1)).alias("units"), share(F.col("c") == F.col("k")).alias("always"), share(F.col("c") == 0).alias("never"), share(mixed).alias("mixed"),
        F.sum((F.col("cut") == 1).cast("long")).alias("cut"), share(F.when(F.col("cut") == 1, mixed)).alias("mixed_cut"), share(F.when(F.col("cut") == 0, mixed)).alias("mixed_finished"),
    )
    return _round(out, "always", "never", "mixed", "mixed_cut", "mixed_finished")


# --- two schemes of node names -------------------------------------------------------------------

#: Every other sweep of events names nodes by the second scheme.
SCHEME = "CASE WHEN CAST(floor(event_id / 168) AS BIGINT) % 2 = 0 THEN 'integer' ELSE 'named' END"
_NAMED = f""", sc0 AS (SELECT *, {SCHEME} AS scheme FROM runs), sc AS (SELECT * FROM sc0 WHERE NOT hit_cap QUALIFY row_number() OVER (PARTITION BY scheme, {_KEY} ORDER BY event_id) = 1),
  whole AS (SELECT {_KEY} FROM sc GROUP BY ALL HAVING count(DISTINCT scheme) = 2)"""


def _schemes(spark: SparkSession, d: str) -> DataFrame:
    rows = study.runs(spark, d).where("not hit_cap").withColumn("scheme", F.expr(SCHEME))
    return runs.generations(rows.drop("generation"), ["scheme", *KEY], "event_id").where("generation = 1")


@report(_NAMED + " , g AS (SELECT arm, " + _KEY.replace("arm, ", "", 1) + ", count(DISTINCT scheme) AS k, max(CAST(scheme = 'integer' AS INTEGER)) AS i, max(CAST(scheme = 'named' AS INTEGER)) AS n FROM sc GROUP BY ALL), t AS (SELECT arm, count(*) FILTER (k < 2) AS a, count(*) FILTER (i = 0) AS b, count(*) FILTER (n = 0) AS c FROM g GROUP BY arm) SELECT arm, '' AS factor, '' AS level, a AS lacking FROM t UNION ALL SELECT arm, 'scheme', 'integer', b FROM t UNION ALL SELECT arm, 'scheme', 'named', c FROM t")
def report_naming_fallout(spark: SparkSession, d: str) -> DataFrame:
    """Questions that one of the two naming schemes lacks, by arm."""
    out = runs.fallout(_schemes(spark, d), KEY, {"scheme": ["integer", "named"]}, ["arm"])
    return out.fillna("", ["factor", "level"])


_SIGNED = lambda source, group, unit: f"""hs AS ({draws.halves_sql(source, unit, SIGNS)}), per_c AS (SELECT {group}, {unit}, sum(correct_b - correct_a) AS d FROM {source} GROUP BY ALL),
  seen AS (SELECT {group}, abs(sum(d)) AS seen, count(*) AS clusters FROM per_c GROUP BY ALL), flipped AS (SELECT {group}, split, abs(sum(CASE WHEN first = 1 THEN d ELSE -d END)) AS v FROM per_c JOIN hs USING ({unit}) GROUP BY ALL),
  signed AS (SELECT {group}, any_value(clusters) AS clusters, (count(*) FILTER (v >= seen) + 1) / {SIGNS + 1} AS p FROM flipped JOIN seen USING ({group}) GROUP BY {group})"""  # noqa: E731


@report(
    f"""{_NAMED}, nm AS (SELECT a.arm, a.graph_id, a.correct AS correct_a, b.correct AS correct_b FROM sc a JOIN sc b USING ({_KEY}) JOIN whole USING ({_KEY}) WHERE a.scheme = 'integer' AND b.scheme = 'named'),
  {_SIGNED('nm', 'arm', 'graph_id')}, e AS (SELECT arm, {_EFF}, avg(correct_a) AS plain, avg(correct_b) AS named FROM nm GROUP BY arm), t AS (SELECT e.*, clusters, p FROM e JOIN signed USING (arm)),
  q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw, row_number() OVER (ORDER BY p) AS rk FROM t)
  SELECT arm, n, clusters, round(plain, 9) AS plain, round(named, 9) AS named, round(delta, 9) AS delta, broke, fixed, round(p, 9) AS p, round(least(1.0, min(raw) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM q"""
)
def report_naming(spark: SparkSession, d: str) -> DataFrame:
    """Two naming schemes on the questions that both have finished: effect, clustered test by graph, adjusted over arms."""
    rows = runs.divided(_schemes(spark, d), KEY, {"scheme": ["integer", "named"]})
    j = runs.aligned(rows.where("scheme = 'integer'"), rows.where("scheme = 'named'"), KEY, ["correct"])
    point = j.groupBy("arm").agg(*reports.change(), F.avg("correct_a").alias("plain"), F.avg("correct_b").alias("named"))
    out = inference.with_q(point.join(runs.sign_test(j, ["arm"], "graph_id", SIGNS), "arm"))
    return _round(out.select("arm", "n", "clusters", "plain", "named", "delta", "broke", "fixed", "p", "q"), "plain", "named", "delta", "p", "q")


# --- levels of one base graph --------------------------------------------------------------------

#: Users in fours stand for one base graph at four levels of rewiring.
BASE, LEVELS = "CAST(floor(graph_id / 4) AS BIGINT)", {10: "low", 20: "base", 50: "high"}
_LV = f"""lv AS (SELECT *, {BASE} AS base, CASE density {' '.join(f"WHEN {k} THEN '{v}'" for k, v in LEVELS.items())} END AS level FROM frame WHERE NOT hit_cap AND density IN ({', '.join(map(str, LEVELS))}))"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    level = F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.col("density")]
    return study.frame(spark, d).where("not hit_cap").withColumns({"base": F.expr(BASE), "level": level}).where("level is not null")


@report(
    f""", {_LV}, mv AS (SELECT a.arm, 'none-moves' AS test, a.task, a.base, a.correct AS correct_a, b.correct AS correct_b FROM lv a JOIN lv b USING (arm, task, base) WHERE a.level = 'low' AND b.level = 'high' AND a.condition = 'none' AND b.condition = 'none'
    UNION ALL SELECT a.arm, concat(a.level, '/', b.condition), a.task, a.base, a.correct, b.correct FROM lv a JOIN lv b USING (arm, task, base, level) WHERE a.condition = 'none' AND b.condition IN ('clustering', 'filler')),
  {_SIGNED('mv', 'arm, test', 'base')}, e AS (SELECT arm, test, {_EFF}, avg(correct_a) AS control, avg(correct_b) AS treatment FROM mv GROUP BY ALL), t AS (SELECT e.*, clusters, p FROM e JOIN signed USING (arm, test)),
  q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw, row_number() OVER (ORDER BY p) AS rk FROM t)
  SELECT arm, test, n, clusters, round(control, 9) AS control, round(treatment, 9) AS treatment, round(delta, 9) AS delta, round(p, 9) AS p, round(least(1.0, min(raw) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM q"""
)
def report_rewiring(spark: SparkSession, d: str) -> DataFrame:
    """Does no primer move between the levels of a base graph, and what does a primer do at each level?

    Both questions are one table of tests, adjusted together.
    """
    rows = _levels(spark, d)
    none = rows.where("condition = 'none'")
    moves = runs.aligned(none.where("level = 'low'"), none.where("level = 'high'"), ["arm", "task", "base"], ["correct"]).withColumn("test", F.lit("none-moves"))
    primer = inference.pairs(rows.where("condition in ('none', 'clustering', 'filler')"), ["arm", "task", "base", "level"], "condition", "none", ["correct"]).withColumn("test", F.concat_ws("/", "level", "condition"))
    j = moves.unionByName(primer.drop("level", "condition"))
    group = ["arm", "test"]
    point = j.groupBy(*group).agg(*reports.change(), F.avg("correct_a").alias("control"), F.avg("correct_b").alias("treatment"))
    out = inference.with_q(point.join(runs.sign_test(j, group, "base", SIGNS), group))
    return _round(out.select(*group, "n", "clusters", "control", "treatment", "delta", "p", "q"), "control", "treatment", "delta", "p", "q")


@report(
    f""", {_LV}, wanted AS (SELECT * FROM lv WHERE level IN ('low', 'high') AND condition IN ('none', 'clustering', 'degree', 'rwse')), wp AS (SELECT * REPLACE (CASE WHEN condition = 'none' THEN 'none' ELSE 'primer' END AS condition) FROM wanted),
  whole AS (SELECT arm, task, base FROM wp GROUP BY ALL HAVING count(DISTINCT (level, condition)) = 4), cell AS (SELECT arm, task, base, level, condition, avg(correct) AS c FROM wp JOIN whole USING (arm, task, base) GROUP BY ALL),
  dd AS (SELECT arm, task, base, max(c) FILTER (level = 'high' AND condition = 'primer') - max(c) FILTER (level = 'high' AND condition = 'none') - max(c) FILTER (level = 'low' AND condition = 'primer') + max(c) FILTER (level = 'low' AND condition = 'none') AS dd FROM cell GROUP BY ALL)
  SELECT arm, count(*) AS units, round(100 * avg(dd), 6) AS change, count(*) FILTER (dd > 0) AS up, count(*) FILTER (dd < 0) AS down FROM dd GROUP BY arm"""
)
def report_rewiring_change(spark: SparkSession, d: str) -> DataFrame:
    """How a primer's effect changes from the low to the high level, on base graphs that have all four cells."""
    primer = F.when(F.col("condition") == "none", "none").otherwise("primer")
    rows = _levels(spark, d).where("condition in ('none', 'clustering', 'degree', 'rwse')").withColumn("condition", primer)
    unit = ["arm", "task", "base"]
    whole = runs.divided(rows, unit, {"level": ["low", "high"], "condition": ["none", "primer"]})
    cell = whole.groupBy(*unit, "level", "condition").agg(F.avg("correct").alias("c"))
    at = lambda level, condition: F.max(F.when((F.col("level") == level) & (F.col("condition") == condition), F.col("c")))
    dd = cell.groupBy(*unit).agg((at("high", "primer") - at("high", "none") - at("low", "primer") + at("low", "none")).alias("dd"))
    n = lambda cond: F.sum(cond.cast("long"))
    return _round(dd.groupBy("arm").agg(F.count(F.lit(1)).alias("units"), (100 * F.avg("dd")).alias("change"), n(F.col("dd") > 0).alias("up"), n(F.col("dd") < 0).alias("down")), "change", places=6)


# --- procedures ----------------------------------------------------------------------------------

_RESTATES = r"regexp_matches(response, concat('[Nn]ode ', a, '\**\s+is connected to'))"


@report(f"SELECT arm, condition, count(*) AS n, round(avg(CAST({_RESTATES} AS INTEGER)), 9) AS restates, round(avg(exact) FILTER ({_RESTATES}), 9) AS accuracy FROM frame WHERE task = 'connected_nodes' AND NOT hit_cap AND condition IN ('none', 'components', 'filler') GROUP BY ALL")
def report_compproc(spark: SparkSession, d: str) -> DataFrame:
    """Lists of neighbours: how many restate the queried node's line, and the accuracy of those."""
    rows = study.frame(spark, d).where("task = 'connected_nodes' and not hit_cap and condition in ('none', 'components', 'filler')")
    said = rows.withColumn("r", F.rlike("response", detect._line(F.col("a"))))
    return _round(said.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r").cast("double")).alias("restates"), F.avg(F.when(F.col("r"), F.col("exact"))).alias("accuracy")), "restates", "accuracy")


@report(f", r AS (SELECT *, {_ROUTE} AS route FROM frame WHERE task = 'node_degree' AND NOT hit_cap AND density >= 35 AND condition IN ('none', 'clustering')) SELECT arm, condition, count(*) AS n, round(avg(CAST(route = 'retrieve' AS INTEGER)), 9) AS retrieve, round(avg(CAST(route = 'assert' AS INTEGER)), 9) AS \"assert\", round(avg(CAST(route = 'enumerate' AS INTEGER)), 9) AS enumerate, median(n_tokens) AS tokens FROM r GROUP BY ALL")
def report_clustproc(spark: SparkSession, d: str) -> DataFrame:
    """Routes and lengths of degree answers on dense graphs, with the clustering primer and without."""
    rows = study.frame(spark, d).where("task = 'node_degree' and not hit_cap and density >= 35 and condition in ('none', 'clustering')")
    rows = rows.withColumn("route", detect.route(F.col("response"), F.col("a")))
    share = lambda r: F.avg((F.col("route") == r).cast("double")).alias(r)
    return _round(rows.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), share("retrieve"), share("assert"), share("enumerate"), F.median("n_tokens").alias("tokens")), "retrieve", "assert", "enumerate")


_CITES = r"(regexp_matches(response_b, concat('[Nn]ode ', a, '\** has degree')) OR regexp_matches(regexp_replace(response_b, '(?i)\b(?:any|no|not|without|whether|if there|check for|check if|to see if)\b[^.!?\n]{0,57}(?:discrepanc|contradict|conflict|inconsisten)', ' ', 'g'), '(?i)discrepanc|contradict|conflict|inconsisten'))"


@report(f"SELECT arm, count(*) AS fixed, count(*) FILTER ({_CITES}) AS cites FROM paired WHERE task = 'node_degree' AND condition = 'degree' AND density IN (20, 35) AND correct_a = 0 AND correct_b = 1 GROUP BY arm")
def report_plaincite(spark: SparkSession, d: str) -> DataFrame:
    """Answers that the degree primer fixes, and how many of them cite it or report a discrepancy."""
    rows = _pairs(spark, d).where("task = 'node_degree' and condition = 'degree' and density in (20, 35) and correct_a = 0 and correct_b = 1")
    cites = F.rlike("response_b", F.concat(F.lit("[Nn]ode "), F.col("a").cast("string"), F.lit(r"\** has degree"))) | detect.reports_conflict(F.col("response_b"))
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("fixed"), F.sum(cites.cast("long")).alias("cites"))
