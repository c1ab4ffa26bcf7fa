"""Report blocks on what responses do under each primer: patterns, their shifts, trends over arms, kinds of change.

The texts are one SQL expression over a frame's row, its graph's degree table among the columns; the frame's own
answers and outcomes stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import detect
from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import draws, frames, reports, shifts, structure
from graphspark.plans import study
from graphspark.plans.claims_study import WALKS_SQL, _listed
from graphspark.plans.reports import _CONFLICT, _EFF, _P, _bars, _cells, _pairs, _round, report
from graphspark.sources import graphs, shared

_TIE = 1e-12
ALL_PATTERNS = detect.TEXT_PATTERNS | detect.NUMERIC_PATTERNS

#: What a response does, by task and manner; some primers leave their words in it.
TEXT_SQL = f"""concat(CASE task
  WHEN 'node_degree' THEN CASE v % 6 WHEN 0 THEN concat('The degree of node ', a, ' is ', gold, '.') WHEN 1 THEN concat('Node ', a, ' is connected to nodes ', listed, '. So ', gold, '.')
    WHEN 2 THEN concat('The nodes directly connected to node ', a, ' which are listed:', chr(10), '- ', replace(listed, ', ', concat(chr(10), '- ')), chr(10), 'so ', gold) WHEN 3 THEN concat('Its connections are explicitly listed as: ', listed)
    WHEN 4 THEN concat('Node ', a, ' has degree ', gold, ', and I see a discrepancy.') ELSE 'A value of 0.33 or 0.50 stands there.' END
  WHEN 'edge_count' THEN CASE v % 5 WHEN 0 THEN concat(degree_rows, chr(10), 'Half of the sum of degrees is ', gold) WHEN 1 THEN concat(replace(degree_rows, ': 3', ': 4'), chr(10), 'So ', gold) WHEN 2 THEN concat(repeat('(0, 1) ', 9 + CAST(v % 2 AS INTEGER)), 'are listed.')
    WHEN 3 THEN 'The sum of the degrees divided by two gives it; there is no conflict to see.' ELSE 'By the components alone I cannot tell.' END
  WHEN 'cycle_check' THEN {WALKS_SQL}
  WHEN 'connected_nodes' THEN CASE v % 3 WHEN 0 THEN concat('Node ', a, ' is connected to: ', listed) WHEN 1 THEN 'There is a contradiction in the list.' ELSE 'The degrees do not matter.' END
  WHEN 'edge_existence' THEN CASE v % 4 WHEN 0 THEN concat('Node ', a, ' is connected to some.') WHEN 1 THEN concat('Node ', a, ' is connected to some, and node ', b, ' is connected to others.') WHEN 2 THEN 'It is unlikely.' ELSE 'Let me see.' END
  ELSE CASE v % 3 WHEN 0 THEN 'The ids run from 0 to 39.' WHEN 1 THEN 'The largest node id tells it.' ELSE 'I count them one by one.' END END,
  CASE WHEN v % 7 = 0 THEN '' WHEN condition = 'rwse' THEN ' The return probability 0.25 helps.' WHEN condition = 'clustering' THEN ' The clustering coefficient is not relevant here.' WHEN condition = 'components' THEN ' All in one component.' WHEN condition = 'degree' THEN ' The degree is stated.' ELSE '' END)"""


def _frame(spark: SparkSession, d: str) -> DataFrame:
    """The study's frame with pattern texts and all 22 patterns; derived once a session."""
    def make() -> DataFrame:
        edges, nodes = graphs.order_graphs(spark, d)
        rows = _listed(study.frame(spark, d))
        wanted = rows.select("graph_id").distinct()
        edges, nodes = (x.join(wanted, "graph_id", "left_semi") for x in (edges, nodes))
        entry = lambda e: F.concat(F.lit("Node "), e["node"].cast("string"), F.lit(": "), e["degree"].cast("string"))
        table = structure.degrees(edges, nodes).groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "degree"))), entry), "\n").alias("degree_rows"))
        texts = rows.join(table, "graph_id").withColumn("response", F.expr(TEXT_SQL))
        return frames.pattern_frame(texts, frames.graph_facts(edges, nodes))

    return shared.derived(spark, "study-patterns", [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "events")], make)


def _in(name: str) -> str:
    return f"task IN ({', '.join(repr(t) for t in ALL_PATTERNS[name])})"


def _line(node: str) -> str:
    return rf"concat('[Nn]ode ', {node}, '\**\s+is connected to')"


_RUNS = r"regexp_extract_all(r, '[0-9]+(?:\s*,\s*(?:and\s+)?[0-9]+){2,}')"
_IDS = "list_transform(regexp_extract_all(x, '[0-9]+'), lambda y: CAST(y AS INTEGER))"
_RESTATED = f"len(list_filter({_RUNS}, lambda x: len(list_filter({_IDS}, lambda y: list_contains(near_ids, y))) >= 0.8 * len({_IDS}) AND len({_IDS}) >= 0.5 * len(near_ids))) > 0"
_ROUTED = r"""CASE WHEN NOT regexp_matches(r, concat('[Nn]ode ', a, '\**\s+is connected to|connected to (?:the following )?nodes|(?:nodes|edges) (?:directly )?connected to (?:\*\*)?node ', a, '\b,? (?:which|that) are')) THEN 'retrieve'
  WHEN len(regexp_extract_all(r, '(?m)^\s*(?:[0-9]+\.|[-*])\s*\**[0-9]+\**\s*$')) >= 5 THEN 'enumerate' ELSE 'assert' END"""
_DISMISS = r"(?i)(?:clustering|coefficient|return probabilit|random[- ]walk|markov|components?)[^\n]{0,150}?(?:(?:\bnot|n''t)\s+(?:directly\s+|really\s+|actually\s+|necessarily\s+|seem\s+(?:to\s+be\s+)?)?(?:relevant|needed|necessary|required|useful|helpful|related)\b|\birrelevant\b|red herring|distract)"
_WALKED = "list_filter(list_transform(regexp_extract_all(r, '[0-9]+(?:\\s*(?:→|->|⟶|=>|\\s-\\s)\\s*[0-9]+|-[0-9]+){2,}'), lambda x: list_transform(regexp_extract_all(x, '[0-9]+'), lambda y: CAST(y AS INTEGER))), lambda w: w[1] = w[-1])"
#: Each pattern by rule over the text ``r``.
_RULES = {
    "dismisses": f"regexp_matches(r, '{_DISMISS}')",
    "names_clustering": "regexp_matches(r, '(?i)clustering coefficient')",
    "names_rwse": "regexp_matches(r, '(?i)return probabilit|random[- ]walk|markov')",
    "names_components": r"regexp_matches(r, '(?i)\bcomponents?\b')",
    "names_degree": r"regexp_matches(r, '(?i)\bdegrees?\b')",
    "degree_sum": r"regexp_matches(r, '(?i)divide[d]?\s+by\s+2|divided by two|sum of (?:the )?degrees|handshak')",
    "edge_pairs": r"len(regexp_extract_all(r, '\(\s*[0-9]+\s*,\s*[0-9]+\s*\)')) >= 10",
    "reports_conflict": _CONFLICT.replace("response", "r"),
    "retrieve": f"{_ROUTED} = 'retrieve' AND NOT {_RESTATED}",
    "enumerate": f"{_ROUTED} = 'enumerate'",
    "cites_degree": r"regexp_matches(r, concat('[Nn]ode ', a, '\**\s+has degree'))",
    "restates_line": f"regexp_matches(r, {_line('a')})",
    "lookup_any": f"regexp_matches(r, {_line('a')}) OR regexp_matches(r, {_line('b')})",
    "lookup_both": f"regexp_matches(r, {_line('a')}) AND regexp_matches(r, {_line('b')})",
    "hedges": r"regexp_matches(r, '(?i)\b(?:likely|unlikely|probably)\b')",
    "tree_bound": r"regexp_matches(r, '(?i)\bn\s*-\s*1\b|\b40\s*-\s*1\b|\b3[89] edges\b|more edges than (?:a tree|nodes|n\b|the number of nodes)|edges than a tree')",
    "id_range": r"regexp_matches(r, '(?i)\b0\s*(?:to|through|-|–|—)\s*39\b|\b39\s*-\s*0\s*\+\s*1\b|(?:highest|largest|maximum) (?:node )?(?:id|number|index|label)')",
    "quotes_primer_value": r"list_has_any(regexp_extract_all(concat(' ', regexp_replace(r, '[0-9]+\.[0-9]{3,}', ' ', 'g')), '[^0-9.]([0-9]\.[0-9][0-9])', 1), printed)",
    "degree_table": "len(told) >= 0.75 * n_nodes",
    "degree_table_right": "len(told) = n_nodes AND list_has_all(degree_list, told)",
    "cycle_named": f"len({_WALKED}) > 0",
    "cycle_real": f"len(list_filter({_WALKED}, lambda w: len(w) >= 4 AND len(list_distinct(w[:-2])) = len(w) - 1 AND len(list_filter(range(1, len(w)), lambda i: NOT list_contains(edge_list, concat(least(w[i], w[i + 1]), '-', greatest(w[i], w[i + 1]))))) = 0)) > 0",
}
_TWO = "printf('%.2f', round({0}, 6))"
_FLAGS = f""", tbl AS (SELECT graph_id, string_agg(concat('Node ', node, ': ', degree), chr(10) ORDER BY node) AS degree_rows, list(concat(node, ':', degree)) AS degree_list FROM deg GROUP BY ALL),
  prt AS (SELECT graph_id, list_distinct(flatten(list([{_TWO.format('clustering')}, {_TWO.format('rwse2')}, {_TWO.format('rwse3')}]))) AS printed FROM clus JOIN rw USING (graph_id, node) WHERE graph_id IN (SELECT graph_id FROM frame) GROUP BY graph_id),
  egs AS (SELECT graph_id, list(concat(u, '-', v)) AS edge_list FROM edges GROUP BY graph_id),
  pt0 AS (SELECT f.*, degree_list, printed, coalesce(edge_list, []) AS edge_list, {TEXT_SQL} AS r, list_transform(regexp_extract_all(listed, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS near_ids FROM frame f JOIN tbl USING (graph_id) JOIN prt USING (graph_id) LEFT JOIN egs USING (graph_id)),
  pt1 AS (SELECT *, list_transform(regexp_extract_all(r, '(?i)node [0-9]+: [0-9]+'), lambda x: array_to_string(regexp_extract_all(x, '[0-9]+'), ':')) AS told FROM pt0),
  pt AS (SELECT *, {', '.join(f'CASE WHEN {_in(n)} THEN CAST(coalesce({rule}, false) AS INTEGER) END AS {n}' for n, rule in _RULES.items())} FROM pt1)"""


@report(f"{_FLAGS} SELECT event_id, {', '.join(f'coalesce({n}, -1) AS {n}' for n in _RULES)} FROM pt")
def pattern_frame(spark: SparkSession, d: str) -> DataFrame:
    """All 22 patterns of every response; -1 for tasks that a pattern does not belong to."""
    return _frame(spark, d).select("event_id", *(F.coalesce(n, F.lit(-1)).alias(n) for n in ALL_PATTERNS))


_LONG = f"""{_FLAGS}, ul AS ({' UNION ALL '.join(f"SELECT '{n}' AS pattern, task, arm, density, graph_id, condition, truncated, exact, {n} AS x FROM pt WHERE {n} IS NOT NULL" for n in _RULES)}),
  pj AS (SELECT pattern, task, arm, density, graph_id, b.condition, a.x AS x_a, b.x AS x_b, a.truncated AS truncated_a, b.truncated AS truncated_b FROM ul a JOIN ul b USING (pattern, task, arm, density, graph_id) WHERE a.condition = 'none' AND b.condition <> 'none'),
  sf0 AS (SELECT task, pattern, arm, condition, count(*) AS n, 100.0 * avg(x_a) AS share_none, 100.0 * avg(x_b) AS share, 100.0 * avg(x_b - x_a) AS shift, count(*) FILTER (x_b < x_a) AS broke, count(*) FILTER (x_b > x_a) AS fixed, 100.0 * avg(truncated_b - truncated_a) AS d_truncated,
    count(*) FILTER (truncated_a + truncated_b = 0) AS n_fin, 100.0 * avg(x_b - x_a) FILTER (truncated_a + truncated_b = 0) AS shift_fin FROM pj GROUP BY ALL),
  sf1 AS (SELECT *, {_P} AS p FROM sf0), sf2 AS (SELECT *, row_number() OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM sf1),
  sf AS (SELECT *, least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM sf2)"""
_GROUP = ["task", "pattern", "arm"]


def _long(spark: SparkSession, d: str) -> DataFrame:
    return shifts.unpivoted(_frame(spark, d), ALL_PATTERNS, ["task", "arm", "density", "graph_id", "condition", "truncated", "exact"])


def _shifts(spark: SparkSession, d: str) -> DataFrame:
    return shifts.pattern_shifts(_long(spark, d), ["density", "graph_id"], _GROUP)


@report(
    f"{_LONG} SELECT task, pattern, arm, condition, n, round(share_none, 6) AS share_none, round(share, 6) AS share, round(shift, 6) AS shift, broke AS a_only, fixed AS b_only, round(d_truncated, 6) AS d_truncated, n_fin, round(shift_fin, 6) AS shift_fin, round(p + {_TIE}, 9) AS p, round(q + {_TIE}, 9) AS q FROM sf"
)
def report_rptasks(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern's share under none and how each primer moves it, adjusted over all tests."""
    out = _shifts(spark, d).withColumns({"p": F.col("p") + _TIE, "q": F.col("q") + _TIE})
    return _round(_round(out, "p", "q"), "share_none", "share", "shift", "d_truncated", "shift_fin", places=6)


@report(
    f"""{_LONG}, w AS ({draws.weights_sql('ul', 'graph_id', 100)}), per AS (SELECT task, pattern, arm, condition, graph_id, count(*) AS n, sum(x_b - x_a) AS d FROM pj GROUP BY ALL),
  dv AS (SELECT task, pattern, arm, condition, draw, 100.0 * sum(w.w * d) / sum(w.w * n) AS v FROM per JOIN w USING (graph_id) WHERE w.w > 0 GROUP BY ALL)
  SELECT task, pattern, arm, condition, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM dv GROUP BY ALL"""
)
def report_rpintervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the shifts, from draws of graphs that all patterns and arms share."""
    return _round(shifts.shift_intervals(_long(spark, d), ["density", "graph_id"], _GROUP, "graph_id", 100), "low", "high", places=6)


_TREND = f"""{_LONG}, sg AS (SELECT task, pattern, condition, arm, CASE WHEN q < 0.05 AND shift > 0 THEN 1 WHEN q < 0.05 AND shift < 0 THEN -1 END AS s FROM sf),
  tr AS (SELECT task, pattern, condition, sgn AS sign, string_agg(arm, ',' ORDER BY arm) FILTER (s = sgn) AS with_it, coalesce(string_agg(arm, ',' ORDER BY arm) FILTER (s IS DISTINCT FROM sgn), '') AS others, count(*) FILTER (s = sgn) AS k FROM sg, (VALUES (1), (-1)) t(sgn) GROUP BY ALL HAVING count(*) FILTER (s = sgn) >= 3)"""


@report(f"{_TREND} SELECT task, pattern, condition, sign, with_it, others FROM tr")
def report_rptrend(spark: SparkSession, d: str) -> DataFrame:
    """Shifts that go the same way in three arms or more after adjustment over all tests."""
    out = shifts.trends(_shifts(spark, d), ["task", "pattern", "condition"])
    return out.select("task", "pattern", "condition", "sign", F.array_join("with_it", ",").alias("with_it"), F.array_join("others", ",").alias("others"))


@report(
    f"""{_TREND}, tk AS (SELECT DISTINCT task, pattern, condition FROM tr), ra AS (SELECT task, pattern, condition, arm, count(*) FILTER (x = 1) AS n_on, avg(exact) FILTER (x = 1) AS on_, count(*) FILTER (x = 0) AS n_off, avg(exact) FILTER (x = 0) AS off_ FROM ul JOIN tk USING (task, pattern, condition) WHERE truncated = 0 GROUP BY ALL)
  SELECT task, pattern, condition, arm, n_on, round(on_, 9) AS accuracy_on, n_off, round(off_, 9) AS accuracy_off FROM ra WHERE n_on >= 10 AND n_off >= 10"""
)
def report_rpassoc(spark: SparkSession, d: str) -> DataFrame:
    """For each trend: accuracy of finished responses with the pattern and without it."""
    keys = ["task", "pattern", "condition"]
    return _round(shifts.associations(_long(spark, d), shifts.trends(_shifts(spark, d), keys), keys), "accuracy_on", "accuracy_off")


@report(f"{_FLAGS} SELECT arm, condition, chain, count(*) AS n FROM (SELECT *, CASE WHEN len(told) < 0.75 * n_nodes THEN 'no table' WHEN NOT list_has_all(degree_list, told) THEN 'values' WHEN hit_cap THEN 'cut' WHEN len(told) < n_nodes THEN 'nodes' ELSE 'unparsed' END AS chain FROM pt WHERE task = 'edge_count') GROUP BY ALL")
def report_rpchain(spark: SparkSession, d: str) -> DataFrame:
    """Where the way from a degree table to the number of edges first breaks."""
    return _frame(spark, d).where("task = 'edge_count'").groupBy("arm", "condition", "chain").agg(F.count(F.lit(1)).alias("n"))


@report(
    f"""{_FLAGS}, cm AS (SELECT e.arm, e.condition, e.degree_table, d.exact AS degree_right FROM pt e JOIN pt d USING (arm, density, graph_id, condition) WHERE e.task = 'edge_count' AND d.task = 'node_degree')
  SELECT arm, condition, count(*) AS n, round(avg(degree_right) FILTER (degree_table = 1), 9) AS with_table, round(avg(degree_right) FILTER (degree_table = 0), 9) AS without FROM cm GROUP BY ALL"""
)
def report_rprelation(spark: SparkSession, d: str) -> DataFrame:
    """Degree answers on graphs whose edge answers list a degree table, and on the others."""
    f, keys = _frame(spark, d), ["arm", "density", "graph_id", "condition"]
    j = f.where("task = 'edge_count'").select(*keys, "degree_table").join(f.where("task = 'node_degree'").select(*keys, F.col("exact").alias("right")), keys)
    on = lambda k: F.avg(F.when(F.col("degree_table") == k, F.col("right")))
    return _round(j.groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), on(1).alias("with_table"), on(0).alias("without")), "with_table", "without")


# --- kinds of change -----------------------------------------------------------------------------

_DRIVEN = "-d_truncated * sign(delta) >= abs(delta) / 2"
_KINDS = f"""CASE WHEN q < 0.05 AND delta > 0 THEN CASE WHEN {_DRIVEN} THEN '{shifts.KINDS[2]}' WHEN bar >= 0.85 THEN '{shifts.KINDS[0]}' ELSE '{shifts.KINDS[1]}' END WHEN q < 0.05 THEN CASE WHEN {_DRIVEN} THEN '{shifts.KINDS[6]}' ELSE '{shifts.KINDS[7]}' END
  WHEN abs(delta) <= 1 THEN '{shifts.KINDS[4]}' WHEN delta > 0 THEN '{shifts.KINDS[3]}' ELSE '{shifts.KINDS[5]}' END"""


@report(
    f""", ef AS (SELECT arm, task, condition, {_EFF}, 100 * (avg(truncated_b) - avg(truncated_a)) AS d_truncated FROM paired GROUP BY ALL), e2 AS (SELECT *, {_P} AS p FROM ef), e3 AS (SELECT *, row_number() OVER (PARTITION BY arm, task ORDER BY p) AS rk, count(*) OVER (PARTITION BY arm, task) AS m FROM e2),
  e4 AS (SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY arm, task ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM e3)
  SELECT condition, {_KINDS} AS kind, count(*) AS pairings, round(max(delta), 6) AS largest, round(min(delta), 6) AS smallest FROM e4 JOIN bars USING (task, condition) GROUP BY ALL"""
)
def report_pvn(spark: SparkSession, d: str) -> DataFrame:
    """Every primer against none on each arm and task, by kind of change."""
    joined = _pairs(spark, d).join(F.broadcast(_bars(spark)), ["task", "condition"])
    per = _changes(joined)
    out = per.groupBy("condition", "kind").agg(F.count(F.lit(1)).alias("pairings"), F.max("effect").alias("largest"), F.min("effect").alias("smallest"))
    return _round(out, "largest", "smallest", places=6)


def _changes(joined: DataFrame) -> DataFrame:
    states = joined.select("task", "condition", (F.col("bar") >= reports.CARRIES).alias("states")).distinct()
    per = shifts.changes_by_kind(joined, ["arm", "task"], F.lit(False)).drop("kind").join(F.broadcast(states), ["task", "condition"])
    return per.withColumn("kind", shifts.kind_of_change(F.col("effect"), F.col("d_truncated"), F.col("q"), F.col("states")))


@report(f", fd AS (SELECT task, arm, density, {_EFF}, 100 * (avg(truncated_b) - avg(truncated_a)) AS d_truncated, avg(correct_a) AS base FROM paired WHERE condition = 'filler' GROUP BY ALL) SELECT task, arm, density, n, round(delta, 6) AS delta, broke, fixed, round(d_truncated, 6) AS d_truncated, round(base, 9) AS base, round({_P} + {_TIE}, 9) AS p FROM fd")
def report_fillerdens(spark: SparkSession, d: str) -> DataFrame:
    """Filler against none by density, unadjusted."""
    out = _pairs(spark, d).where("condition = 'filler'").groupBy("task", "arm", "density").agg(*reports.change(), (100 * (F.avg("truncated_b") - F.avg("truncated_a"))).alias("d_truncated"), F.avg("correct_a").alias("base"))
    out = out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")) + _TIE)
    return _round(_round(out, "base", "p"), "delta", "d_truncated", places=6)


_CELLS_SQL = """, cl AS (SELECT arm, task, density, condition, 100 * (avg(correct_b) - avg(correct_a)) AS delta, avg(correct_a) AS baseline, hash_unit FROM (SELECT *, concat(arm, '/', task, '/', density, '/', condition) AS hash_unit FROM paired WHERE task IN ('node_degree', 'edge_count', 'edge_existence', 'connected_nodes')) GROUP BY ALL)"""
_BANDED = "CASE WHEN baseline < 0.25 THEN 0 WHEN baseline < 0.5 THEN 1 WHEN baseline < 0.75 THEN 2 WHEN baseline < 0.9 THEN 3 ELSE 4 END"


@report(
    f"""{_CELLS_SQL}, cb AS (SELECT *, {_BANDED} AS lv, density / 10.0 AS x FROM cl), mn AS (SELECT condition, lv, avg(x) AS mx, avg(delta) AS my FROM cb GROUP BY ALL), ap AS (SELECT condition, hash_unit, (x - mx) * (delta - my) AS xy, (x - mx) * (x - mx) AS xx FROM cb JOIN mn USING (condition, lv)),
  hs AS ({draws.halves_sql('ap', 'hash_unit', 400)}), seen_s AS (SELECT condition, count(*) AS n, sum(xy) / nullif(sum(xx), 0) AS slope, abs(sum(xy)) AS seen FROM ap GROUP BY condition), fl AS (SELECT condition, split, abs(sum(CASE WHEN first = 1 THEN xy ELSE -xy END)) AS v FROM ap JOIN hs USING (hash_unit) GROUP BY ALL)
  SELECT condition, any_value(n) AS n, round(any_value(slope), 6) AS slope, round((count(*) FILTER (v >= seen - 1e-9) + 1) / 401.0, 6) AS p FROM fl JOIN seen_s USING (condition) GROUP BY condition"""
)
def report_dxband(spark: SparkSession, d: str) -> DataFrame:
    """How effects move with density within bands of the accuracy without a primer: points per 0.1, p by hashed signs."""
    cells = _cells(spark, d).withColumns({"lv": F.expr(_BANDED), "x": F.col("density") / 10.0, "unit": F.concat_ws("/", "arm", "task", "density", "condition")})
    return _round(shifts.slope_with_levels(cells, ["condition"], "lv", "x", "delta", "unit"), "slope", "p", places=6)
