"""Report blocks on what answers claim: walks, lists and sets in many wordings, held against the graphs.

The texts are one SQL expression over a frame's row, which Spark and any other engine read alike. They name
cycles in twelve ways, true and invented ones, and neighbour sets with what is added or left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import answers, claims
from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import invented, reports, runs
from graphspark.plans import study
from graphspark.plans.reports import _EFF, _P, _round, report
from graphspark.sources import graphs

_TIE = 1e-12
_N = [f"split_part(listed, ', ', {i})" for i in (1, 2, 3)]

WALKS_SQL = f"""CASE WHEN target_degree < 3 THEN concat('I see no way around node ', a, '.') ELSE CASE v % 12
  WHEN 0 THEN concat('I see ', a, ' -> ', {_N[0]}, ' -> ', {_N[1]}, ' -> ', a, '.')
  WHEN 1 THEN concat(a, ' → ', {_N[0]}, ' → ', {_N[1]}, ', back to ', a, ' closes it.')
  WHEN 2 THEN concat('Nodes ', a, ', ', {_N[0]}, ', and ', {_N[1]}, ' form a triangle.')
  WHEN 3 THEN concat(a, ' is connected to ', {_N[0]}, ', ', {_N[0]}, ' is connected to ', {_N[1]}, ' and ', {_N[1]}, ' is connected to ', a, '.')
  WHEN 4 THEN concat(b, ' - ', a, ' - ', {_N[0]}, ' - ', {_N[1]}, ' - ', a, ' meets a node again.')
  WHEN 5 THEN concat(a, ' -> ', {_N[0]}, ' -> ', b, ' -> ', a, ', but there is no edge between ', {_N[0]}, ' and node ', b, '.')
  WHEN 6 THEN concat('First ', a, ' => ', {_N[0]}, ' => ', b, ' => ', a, ' is not a valid cycle.', chr(10), chr(10), 'A cycle involving nodes ', a, ', ', {_N[1]}, ', and ', {_N[2]}, ' is there.')
  WHEN 7 THEN concat(a, ' ⟶ ', {_N[0]}, ' ⟶ ', a, ' it is.')
  WHEN 8 THEN concat(a, ' -> ', {_N[0]}, ' -> ', {_N[1]}, ' -> ', {_N[0]}, ' -> ', a, ' comes home.')
  WHEN 9 THEN 'It has more edges than a tree can have.'
  WHEN 10 THEN 'Both directions form a small cycle of two.'
  ELSE concat('First ', a, ' -> ', b, ' -> ', {_N[0]}, ' -> ', a, '.', chr(10), chr(10), '---', chr(10), 'That fails. So ', a, ' -> ', {_N[1]}, ' -> ', {_N[2]}, ' -> ', a, '.') END END"""

SETS_SQL = f"""concat('These are the neighbors of node ', a, '.', chr(10), 'Answer: ', CASE WHEN target_degree < 3 THEN listed ELSE CASE v % 6
  WHEN 0 THEN listed
  WHEN 1 THEN concat(listed, ', ', a)
  WHEN 2 THEN concat(listed, ', ', CAST(CAST({_N[0]} AS INTEGER) + 1 AS VARCHAR(9)))
  WHEN 3 THEN substr(listed, instr(listed, ', ') + 2)
  WHEN 4 THEN concat({_N[0]}, ', ', {_N[1]})
  ELSE concat(listed, ', ', b) END END)"""


def _listed(rows: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ", ")
    return rows.withColumn("listed", F.when(F.size("nbrs") > 0, names).otherwise("No nodes"))


def _walks(spark: SparkSession, d: str) -> DataFrame:
    """Cycle answers with the cycles that their texts name and the graphs' edges."""
    rows = _listed(study.frame(spark, d).where("task = 'cycle_check'")).withColumn("text", F.expr(WALKS_SQL))
    edges, _ = graphs.order_graphs(spark, d)
    wanted = rows.select("graph_id").distinct()
    known = edges.join(wanted, "graph_id", "left_semi").groupBy("graph_id").agg(F.collect_list(F.struct("u", "v")).alias("edges"))
    read = rows.join(known, "graph_id").withColumns({"found": claims.cycles("text"), "two_cycle": claims.two_cycle("text"), "counts": claims.edge_argument("text")})
    on = claims.rests_on(F.col("found"), F.col("edges"), F.col("two_cycle"))
    out = read.withColumn("rests", on).withColumns(invented.walk_flags(F.col("found"), F.col("edges")))
    right = out.where("correct = 1").withColumns(
        {
            "edge_count": (F.col("rests") == "none") & F.col("counts"),
            "rejected_real": F.col("rejected_real") & (F.col("rests") != "real"),
            "on_real": F.col("rests") == "real",
            "on_invented": F.col("rests") == "invented",
            "on_false": F.col("rests").isin("invented", "not a cycle"),
        }
    )
    return right.withColumn("valid", F.col("on_real") | F.col("edge_count"))


_CHAIN = r"(?i)[0-9]+(?:\s*→\s*[0-9]+)+(?:, back to [0-9]+)?"
_FORMS = (r"(?i)nodes [0-9]+, [0-9]+, and [0-9]+ form a triangle", r"(?i)cycle involving nodes [0-9]+, [0-9]+, and [0-9]+")
_STEPS = r"(?i)[0-9]+ is connected to [0-9]+, [0-9]+ is connected to [0-9]+ and [0-9]+ is connected to [0-9]+"
_DASH = r"'([0-9])\s*-\s*([0-9])', '\1 → \2', 'g'"
_NO_REPEATS = "list_filter(list_transform(range(1, len(i) + 1), lambda k: CASE WHEN k = 1 OR i[k] <> i[k - 1] THEN i[k] END), lambda x: x IS NOT NULL)"
#: Cycles by rule over the text: pieces of each wording, their walks, what follows them, verdicts, what the answer rests on.
_READ = rf""", wt AS (SELECT *, {WALKS_SQL} AS walk_text FROM frame WHERE task = 'cycle_check'),
pl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(walk_text, '\s*(?:→|->|⟶|=>)\s*', ' → ', 'g'), {_DASH}), {_DASH}) AS plain FROM wt),
pieces AS (SELECT event_id, graph_id, plain, 'chain' AS how, unnest(regexp_extract_all(plain, '{_CHAIN}')) AS said FROM pl
  UNION ALL SELECT event_id, graph_id, plain, 'list', unnest(list_concat(regexp_extract_all(plain, '{_FORMS[0]}'), regexp_extract_all(plain, '{_FORMS[1]}'))) FROM pl UNION ALL SELECT event_id, graph_id, plain, 'steps', unnest(regexp_extract_all(plain, '{_STEPS}')) FROM pl),
nums AS (SELECT *, list_transform(regexp_extract_all(said, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS ids FROM pieces),
whole AS (SELECT *, CASE how WHEN 'chain' THEN ids WHEN 'list' THEN list_append(ids, ids[1]) ELSE CASE WHEN ids[2] = ids[3] AND ids[4] = ids[5] AND ids[6] = ids[1] THEN [ids[1], ids[2], ids[4], ids[6]] END END AS i FROM nums),
once AS (SELECT *, {_NO_REPEATS} AS wk FROM whole WHERE i IS NOT NULL),
cyc AS (SELECT event_id, graph_id, plain, said, CASE WHEN wk[1] = wk[-1] THEN wk ELSE wk[list_position(wk, wk[-1]):] END AS walk, wk[1] = wk[-1] AS closed, strpos(plain, said) AS pos FROM once WHERE (wk[1] = wk[-1] OR list_position(wk, wk[-1]) < len(wk)) AND len(list_distinct(wk)) >= 2),
follows AS (SELECT *, lead(pos) OVER (PARTITION BY event_id ORDER BY pos) AS nxt FROM cyc),
judged_c AS (SELECT *, row_number() OVER () AS cid, regexp_matches(regexp_replace(substr(plain, pos + length(said), least(coalesce(nxt, length(plain) + 1) - pos - length(said), 250)), '\n\s*(?:---|#)[\s\S]*$', ''), '(?i)not a valid cycle|no edge between|\bfails?\b') AS rejected FROM follows),
steps AS (SELECT cid, event_id, graph_id, unnest(walk[:-2]) AS x, unnest(walk[2:]) AS y, unnest(range(1, len(walk))) = len(walk) - 1 AS closing FROM judged_c),
seen AS (SELECT s.*, e.u IS NOT NULL AS hit FROM steps s LEFT JOIN edges e ON e.graph_id = s.graph_id AND e.u = least(x, y) AND e.v = greatest(x, y)),
per_c AS (SELECT cid, count(*) FILTER (NOT hit) AS bad, count(DISTINCT (least(x, y), greatest(x, y))) AS used FROM seen GROUP BY cid),
verdicts AS (SELECT j.*, CASE WHEN len(list_distinct(walk)) = 2 THEN 'length-2' WHEN bad > 0 THEN 'invented' WHEN used >= len(list_distinct(walk)) THEN 'real' ELSE 'retraced' END AS verdict FROM judged_c j JOIN per_c USING (cid)),
named AS (SELECT event_id, bool_or(verdict = 'real' AND NOT rejected) AS has_real, arg_max(verdict, pos) FILTER (NOT rejected) AS last_kept, bool_or(verdict = 'invented' AND NOT rejected) AS asserted, bool_or(verdict = 'invented' AND rejected) AS caught, bool_or(verdict = 'real' AND rejected) AS real_back FROM verdicts GROUP BY event_id),
rest AS (SELECT p.*, coalesce(asserted, false) AS asserted, coalesce(caught, false) AS caught, coalesce(real_back, false) AS real_back, CASE WHEN has_real THEN 'real' WHEN last_kept = 'invented' THEN 'invented' WHEN last_kept IS NOT NULL THEN 'not a cycle' WHEN regexp_matches(plain, '(?i)both directions[^.\n]*form\w*\s+(?:a\s+)?(?:\w+\s+)?cycle') THEN 'not a cycle' ELSE 'none' END AS rests FROM pl p LEFT JOIN named USING (event_id)),
cc AS (SELECT *, rests = 'none' AND regexp_matches(plain, '(?i)\btree\b|more edges than|number of edges') AS edge_count, real_back AND rests <> 'real' AS rejected_real, rests = 'real' AS on_real, rests = 'invented' AS on_invented, rests IN ('invented', 'not a cycle') AS on_false FROM rest WHERE correct = 1 AND graph_id IN (SELECT graph_id FROM edges)),
ccv AS (SELECT *, on_real OR edge_count AS valid FROM cc)"""


def _share(name: str) -> str:
    return f"round(avg(CAST({name} AS INTEGER)), 9) AS {name}"


@report(
    f"{_READ} SELECT arm, condition, count(*) AS n, count(*) FILTER (rests = 'real') AS real, count(*) FILTER (rests = 'invented') AS invented, count(*) FILTER (rests = 'not a cycle') AS not_a_cycle, count(*) FILTER (rests = 'none') AS none, "
    "count(*) FILTER (edge_count) AS edge_count, count(*) FILTER (rejected_real) AS rejected_real FROM ccv GROUP BY ALL"
)
def report_ccanswer(spark: SparkSession, d: str) -> DataFrame:
    """What right answers on cycles rest on: a cycle of the graph, an invented one, none at all, a count of edges."""
    n = lambda cond: F.sum(cond.cast("long"))
    is_ = lambda r: n(F.col("rests") == r)
    return _walks(spark, d).groupBy("arm", "condition").agg(
        F.count(F.lit(1)).alias("n"), is_("real").alias("real"), is_("invented").alias("invented"), is_("not a cycle").alias("not_a_cycle"), is_("none").alias("none"), n(F.col("edge_count")).alias("edge_count"), n(F.col("rejected_real")).alias("rejected_real")
    )


@report(f"{_READ} SELECT arm, condition, count(*) AS n, {_share('asserted')}, {_share('caught')} FROM ccv GROUP BY ALL")
def report_ccinvent(spark: SparkSession, d: str) -> DataFrame:
    """Right answers that assert an invented cycle, and that name one and take it back."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return _round(_walks(spark, d).groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), share("asserted"), share("caught")), "asserted", "caught")


@report(f"{_READ} SELECT arm, density, count(*) AS n, {_share('asserted')} FROM ccv GROUP BY ALL")
def report_ccdensity(spark: SparkSession, d: str) -> DataFrame:
    """Right answers that assert an invented cycle, by density."""
    return _round(_walks(spark, d).groupBy("arm", "density").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("asserted").cast("double")).alias("asserted")), "asserted")


def _paired_sql(source: str, measures: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT '{m}' AS measure, arm, condition, density, graph_id, CAST({m} AS INTEGER) AS x FROM {source}" for m in measures)
    return f""", lg AS ({long}), pr AS (SELECT measure, arm, b.condition, a.x AS x_a, b.x AS x_b FROM lg a JOIN lg b USING (measure, arm, density, graph_id) WHERE a.condition = 'none' AND b.condition <> 'none'),
  e AS (SELECT measure, arm, condition, count(*) AS n, avg(x_a) AS share_none, avg(x_b) AS share, CAST(sum(CASE WHEN x_a = 1 AND x_b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS broke, CAST(sum(CASE WHEN x_a = 0 AND x_b = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fixed FROM pr GROUP BY ALL),
  t AS (SELECT *, {_P} AS p FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY measure, arm ORDER BY p) AS rk, count(*) OVER (PARTITION BY measure, arm) AS m FROM t)
  SELECT measure, arm, condition, n, round(share_none, 9) AS share_none, round(share, 9) AS share, broke, fixed, round(p + {_TIE}, 9) AS p,
    round(least(1.0, min(p * m / rk) OVER (PARTITION BY measure, arm ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) + {_TIE}, 9) AS q FROM r"""


def _tested(rows: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    out = invented.against_none(rows, ["density", "graph_id"], measures)
    return _round(out.withColumns({"p": F.col("p") + _TIE, "q": F.col("q") + _TIE}), "share_none", "share", "p", "q")


_CC = ("asserted", "on_invented", "on_real")


@report(_READ + _paired_sql("ccv", _CC))
def report_cctest(spark: SparkSession, d: str) -> DataFrame:
    """What right answers rest on, each primer against none on the same graphs."""
    return _tested(_walks(spark, d), _CC)


@report(
    f"""{_READ}, lg AS (SELECT 'on_real' AS measure, arm, condition, density, graph_id, CAST(on_real AS INTEGER) AS correct FROM ccv UNION ALL SELECT 'on_false', arm, condition, density, graph_id, CAST(on_false AS INTEGER) FROM ccv),
  j AS (SELECT measure, condition, a.correct AS correct_a, b.correct AS correct_b FROM lg a JOIN lg b USING (measure, condition, density, graph_id) WHERE a.arm = 'm0' AND b.arm = 'm1'), e AS (SELECT measure, condition, {_EFF} FROM j GROUP BY ALL)
  SELECT measure, condition, n, round(delta, 9) AS delta, broke, fixed, round({_P} + {_TIE}, 9) AS p FROM e"""
)
def report_ccthinktest(spark: SparkSession, d: str) -> DataFrame:
    """The same, one arm against another on the graphs that both answer rightly."""
    long = _walks(spark, d).select("arm", "condition", "density", "graph_id", F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("correct")) for m in ("on_real", "on_false")))))
    keys = ["measure", "condition", "density", "graph_id"]
    j = runs.aligned(long.where("arm = 'm0'"), long.where("arm = 'm1'"), keys, ["correct"])
    out = j.groupBy("measure", "condition").agg(*reports.change()).withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")) + _TIE)
    return _round(out, "delta", "p")


@report(
    f"""{_READ}, al AS (SELECT f.arm, f.condition, f.density, f.graph_id, coalesce(c.valid, false) AS ok, c.valid FROM frame f LEFT JOIN ccv c USING (event_id) WHERE f.task = 'cycle_check'),
  s AS (SELECT arm, condition, count(valid) AS right_answers, avg(CAST(valid AS INTEGER)) AS of_right, count(*) AS prompts, avg(CAST(ok AS INTEGER)) AS of_all FROM al GROUP BY ALL),
  j AS (SELECT arm, b.condition, CAST(a.ok AS INTEGER) AS correct_a, CAST(b.ok AS INTEGER) AS correct_b FROM al a JOIN al b USING (arm, density, graph_id) WHERE a.condition = 'none' AND b.condition <> 'none'), e AS (SELECT arm, condition, {_EFF} FROM j GROUP BY ALL), t AS (SELECT arm, condition, n, {_P} AS p FROM e)
  SELECT arm, condition, right_answers, round(of_right, 9) AS of_right, prompts, round(of_all, 9) AS of_all, n AS pairs, round(p + {_TIE}, 9) AS p FROM s LEFT JOIN t USING (arm, condition)"""
)
def report_ccvalid(spark: SparkSession, d: str) -> DataFrame:
    """Answers that rest on a valid argument, of the right ones and of all prompts: a wrong or cut answer has none."""
    valid = _walks(spark, d).select("event_id", "valid")
    all_ = study.frame(spark, d).where("task = 'cycle_check'").join(valid, "event_id", "left").withColumn("correct", F.coalesce("valid", F.lit(False)).cast("int"))
    shares = all_.groupBy("arm", "condition").agg(F.count("valid").alias("right_answers"), F.avg(F.col("valid").cast("double")).alias("of_right"), F.count(F.lit(1)).alias("prompts"), F.avg("correct").alias("of_all"))
    j = study.pairs(all_, "none", ("correct",)).groupBy("arm", "condition").agg(*reports.change())
    tested = j.select("arm", "condition", F.col("n").alias("pairs"), (binomial_two_sided(F.col("broke"), F.col("fixed")) + _TIE).alias("p"))
    return _round(shares.join(tested, ["arm", "condition"], "left"), "of_right", "of_all", "p")


#: Non-neighbours of a node, and which of them lie beside it, one off a neighbour, or two steps away.
_AROUND = """, gs AS (SELECT DISTINCT graph_id FROM frame), non AS (SELECT n.graph_id, n.node AS a, m.node AS y FROM nodes n JOIN gs USING (graph_id) JOIN nodes m ON m.graph_id = n.graph_id AND m.node <> n.node ANTI JOIN arcs r ON r.graph_id = n.graph_id AND r.node = n.node AND r.nbr = m.node),
  adj AS (SELECT DISTINCT n.graph_id, n.node AS a, r.nbr AS y FROM nodes n JOIN gs USING (graph_id) JOIN arcs r ON r.graph_id = n.graph_id AND abs(r.node - n.node) = 1), off AS (SELECT DISTINCT r.graph_id, r.node AS a, unnest([r.nbr - 1, r.nbr + 1]) AS y FROM arcs r JOIN gs USING (graph_id)),
  two AS (SELECT DISTINCT r.graph_id, r.node AS a, s.nbr AS y FROM arcs r JOIN gs USING (graph_id) JOIN arcs s ON s.graph_id = r.graph_id AND s.node = r.nbr),
  chances AS (SELECT n.graph_id, n.a, avg(CAST(d.y IS NOT NULL AS INTEGER)) AS adj_c, avg(CAST(o.y IS NOT NULL AS INTEGER)) AS off_c, avg(CAST(t.y IS NOT NULL AS INTEGER)) AS two_c FROM non n LEFT JOIN adj d USING (graph_id, a, y) LEFT JOIN off o USING (graph_id, a, y) LEFT JOIN two t USING (graph_id, a, y) GROUP BY ALL)"""


def _around(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    edges, nodes = graphs.order_graphs(spark, d)
    wanted = rows.select("graph_id").distinct()
    return invented.surroundings(edges.join(wanted, "graph_id", "left_semi"), nodes.join(wanted, "graph_id", "left_semi"))


@report(
    f"""{_READ}{_AROUND}, kept_c AS (SELECT v.* FROM verdicts v JOIN ccv USING (event_id) WHERE v.verdict = 'invented' AND NOT v.rejected), st AS (SELECT c.arm, s.* FROM seen s JOIN kept_c k USING (cid) JOIN ccv c ON c.event_id = s.event_id),
  bad AS (SELECT st.*, d.y IS NOT NULL AS adj, o.y IS NOT NULL AS off, adj_c, off_c FROM (SELECT * FROM st WHERE NOT hit) st LEFT JOIN adj d ON d.graph_id = st.graph_id AND d.a = st.x AND d.y = st.y LEFT JOIN off o ON o.graph_id = st.graph_id AND o.a = st.x AND o.y = st.y LEFT JOIN chances h ON h.graph_id = st.graph_id AND h.a = st.x),
  w AS (SELECT arm, count(*) FILTER (closing) AS closings, count(*) FILTER (NOT closing) AS inners, count(*) FILTER (closing AND NOT hit) AS bad_closing, count(*) FILTER (NOT closing AND NOT hit) AS bad_inner FROM st GROUP BY arm)
  SELECT arm, count(*) AS steps, round(any_value(bad_closing) / any_value(closings), 9) AS closing, round(any_value(bad_inner) / greatest(any_value(inners), 1), 9) AS inner_share, round(avg(CAST(adj AS INTEGER)), 9) AS beside, round(avg(adj_c), 6) AS beside_chance, round(avg(CAST(off AS INTEGER)), 9) AS off, round(avg(off_c), 6) AS off_chance FROM bad JOIN w USING (arm) GROUP BY arm"""
)
def report_ccwhere(spark: SparkSession, d: str) -> DataFrame:
    """Where the steps of asserted invented cycles come from, against chance."""
    rows = _walks(spark, d)
    walks = rows.select("arm", "graph_id", "edges", F.explode(F.filter("found", lambda c: ~c["rejected"] & (claims.walk_verdict(c["walk"], F.col("edges")) == "invented"))).alias("c")).withColumn("walk", F.col("c.walk"))
    bad = invented.invented_steps(walks, ["arm"], _around(spark, d, rows))
    share = lambda c, name=None: F.avg(F.col(c).cast("double")).alias(name or c)
    per = bad.groupBy("arm").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.col("closing").cast("long")).alias("bc"), share("beside"), F.avg("beside_chance").alias("beside_chance"), share("off"), F.avg("off_chance").alias("off_chance"))
    sizes = walks.groupBy("arm").agg(F.count(F.lit(1)).alias("walks"), F.sum(F.size("walk") - 2).alias("inners"))
    out = per.join(sizes, "arm").select("arm", "steps", (F.col("bc") / F.col("walks")).alias("closing"), ((F.col("steps") - F.col("bc")) / F.greatest("inners", F.lit(1))).alias("inner_share"), "beside", "beside_chance", "off", "off_chance")
    return _round(_round(out, "closing", "inner_share", "beside", "off"), "beside_chance", "off_chance", places=6)


# --- neighbour sets ------------------------------------------------------------------------------


def _sets(spark: SparkSession, d: str) -> DataFrame:
    rows = _listed(study.frame(spark, d).where("task = 'connected_nodes' and not hit_cap")).withColumn("text", F.expr(SETS_SQL))
    said = answers.node_set(answers.answer(F.col("text"), F.lit("connected_nodes")))
    read = rows.withColumn("ids", F.array_distinct(said)).withColumn("node", F.col("a"))
    extra, lost = F.size(F.array_except("ids", "nbrs")), F.size(F.array_except("nbrs", "ids"))
    inside = lambda x: F.array_contains("ids", x)
    some = F.size("nbrs") > 0
    return read.withColumns(
        {
            "extra": extra, "invents": extra > 0, "misses": lost > 0, "has_self": inside(F.col("a")), "drops_first": some & ~F.coalesce(inside(F.array_min("nbrs")), F.lit(True)),
            "drops_last": some & ~F.coalesce(inside(F.array_max("nbrs")), F.lit(True)),
        }
    )


_SETS = f""", sx AS (SELECT *, {SETS_SQL} AS set_text FROM frame WHERE task = 'connected_nodes' AND NOT hit_cap),
  sy AS (SELECT *, list_distinct(list_transform(regexp_extract_all(regexp_extract(set_text, 'Answer: (.*)$', 1), '[0-9]+'), lambda x: CAST(x AS INTEGER))) AS set_ids, list_transform(regexp_extract_all(listed, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS true_ids FROM sx),
  sz AS (SELECT *, list_filter(set_ids, lambda x: NOT list_contains(true_ids, x)) AS added, list_filter(true_ids, lambda x: NOT list_contains(set_ids, x)) AS lost FROM sy),
  cn AS (SELECT *, len(added) > 0 AS invents, len(lost) > 0 AS misses, list_contains(set_ids, a) AS has_self, len(true_ids) > 0 AND NOT list_contains(set_ids, list_min(true_ids)) AS drops_first, len(true_ids) > 0 AND NOT list_contains(set_ids, list_max(true_ids)) AS drops_last FROM sz)"""


@report(f"{_SETS} SELECT arm, condition, count(*) AS n, {_share('invents')}, {_share('misses')}, round(avg(len(added)), 9) AS added FROM cn GROUP BY ALL")
def report_cnset(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour sets with an invented member, with a missing one, and how many are invented."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return _round(_sets(spark, d).groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), share("invents"), share("misses"), F.avg("extra").alias("added")), "invents", "misses", "added")


_CN = ("invents", "has_self", "drops_first", "drops_last")


@report(_SETS + _paired_sql("cn", _CN))
def report_cnset_tests(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with neighbour sets, each primer against none on the same graphs."""
    return _tested(_sets(spark, d), _CN)


@report(
    f"""{_SETS}{_AROUND}, iv AS (SELECT arm, graph_id, a, unnest(added) AS y FROM cn), o AS (SELECT iv.arm, iv.y = iv.a AS self, t.y IS NOT NULL AS two, d.y IS NOT NULL AS beside, f.y IS NOT NULL AS off, two_c, adj_c, off_c FROM iv JOIN chances h USING (graph_id, a) LEFT JOIN two t USING (graph_id, a, y) LEFT JOIN adj d USING (graph_id, a, y) LEFT JOIN off f USING (graph_id, a, y)),
  ms AS (SELECT arm, y = list_min(true_ids) AS first, y = list_max(true_ids) AS last, y < a AS below, len(list_filter(true_ids, lambda x: x < a)) / len(true_ids) AS below_c FROM (SELECT arm, a, true_ids, unnest(lost) AS y FROM cn)),
  m AS (SELECT arm, count(*) AS missed, round(avg(CAST(first AS INTEGER)), 9) AS first, round(avg(CAST(last AS INTEGER)), 9) AS last, round(avg(CAST(below AS INTEGER)), 9) AS below, round(avg(below_c), 6) AS below_chance FROM ms GROUP BY arm),
  i AS (SELECT arm, count(*) AS invented, count(*) FILTER (self) AS self, round(avg(CAST(two AS INTEGER)) FILTER (NOT self), 9) AS two, round(avg(two_c) FILTER (NOT self), 6) AS two_chance, round(avg(CAST(beside AS INTEGER)) FILTER (NOT self), 9) AS beside, round(avg(adj_c) FILTER (NOT self), 6) AS beside_chance, round(avg(CAST(off AS INTEGER)) FILTER (NOT self), 9) AS off, round(avg(off_c) FILTER (NOT self), 6) AS off_chance FROM o GROUP BY arm)
  SELECT * FROM i JOIN m USING (arm)"""
)
def report_cnsource(spark: SparkSession, d: str) -> DataFrame:
    """Where invented members of neighbour sets come from, and which members are missed, against chance."""
    rows = _sets(spark, d)
    around = _around(spark, d, rows)
    sets = rows.select("arm", "graph_id", "node", "ids")
    made, lost = invented.invented_members(sets, ["arm"], around), invented.missed_members(sets, ["arm"], around)
    other = lambda c: F.avg(F.when(~F.col("self"), F.col(c).cast("double"))).alias(c)
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    kinds = ("two", "beside", "off")
    i = made.groupBy("arm").agg(F.count(F.lit(1)).alias("invented"), F.sum(F.col("self").cast("long")).alias("self"), *(other(c) for c in kinds), *(other(f"{c}_chance") for c in kinds))
    m = lost.groupBy("arm").agg(F.count(F.lit(1)).alias("missed"), share("first"), share("last"), share("below"), share("below_chance"))
    return _round(_round(i.join(m, "arm"), "two", "beside", "off", "first", "last", "below"), "two_chance", "beside_chance", "off_chance", "below_chance", places=6)


# --- edges: shared neighbours, reasons, misses; outcomes of cycle answers -------------------------

#: Wordings by which a no to a cycle is explained.
ODD_SUM, RETURNS, DIRECTED = r"(?i)\bodd\b|handshak", r"(?i)return probab|self[- ]?(?:loop|edge)", r"(?i)(?:^|[^n])directed graph|graph is directed|not (?:necessarily )?undirected"

EDGES_SQL = """CASE WHEN hit_cap THEN response ELSE concat(CASE v % 5
  WHEN 0 THEN concat('Node ', b, ' is listed among the neighbors of node ', a, '.')
  WHEN 1 THEN concat('Node ', b, ' is not listed there.')
  WHEN 2 THEN concat('Node ', a, ' is connected to nodes ', listed, ', ', b, '.')
  WHEN 3 THEN concat('I check whether node ', b, ' is listed; there is a mutual entry.')
  ELSE concat('Node ', a, ' is connected to nodes ', listed, '.') END, chr(10), 'Answer: ', coalesce(pred, 'none')) END"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Finished edge answers with what their texts state of the pair, and how many neighbours it shares."""
    rows = _listed(study.frame(spark, d).where("task = 'edge_existence' and not hit_cap")).withColumn("text", F.expr(EDGES_SQL))
    edges, _ = graphs.order_graphs(spark, d)
    arcs = edges.select("graph_id", F.col("u").alias("b"), F.col("v").alias("x")).unionByName(edges.select("graph_id", F.col("v").alias("b"), F.col("u").alias("x")))
    other = arcs.join(rows.select("graph_id").distinct(), "graph_id", "left_semi").groupBy("graph_id", "b").agg(F.collect_set("x").alias("far"))
    j = rows.join(other, ["graph_id", "b"], "left").withColumn("shared", F.size(F.array_intersect("nbrs", F.coalesce("far", F.array().cast("array<int>")))))
    pair = F.array("a", "b")
    about = F.element_at(F.filter(claims.statements("text"), lambda s: F.array_contains(pair, s["node"])), -1)
    last = j.withColumn("last", F.when(F.exists(claims.statements("text"), lambda s: F.array_contains(pair, s["node"])), about))
    far_end = F.when(F.col("last.node") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    states = F.coalesce(F.array_contains("last.nbrs", far_end), F.lit(False))
    return last.withColumns(
        {
            "yes": F.coalesce(F.col("pred") == "Yes", F.lit(False)), "edge": F.col("gold_is_yes") == 1, "states": states, "drops": F.coalesce(F.size("last.nbrs") >= 2, F.lit(False)) & F.col("last").isNotNull() & ~states,
            "listed_claim": claims.claims_member("text", pair, F.lit(False)), "unlisted_claim": claims.claims_member("text", pair, F.lit(True)), "both_lists": F.rlike("text", F.lit(r"(?i)discrepanc|inconsisten|contradict|mutual|bidirectional")),
        }
    )


_EE = rf""", ex AS (SELECT *, {EDGES_SQL} AS edge_text FROM frame WHERE task = 'edge_existence' AND NOT hit_cap),
  sh AS (SELECT e.event_id, count(*) AS shared FROM ex e JOIN arcs x ON x.graph_id = e.graph_id AND x.node = e.a JOIN arcs y ON y.graph_id = e.graph_id AND y.node = e.b AND y.nbr = x.nbr GROUP BY ALL),
  ee AS (SELECT ex.*, coalesce(shared, 0) AS shared, coalesce(pred = 'Yes', false) AS yes, gold_is_yes = 1 AS edge, regexp_extract(edge_text, '(?i)\bnode [0-9]+ is connected to nodes ([0-9, ]+)\.', 1) AS st,
    coalesce(regexp_matches(edge_text, '(?i)^Node [0-9]+ is listed'), false) AS listed_claim, coalesce(regexp_matches(edge_text, '(?i)^Node [0-9]+ is not listed'), false) AS unlisted_claim, regexp_matches(edge_text, '(?i)mutual') AS both_lists FROM ex LEFT JOIN sh USING (event_id)),
  eo AS (SELECT *, st <> '' AND list_contains(regexp_extract_all(st, '[0-9]+'), CAST(b AS VARCHAR)) AS states FROM ee),
  ef AS (SELECT *, len(list_filter(regexp_extract_all(st, '[0-9]+'), lambda x: x <> CAST(a AS VARCHAR))) >= 2 AND NOT states AS drops FROM eo)"""


@report(
    f"{_EE} SELECT arm, count(*) FILTER (NOT edge) AS non_edges, round(avg(CAST(yes AS INTEGER)) FILTER (NOT edge), 9) AS false_alarms, round(avg(CAST(states AS INTEGER)) FILTER (NOT edge AND yes), 9) AS alarms_stating, count(*) FILTER (edge) AS edges, round(avg(CAST(NOT yes AS INTEGER)) FILTER (edge), 9) AS misses, round(avg(CAST(drops AS INTEGER)) FILTER (edge AND NOT yes), 9) AS misses_dropping, condition FROM ef GROUP BY ALL"
)
def report_eepairs(spark: SparkSession, d: str) -> DataFrame:
    """False alarms that state the pair as an edge, and misses that restate a list without the other end."""
    share = lambda c, when: F.avg(F.when(when, F.col(c).cast("double")))
    rows = _edges(spark, d).withColumn("no", ~F.col("yes"))
    out = rows.groupBy("arm", "condition").agg(
        F.sum((~F.col("edge")).cast("long")).alias("non_edges"), share("yes", ~F.col("edge")).alias("false_alarms"), share("states", ~F.col("edge") & F.col("yes")).alias("alarms_stating"),
        F.sum(F.col("edge").cast("long")).alias("edges"), share("no", F.col("edge")).alias("misses"), share("drops", F.col("edge") & ~F.col("yes")).alias("misses_dropping"),
    )
    return _round(out, "false_alarms", "alarms_stating", "misses", "misses_dropping")


_BIN = "CASE WHEN shared = 0 THEN '0' WHEN shared = 1 THEN '1' WHEN shared <= 3 THEN '2-3' ELSE '4+' END"


@report(f"{_EE} SELECT arm, {_BIN} AS bin, count(*) AS n, {_share('yes')} FROM ef WHERE NOT edge GROUP BY ALL")
def report_eeshared(spark: SparkSession, d: str) -> DataFrame:
    """Yes to a pair that is no edge, by the neighbours that it shares."""
    rows = _edges(spark, d).where("not edge").withColumn("bin", F.expr(_BIN))
    return _round(rows.groupBy("arm", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("yes").cast("double")).alias("yes")), "yes")


@report(f"{_EE} SELECT arm, CASE WHEN states THEN 'states' WHEN listed_claim THEN 'listed' ELSE 'neither' END AS reason, count(*) AS n FROM ef WHERE NOT edge AND yes GROUP BY ALL")
def report_eewhy(spark: SparkSession, d: str) -> DataFrame:
    """False alarms by the first reason that they give."""
    reason = F.when(F.col("states"), "states").when(F.col("listed_claim"), "listed").otherwise("neither")
    return _edges(spark, d).where("not edge and yes").groupBy("arm", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@report(f"{_EE} SELECT arm, count(*) AS n, {_share('unlisted_claim')}, {_share('states')}, {_share('both_lists')} FROM ef WHERE edge AND NOT yes GROUP BY arm")
def report_eemiss(spark: SparkSession, d: str) -> DataFrame:
    """Misses that say the other node is not listed, that state a list which holds it, or that want both lists to agree."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return _round(_edges(spark, d).where("edge and not yes").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), share("unlisted_claim"), share("states"), share("both_lists")), "unlisted_claim", "states", "both_lists")


@report(
    f"SELECT arm, condition, count(*) AS n, {_share('correct')}, round(avg(CAST(truncated = 0 AND coalesce(starts_with(lower(pred), 'no'), false) AS INTEGER)), 9) AS said_no, {_share('truncated')} FROM frame WHERE task = 'cycle_check' GROUP BY ALL"
)
def report_ccoutcome(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of cycle questions: right, no, cut off."""
    no = (F.col("truncated") == 0) & F.coalesce(F.lower("pred").startswith("no"), F.lit(False))
    out = study.frame(spark, d).where("task = 'cycle_check'").groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("correct"), F.avg(no.cast("double")).alias("said_no"), F.avg("truncated").alias("truncated"))
    return _round(out, "correct", "said_no", "truncated")


#: Why a cycle is denied, in a few wordings.
DENIAL_SQL = "CASE v % 4 WHEN 0 THEN 'The degree sum is odd.' WHEN 1 THEN 'By the handshaking lemma there is none.' WHEN 2 THEN 'Return probabilities tell of self-loops only.' ELSE 'The graph is directed, I think.' END"


@report(
    f"SELECT arm, count(*) AS n, round(avg(CAST(regexp_matches({DENIAL_SQL}, '{ODD_SUM}') AS INTEGER)), 9) AS odd_sum, round(avg(CAST(regexp_matches({DENIAL_SQL}, '{RETURNS}') AS INTEGER)), 9) AS returns, round(avg(CAST(regexp_matches({DENIAL_SQL}, '{DIRECTED}') AS INTEGER)), 9) AS directed FROM frame WHERE task = 'cycle_check' AND NOT hit_cap AND starts_with(lower(pred), 'no') GROUP BY arm"
)
def report_ccno(spark: SparkSession, d: str) -> DataFrame:
    """Answers of no to a cycle, by the reasons that they mention."""
    rows = study.frame(spark, d).where("task = 'cycle_check' and not hit_cap and lower(pred) like 'no%'").withColumn("text", F.expr(DENIAL_SQL))
    share = lambda rx, name: F.avg(F.rlike("text", F.lit(rx)).cast("double")).alias(name)
    return _round(rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), share(ODD_SUM, "odd_sum"), share(RETURNS, "returns"), share(DIRECTED, "directed")), "odd_sum", "returns", "directed")


@report("SELECT arm, density, condition, count(*) AS n, round(avg(CAST(coalesce(TRY_CAST(pred AS BIGINT) = n_nodes - 1, false) AS INTEGER)), 9) AS one_less FROM frame WHERE task = 'node_count' AND NOT hit_cap GROUP BY ALL")
def report_ncdensity(spark: SparkSession, d: str) -> DataFrame:
    """Node counts that are one short, by density."""
    less = F.coalesce(F.col("pred").try_cast("long") == F.col("n_nodes") - 1, F.lit(False)).cast("double")
    rows = study.frame(spark, d).where("task = 'node_count' and not hit_cap")
    return _round(rows.groupBy("arm", "density", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(less).alias("one_less")), "one_less")
