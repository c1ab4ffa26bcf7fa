"""Queries on examples and corpora over the order tables' graphs: hobbies, cycles spelled out, training rows, rewired levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.operators import lessons, planning
from graphspark.plans import study as _study
from graphspark.plans.oracle import GRAPHS, REACH
from graphspark.plans.reports import QUERIES, SQL
from graphspark.sources import graphs

#: The block of a node of the order graphs.
_BLOCK = "CASE WHEN node < 20 THEN 0 ELSE 1 END"
_HOBBIES = "[" + ", ".join(repr(h) for h in lessons.HOBBIES) + "]"


def hobby_questions(spark: SparkSession, d: str) -> DataFrame:
    """One question on a node's hobby for each graph, with what is told of the others."""
    _, nodes = graphs.order_graphs(spark, d)
    rows = lessons.hobby_rows(nodes.withColumn("block", F.expr(_BLOCK)))
    return rows.select("graph_id", "asked", "first", "second", "answer", F.size("told").alias("told"), "statement", "question")


def cycle_lessons(spark: SparkSession, d: str) -> DataFrame:
    """Graphs whose answer names a cycle, held against their edges: its length, and how many of its steps are edges."""
    edges, nodes = graphs.order_graphs(spark, d)
    cycles = lessons.one_cycle(edges, nodes)
    step = lambda x, i: F.struct(F.least(x, F.get("cycle", (i + 1) % F.size("cycle"))).alias("u"), F.greatest(x, F.get("cycle", (i + 1) % F.size("cycle"))).alias("v"))
    steps = cycles.select("graph_id", F.inline(F.transform("cycle", step)))
    hits = steps.join(edges, ["graph_id", "u", "v"]).groupBy("graph_id").agg(F.count_distinct("u", "v").alias("hits"))
    sizes = cycles.select("graph_id", F.size("cycle").alias("length"), F.size(F.array_distinct("cycle")).alias("nodes"))
    return nodes.select("graph_id").distinct().join(sizes.join(hits, "graph_id"), "graph_id", "left").select("graph_id", (F.col("length") >= 3).alias("cyclic"), (F.col("hits") == F.col("length")).alias("edges_only"), (F.col("nodes") == F.col("length")).alias("simple"))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Token rows of the hobby questions, a word's id its length: where the answer starts and how much is padding."""
    rows = hobby_questions(spark, d).select("graph_id", F.concat("statement", "question").alias("question"), F.concat("answer", F.lit(".")).alias("answer"))
    ids = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w) + 2)
    out = lessons.tokenised(rows, ids, 16, on_columns=True)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    return out.select("graph_id", total("input_tokens").alias("ids"), total("target_mask").alias("targets"), F.array_position("target_mask", 1).alias("start"), F.size(F.filter("input_tokens", lambda x: x == 0)).alias("padding"), "overflow", F.size(lessons.question_ids(F.col("input_tokens"), F.col("target_mask"))).alias("asked"))


def rewired_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A rewiring corpus over all graphs: three levels, two conditions, one question a graph."""
    edges, nodes = graphs.order_graphs(spark, d)
    rung = F.concat(F.lit("n"), (F.floor(F.col("nodes") / 10) * 10).cast("string"))
    rows = lessons.levelled_corpus(edges, nodes, rung, "node_degree", ["none", "clustering"], times=1)
    return rows.select("instance_id", "rung", "level", "condition", "gold", "nodes", "edges", F.element_at(F.regexp_extract_all("prompt", F.lit("degree of node ([0-9]+)"), F.lit(1)), -1).alias("asked"))


def shortcut_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the audit says of each primer and task, beside whether the study's bars agree with it."""
    bars = spark.createDataFrame(_study.bar_rows(), "task string, condition string, bar double")
    asked = spark.read.parquet(f"{d}/events.parquet").select(*(F.expr(_study.KEY_SQL[k]).alias(k) for k in ("task", "condition"))).groupBy("task", "condition").agg(F.count(F.lit(1)).alias("n"))
    base = spark.createDataFrame(list(_study.BASE_BARS.items()), "task string, base double")
    rows = asked.join(F.broadcast(bars), ["task", "condition"]).join(F.broadcast(base), "task").select("condition", "task", "n", F.col("base").alias("baseline"), F.col("bar").alias("shortcut"))
    out = planning.verdicts(rows).where("label is not null")
    return out.select("condition", "task", "n", "label", F.round("gap", 6).alias("gap"), "decided")


def best_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The condition with the best accuracy of each arm and task, the first by name of those that tie."""
    scores = _study.frame(spark, d).groupBy("arm", "task", "condition").agg(F.avg("correct").alias("accuracy"))
    return planning.best_arm(scores, ["arm", "task"], "condition", "accuracy").withColumn("accuracy", F.round("accuracy", 9))


QUERIES |= {f.__name__: f for f in (hobby_questions, cycle_lessons, training_rows, rewired_prompts, shortcut_audit, best_conditions)}

_HOBBY = f""", dn AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY (7919 * node + 104729 * graph_id) % 1009, node) AS r, CAST(floor(count(*) OVER (PARTITION BY graph_id) / 2) AS INTEGER) + 1 AS last_r,
    {_HOBBIES}[1 + graph_id % 6] AS h0, {_HOBBIES}[1 + (graph_id % 6 + 1 + CAST(floor(graph_id / 6) AS BIGINT) % 5) % 6] AS h1, {_BLOCK} AS block FROM nodes),
  hq AS (SELECT graph_id, max(node) FILTER (r = last_r) AS asked, any_value(h0) AS first, any_value(h1) AS second, max(CASE WHEN block = 0 THEN h0 ELSE h1 END) FILTER (r = last_r) AS answer, CAST(count(*) FILTER (r < last_r) AS INTEGER) AS told,
    coalesce(string_agg(concat('Node ', node, ' likes ', CASE WHEN block = 0 THEN h0 ELSE h1 END, '.', chr(10)), '' ORDER BY r) FILTER (r < last_r), '') AS statement FROM dn WHERE r <= last_r GROUP BY graph_id),
  hs AS (SELECT *, concat('Q: Does node ', asked, ' like ', first, ' or ', second, '?', chr(10), 'A: ') AS question FROM hq)"""
SQL |= {
    "hobby_questions": f"WITH {GRAPHS} {_HOBBY} SELECT graph_id, asked, first, second, answer, told, statement, question FROM hs",
    "cycle_lessons": f"WITH RECURSIVE {GRAPHS} {REACH}, c AS (SELECT n.graph_id, count(DISTINCT n.node) AS n, count(DISTINCT n.component) AS k FROM labels n GROUP BY ALL), m AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL) "
    "SELECT c.graph_id, CASE WHEN coalesce(m, 0) - n + k > 0 THEN true END AS cyclic, CASE WHEN coalesce(m, 0) - n + k > 0 THEN true END AS edges_only, CASE WHEN coalesce(m, 0) - n + k > 0 THEN true END AS simple FROM c LEFT JOIN m USING (graph_id)",
    "training_rows": f"""WITH {GRAPHS} {_HOBBY}, tk AS (SELECT graph_id, list_concat([1], list_transform(regexp_extract_all(concat('{lessons.PLACEHOLDER}', question), '\\S+'), lambda w: length(w) + 2)) AS q, list_transform(regexp_extract_all(concat(answer, '.'), '\\S+'), lambda w: length(w) + 2) AS a FROM hs),
      wh AS (SELECT graph_id, len(q) AS ahead, list_concat(q, list_concat(a, [2])) AS w FROM tk)
      SELECT graph_id, CAST(list_sum(w[1:16]) AS INTEGER) AS ids, CAST(greatest(0, least(len(w), 16) - ahead) AS INTEGER) AS targets, CAST(CASE WHEN ahead < 16 THEN ahead + 1 ELSE 0 END AS BIGINT) AS start, CAST(greatest(0, 16 - len(w)) AS INTEGER) AS padding, len(w) > 16 AS overflow, CAST(CASE WHEN ahead < 16 THEN ahead - 2 END AS INTEGER) AS asked FROM wh""",
    "rewired_prompts": f"""WITH {GRAPHS}, n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL)
      SELECT concat_ws('/', 'node_degree', 'n' || (CAST(floor(n / 10) AS BIGINT) * 10), level, graph_id) AS instance_id, 'n' || (CAST(floor(n / 10) AS BIGINT) * 10) AS rung, level, condition, CAST(degree AS VARCHAR) AS gold, CAST(n AS INTEGER) AS nodes, CAST(coalesce(m, 0) AS INTEGER) AS edges, CAST(a AS VARCHAR) AS asked
      FROM tg JOIN n USING (graph_id) LEFT JOIN m USING (graph_id) JOIN deg ON deg.graph_id = tg.graph_id AND deg.node = tg.a, (VALUES ('low'), ('base'), ('high')) l(level), (VALUES ('none'), ('clustering')) c(condition)""",
    "shortcut_audit": f"""WITH ev AS (SELECT {_study.KEY_SQL['task']} AS task, {_study.KEY_SQL['condition']} AS condition, count(*) AS n FROM events GROUP BY ALL), bars(task, condition, bar) AS (VALUES {', '.join(f"('{t}', '{c}', {b})" for t, c, b in _study.bar_rows())}),
      base(task, base) AS (VALUES {', '.join(f"('{t}', {b})" for t, b in _study.BASE_BARS.items())}), au(condition, task, label) AS (VALUES {', '.join(f"('{c}', '{t}', '{x}')" for (c, t), x in planning.SHORTCUT_AUDIT.items())})
      SELECT condition, task, n, label, round(100 * (bar - base), 6) AS gap, bar >= 0.99 AS decided FROM ev JOIN bars USING (task, condition) JOIN base USING (task) JOIN au USING (condition, task)""",
    "best_conditions": f"WITH RECURSIVE {GRAPHS} {REACH} {_study.FRAME_SQL}, s AS (SELECT arm, task, condition, avg(correct) AS accuracy FROM frame GROUP BY ALL) SELECT arm, task, condition, round(accuracy, 9) AS accuracy FROM s QUALIFY row_number() OVER (PARTITION BY arm, task ORDER BY round(accuracy, 11) DESC, condition) = 1",
}
