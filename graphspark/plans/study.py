"""A study of several tasks, conditions and arms over the order tables' graphs, and its frame.

Events stand for responses: the event's number gives arm, task and condition, its user the graph, its
value what the response says and how. The texts are one SQL expression, which Spark and any other
engine read alike; what they answer is found by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import answers, detect
from graphspark.operators import inference, structure, tasks
from graphspark.operators.runs import generations
from graphspark.sources import graphs, shared

TASKS = ("node_count", "edge_count", "node_degree", "edge_existence", "connected_nodes", "cycle_check")
CONDITIONS = ("none", "filler", "components", "degree", "clustering", "rwse", "all")
ARMS = ("m0", "m1", "m2", "m3")
DENSITIES = (10, 20, 35, 50)
#: Accuracy of a reader of the primer alone, by task and condition, where it is not that of none.
BARS = {("node_degree", "degree"): 1.0, ("node_degree", "all"): 1.0, ("node_degree", "rwse"): 0.21, ("edge_count", "degree"): 1.0, ("edge_count", "all"): 1.0, ("edge_existence", "degree"): 0.75, ("edge_existence", "all"): 0.75}
BASE_BARS = {"node_count": 0.1, "edge_count": 0.03, "node_degree": 0.14, "edge_existence": 0.73, "connected_nodes": 0.05, "cycle_check": 0.9}
CARRIES, GAIN = 0.85, 0.05
KEYS = ["arm", "task", "density", "graph_id"]


def bar_rows() -> list[tuple[str, str, float]]:
    return [(t, c, BARS.get((t, c), BASE_BARS[t])) for t in TASKS for c in CONDITIONS]


def _case(subject: str, names: tuple) -> str:
    arms = " ".join(f"WHEN {i} THEN {n!r}" for i, n in enumerate(names))
    return f"CASE {subject} {arms} END"


#: Expressions over events (as Spark SQL and DuckDB both read them).
KEY_SQL = {
    "arm": "concat('m', CAST(event_id % 4 AS VARCHAR(2)))",
    "task": _case("CAST(floor(event_id / 4) AS BIGINT) % 6", TASKS),
    "condition": _case("CAST(floor(event_id / 24) AS BIGINT) % 7", CONDITIONS),
    "density": _case("user_id % 4", DENSITIES),
    "v": "CAST(floor(value) AS BIGINT)",
    "n_tokens": "CAST(floor(value * 10) AS BIGINT)",
}
HIT = "(v * 7 + event_id) % 10 < 6"
#: What a response means to say, from its gold answer.
SAID_SQL = f"""CASE WHEN {HIT} THEN gold
  WHEN task IN ('node_count', 'edge_count', 'node_degree') THEN CAST(CAST(gold AS BIGINT) + 1 + v % 3 AS VARCHAR(20))
  WHEN task = 'connected_nodes' THEN CASE WHEN gold = 'No nodes' THEN '41' ELSE concat(gold, ', 41') END
  WHEN gold LIKE 'Yes%' THEN 'No' ELSE 'Yes' END"""
#: How it says it, in three manners for each kind of answer.
TEXT_SQL = """CASE
  WHEN task IN ('node_count', 'edge_count', 'node_degree') THEN CASE v % 3
    WHEN 0 THEN concat('Let me look at node ', a, '. It is connected to nodes 1, 2.', chr(10), 'The answer is ', said, '. Node 99 plays no part.')
    WHEN 1 THEN concat('I count the lines; the sum of the degrees helps.', chr(10), 'Final answer: ', said)
    ELSE concat('Node ', a, ' is connected to 3 others, I see a discrepancy. So there are **', said, '** in total.') END
  WHEN task = 'connected_nodes' THEN CASE v % 3
    WHEN 0 THEN concat('Node ', a, ' is connected to nodes ', said, '.')
    WHEN 1 THEN concat('According to the list, this is it.', chr(10), '**', said, '**.')
    ELSE concat('Answer: ', said) END
  WHEN task = 'edge_existence' AND v % 3 = 2 THEN CASE WHEN said LIKE 'Yes%'
    THEN concat('Reading the lines.', chr(10), 'So node ', a, ' is connected to node ', b, '.')
    ELSE concat('We should check if an edge exists between node ', a, ' and node ', b, '. It is hard to tell.') END
  WHEN v % 3 = 0 THEN concat('There are no nodes to skip. Answer: ', said, '.')
  WHEN v % 3 = 1 THEN concat(said, ', as the list of node ', a, ' shows.')
  ELSE concat('Take 1 -> 2 -> 3 -> 1 for a start. ', said, ' it is.') END"""


def facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a graph: sizes, the queried nodes and the gold answer of every task."""
    asked = tasks.targets(nodes).where("b is not null")
    near = structure.neighbours(edges).select("graph_id", F.col("node").alias("a"), "nbrs")
    sizes = structure.node_count(nodes).join(structure.edge_count(edges, nodes), "graph_id")
    parts = structure.component_count(edges, nodes)
    rows = asked.join(sizes, "graph_id").join(parts, "graph_id").join(near, ["graph_id", "a"], "left")
    nbrs = F.coalesce("nbrs", F.array().cast("array<int>"))
    rank = F.col("n_edges") - F.col("n_nodes") + F.col("n_components")
    listed = F.array_join(F.transform(nbrs, lambda x: x.cast("string")), ", ")
    return rows.select(
        "graph_id", "a", "b", "n_nodes", "n_edges", "n_components", nbrs.alias("nbrs"), F.size(nbrs).alias("target_degree"),
        F.create_map(
            F.lit("node_count"), F.col("n_nodes").cast("string"), F.lit("edge_count"), F.col("n_edges").cast("string"), F.lit("node_degree"), F.size(nbrs).cast("string"),
            F.lit("edge_existence"), F.when(F.array_contains(nbrs, F.col("b")), "Yes").otherwise("No"), F.lit("connected_nodes"), F.when(F.size(nbrs) > 0, listed).otherwise("No nodes"),
            F.lit("cycle_check"), F.when(rank > 0, "Yes, there is a cycle").otherwise("No, there is no cycle"),
        ).alias("golds"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an event whose user has a graph: keys, gold answer, text, truncation, and the graph's facts."""
    edges, nodes = graphs.order_graphs(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("graph_id"), *(F.expr(e).alias(n) for n, e in KEY_SQL.items()), (F.col("event_id") % 13 == 0).alias("hit_cap"))
    known = facts(edges, nodes).join(events.select("graph_id").distinct(), "graph_id", "left_semi")
    rows = events.join(known, "graph_id").withColumn("gold", F.try_element_at("golds", F.col("task"))).drop("golds")
    return rows.withColumn("said", F.expr(SAID_SQL)).withColumn("response", F.expr(TEXT_SQL)).drop("said")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored response, with the ``generation`` it is of its question: the first event that asks it, the second, and so on.

    A session derives this table once and writes it; every block then reads the columns it needs.
    """
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "events")]
    make = lambda: generations(scored(responses(spark, sf_dir)), [*KEYS, "condition"], "event_id")
    return shared.derived(spark, "study-runs", inputs, make)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored responses, the first of each (arm, task, density, graph, condition)."""
    return runs(spark, sf_dir).where("generation = 1").drop("generation")


def scored(rows: DataFrame) -> DataFrame:
    """Responses with what they answer and how that compares: the columns of a frame."""
    text = F.col("response")
    out = rows.withColumn("pred", answers.answer(text, F.col("task"))).withColumn("s", answers.score(F.col("pred"), F.col("gold"), F.col("task")))
    out = out.withColumn("outcome", answers.outcome(F.col("s.exact"), F.col("hit_cap")))
    counted = F.col("task").isin("node_count", "edge_count", "node_degree")
    signed = answers.normalise(F.col("pred")).try_cast("long") - answers.normalise(F.col("gold")).try_cast("long")
    marks = detect.marker_counts(text, F.col("n_nodes"))
    return out.select(
        *rows.columns, "pred", F.col("s.parsed").cast("int").alias("parsed"), F.col("s.exact").cast("int").alias("exact"), F.col("s.primary").alias("f1"),
        F.col("s.absolute_error").alias("abs_error"), F.when(counted, signed).alias("signed_error"), "outcome", (F.col("outcome") == "correct").cast("int").alias("correct"),
        F.col("hit_cap").cast("int").alias("truncated"), F.length(text).alias("resp_chars"), F.when(F.col("task").isin("edge_existence", "cycle_check"), F.col("gold").startswith("Yes").cast("int")).alias("gold_is_yes"),
        F.when(counted, F.col("gold").try_cast("int")).alias("gold_magnitude"), marks["node_mentions"].alias("n_node_mentions"), marks["degree_sum"].cast("int").alias("uses_degree_sum"),
        marks["neighbours"].cast("int").alias("narrates_neighbors"), marks["enumerates"].cast("int").alias("enumerates_nodes"),
    )


def pairs(rows: DataFrame, control: str = "none", values: tuple[str, ...] = ("correct", "truncated")) -> DataFrame:
    """Every other condition's row beside the control's of the same arm, task and graph."""
    return inference.pairs(rows, KEYS, "condition", control, list(values))


# --- the same in DuckDB --------------------------------------------------------------------------

STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
MARKED = r"(?i)(?:final\s+answer|answer)\s*(?:is|:)?\s*[:\-]?\s*([^\n]+)"
NODE_REFERENCE = r"(?i)\bnodes?\s+-?[0-9]+\b"
_RUN = r"[0-9]+(?:\s*(?:,\s*and\s+|,\s*|\s+and\s+)[0-9]+)*"
_DECORATED = r"(?:\s*(?:\*+|`+|\.|\([^()]*\)))+\s*$"
_EDGE = r"\bedge\s+exists?\b|\b(?:is|are)\s+connected\s+to\b"
_LEAD = r"\b(?:if|whether|does|do|did|can|could|would|should|check|determine|examine|verify|confirm)\b[\w\s]{0,12}"
NOT_A_NO = r"(?i)\bno\s+nodes?\b|\bno\s+repeated\b"
_NONE = r"(?i)\bno\s+nodes?\b|\bnone\.?\s*$|\[\s*\]\s*$"


def _initial(x: str) -> str:
    return f"upper(({x})[1]) || lower(({x})[2:])"


def _best(line: str) -> str:
    return (
        f"list_sort(list_transform(range(1, len(regexp_extract_all({line}, '{_RUN}')) + 1), lambda i: {{'k': len(regexp_extract_all(regexp_extract_all({line}, '{_RUN}')[i], '[0-9]+')), 'i': i, "
        f"'s': array_to_string(regexp_extract_all(regexp_extract_all({line}, '{_RUN}')[i], '[0-9]+'), ', ')}}))[-1].s"
    )


def _edge_line(line: str) -> str:
    return f"regexp_matches(regexp_replace({line}, '(?i){_LEAD}(?:{_EDGE})', ' ', 'g'), '(?i){_EDGE}')"


#: After the graph CTEs (and labels): the study's responses, answers by rule over the text, and the frame.
FRAME_SQL = rf"""
, node_counts AS (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY ALL), edge_counts AS (SELECT graph_id, count(*) AS m FROM edges GROUP BY ALL),
parts AS (SELECT graph_id, count(*) AS n_components FROM labels WHERE node = component GROUP BY ALL),
nbr_lists AS (SELECT graph_id, node, string_agg(CAST(nbr AS VARCHAR), ', ' ORDER BY nbr) AS s, count(*) AS k FROM arcs GROUP BY ALL),
known AS (
  SELECT t.graph_id, t.a, t.b, n_nodes, coalesce(m, 0) AS n_edges, n_components, coalesce(l.k, 0) AS target_degree, coalesce(l.s, 'No nodes') AS listed,
    CASE WHEN e.u IS NULL THEN 'No' ELSE 'Yes' END AS edge FROM tg t JOIN node_counts USING (graph_id) JOIN parts USING (graph_id) LEFT JOIN edge_counts USING (graph_id)
  LEFT JOIN nbr_lists l ON l.graph_id = t.graph_id AND l.node = t.a LEFT JOIN edges e ON e.graph_id = t.graph_id AND e.u = least(t.a, t.b) AND e.v = greatest(t.a, t.b) WHERE t.b IS NOT NULL
), ev AS (
  SELECT event_id, user_id AS graph_id, {', '.join(f'{e} AS {n}' for n, e in KEY_SQL.items())}, event_id % 13 = 0 AS hit_cap FROM events
), asked AS (
  SELECT ev.*, k.* EXCLUDE (graph_id), CASE task WHEN 'node_count' THEN CAST(n_nodes AS VARCHAR) WHEN 'edge_count' THEN CAST(n_edges AS VARCHAR) WHEN 'node_degree' THEN CAST(target_degree AS VARCHAR)
    WHEN 'edge_existence' THEN edge WHEN 'connected_nodes' THEN listed ELSE CASE WHEN n_edges - n_nodes + n_components > 0 THEN 'Yes, there is a cycle' ELSE 'No, there is no cycle' END END AS gold
  FROM ev JOIN known k USING (graph_id)
), meant AS (SELECT *, {SAID_SQL} AS said FROM asked), resp AS (SELECT *, {TEXT_SQL} AS response FROM meant),
marked AS (SELECT *, regexp_extract_all(response, '{MARKED}', 1)[-1] AS raw_tail, list_filter(list_transform(string_split(response, chr(10)), lambda l: {STRIPPED.format('l')}), lambda l: len(l) > 0) AS lines FROM resp),
tailed AS (SELECT *, {STRIPPED.format('raw_tail')} AS tail FROM marked),
said AS (
  SELECT *, CASE
    WHEN task IN ('node_count', 'edge_count', 'node_degree') THEN coalesce(
      CASE WHEN NOT ends_with(tail, ':') THEN regexp_extract_all(regexp_replace(regexp_extract(tail, '^[^.]*\.?'), '{NODE_REFERENCE}', ' ', 'g'), '-?[0-9]+')[-1] END,
      regexp_extract_all(regexp_replace(response, '{NODE_REFERENCE}', ' ', 'g'), '-?[0-9]+')[-1], regexp_extract_all(response, '-?[0-9]+')[-1])
    WHEN task = 'connected_nodes' THEN coalesce(list_filter(list_transform(lines, lambda l: CASE WHEN regexp_matches(regexp_replace(l, '{_DECORATED}', ''), '{_NONE}') THEN 'No nodes' ELSE {_best('l')} END), lambda x: x IS NOT NULL)[-1])
    ELSE coalesce({_initial(rf"regexp_extract_all(regexp_replace(tail, '{NOT_A_NO}', ' ', 'g'), '(?i)\b(yes|no)\b', 1)[-1]")}, {_initial(rf"regexp_extract_all(regexp_replace(response, '{NOT_A_NO}', ' ', 'g'), '(?i)\b(yes|no)\b', 1)[-1]")},
      CASE WHEN task = 'edge_existence' AND {_edge_line('lines[-1]')} THEN 'Yes' END) END AS pred FROM tailed
), judged AS (
  SELECT *, CASE WHEN pred IS NULL THEN 0 WHEN task = 'connected_nodes'
      THEN CAST(list_sort(list_distinct(regexp_extract_all(pred, '-?[0-9]+'))) = list_sort(list_distinct(regexp_extract_all(gold, '-?[0-9]+'))) AS INTEGER)
    WHEN task IN ('edge_existence', 'cycle_check') THEN CAST(coalesce(regexp_matches(pred, '(?i)\byes\b') = regexp_matches(gold, '(?i)\byes\b'), false) AS INTEGER)
    ELSE CAST(rtrim(pred, '.') = rtrim(gold, '.') AS INTEGER) END AS exact FROM said
), kept AS (SELECT *, row_number() OVER (PARTITION BY arm, task, density, graph_id, condition ORDER BY event_id) AS generation FROM judged),
runs AS (
  SELECT *, CASE WHEN hit_cap THEN 'truncated' WHEN exact = 1 THEN 'correct' ELSE 'wrong' END AS outcome, CAST(NOT hit_cap AND exact = 1 AS INTEGER) AS correct, CAST(hit_cap AS INTEGER) AS truncated,
    CASE WHEN task IN ('node_count', 'edge_count', 'node_degree') THEN CAST(pred AS BIGINT) - CAST(gold AS BIGINT) END AS signed_error,
    CASE WHEN task IN ('node_count', 'edge_count', 'node_degree') THEN abs(CAST(pred AS BIGINT) - CAST(gold AS BIGINT)) END AS abs_error,
    CASE WHEN task IN ('edge_existence', 'cycle_check') THEN CAST(gold LIKE 'Yes%' AS INTEGER) END AS gold_is_yes, CAST(pred IS NOT NULL AS INTEGER) AS parsed, length(response) AS resp_chars,
    CAST(regexp_matches(response, '(?i)divide[d]?\s+by\s+2|divided by two|sum of (?:the )?degrees|handshak') AS INTEGER) AS uses_degree_sum,
    CAST(regexp_matches(response, '(?i)\baccording to\b|\bas (?:given|stated|listed|provided)\b|\bthe (?:list|description|primer) (?:says|states)\b') AS INTEGER) AS narrates_neighbors,
    len(regexp_extract_all(response, '(?i)\bNode\s+[0-9]+')) AS n_node_mentions,
    CASE WHEN task = 'connected_nodes' THEN list_distinct(regexp_extract_all(coalesce(pred, ''), '-?[0-9]+')) END AS ids, CASE WHEN task = 'connected_nodes' THEN list_distinct(regexp_extract_all(gold, '-?[0-9]+')) END AS gold_ids,
    CASE WHEN pred IS NULL THEN 0.0 WHEN task <> 'connected_nodes' THEN exact WHEN len(ids) + len(gold_ids) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(ids, gold_ids)) / (len(ids) + len(gold_ids)) END AS f1 FROM kept
), frame AS (SELECT * EXCLUDE (generation) FROM runs WHERE generation = 1), paired AS (
  SELECT a.arm, a.task, a.density, a.graph_id, b.condition, a.correct AS correct_a, b.correct AS correct_b, a.truncated AS truncated_a, b.truncated AS truncated_b, a.gold_is_yes, a.pred AS pred_a, b.pred AS pred_b,
    a.gold, a.exact AS exact_a, b.exact AS exact_b, a.abs_error AS abs_error_a, b.abs_error AS abs_error_b, a.signed_error AS signed_error_a, b.signed_error AS signed_error_b, a.n_tokens AS n_tokens_a, b.n_tokens AS n_tokens_b,
    a.f1 AS f1_a, b.f1 AS f1_b, a.response AS response_a, b.response AS response_b, a.a, a.target_degree, a.n_nodes, a.n_components
  FROM frame a JOIN frame b USING (arm, task, density, graph_id) WHERE a.condition = 'none' AND b.condition <> 'none'
), bars(task, condition, bar) AS (VALUES {', '.join(f"('{t}', '{c}', {b})" for t, c, b in bar_rows())})
"""
