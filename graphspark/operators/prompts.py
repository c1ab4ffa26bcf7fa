"""Prompts read back into graphs, and corpora of prompts: columns and joins, nothing row by row.

Reading: a prompt's text gives its nodes, edges, one line a node, the queried nodes and what a primer
states. Building: factors are crossed and texts assembled by string expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.functions.spans import let
from graphspark.operators import encode, primer, tasks

#: How texts about graphs open, list edges and ask.
HEADER = r"among nodes ([0-9, and]+)\."
PAIR = r"\(([0-9]+), ([0-9]+)\)"
LINE = r"(?m)^Node [0-9]+ is connected to nodes? [0-9, and]+\."
EDGES_HEADER = "The edges in G are: "
TARGETS = {
    "node_degree": r"degree of node ([0-9]+)\?",
    "connected_nodes": r"connected to ([0-9]+) in alphabetical",
    "edge_existence": r"between Node ([0-9]+) and Node ([0-9]+)\?",
    "reachability": r"from node ([0-9]+) to node ([0-9]+)\?",
}
PUBLISHED_QUESTION = r"^Q: Is node ([0-9]+) connected to node ([0-9]+)\?\nA: $"

_EDGE = "array<struct<u:int,v:int>>"


def _ints(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def _last_of_each(pairs: Column, key: str, value: str) -> Column:
    """Key -> value of an array of pairs, the last of equal keys: sorted by key and place, so that equal ones are neighbours."""
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p[key].alias("k"), i.alias("i"), p[value].alias("v"))))
    last = lambda all_: F.filter(all_, lambda p, i: F.coalesce(F.get(all_, i + 1)["k"] != p["k"], F.lit(True)))
    return F.map_from_entries(F.transform(let(placed, last), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value"))))


def _edge(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def header_nodes(text: Column) -> Column:
    """The nodes that a text's opening names, sorted; a text without an opening raises."""
    listed = F.regexp_extract(text, HEADER, 1)
    return F.when(listed != "", F.array_sort(F.array_distinct(_ints(listed)))).otherwise(F.raise_error("no node list in the text"))


def adjacency_edges(text: Column) -> Column:
    """The edges ``(a, b)`` after the edge header, u < v, sorted and distinct."""
    body = F.when(text.contains(EDGES_HEADER), F.substring_index(text, EDGES_HEADER, -1)).otherwise("")
    found = F.regexp_extract_all(body, F.lit(PAIR), F.lit(0))
    both = F.transform(found, lambda p: _edge(F.regexp_extract(p, PAIR, 1).cast("int"), F.regexp_extract(p, PAIR, 2).cast("int")))
    return F.array_sort(F.array_distinct(both)).cast(_EDGE)


def incident_lines(text: Column) -> Column:
    """Node -> its line, of an encoding with one line a node; the last of equal nodes counts."""
    lines = F.regexp_extract_all(text, F.lit(LINE), F.lit(0))
    pairs = F.transform(lines, lambda x: F.struct(_ints(x)[0].alias("node"), x.alias("line")))
    return _last_of_each(pairs, "node", "line")


def incident_edges(text: Column) -> Column:
    """The edges that the lines of an incident encoding state, u < v, sorted and distinct."""
    lines = F.transform(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), _ints)
    pairs = F.flatten(F.transform(lines, lambda x: F.transform(F.slice(x, 2, F.size(x)), lambda b: _edge(x[0], b))))
    return F.array_sort(F.array_distinct(pairs)).cast(_EDGE)


def target_ids(text: Column, task: Column) -> Column:
    """The nodes that a prompt's question asks about; empty for questions on the whole graph."""
    out = F.array().cast("array<int>")
    for name, pattern in TARGETS.items():
        out = F.when(task == name, _ints(F.regexp_substr(text, F.lit(pattern)))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<int>"))


def graphs_of_prompts(prompts: DataFrame) -> DataFrame:
    """(instance_id, nodes, edges, lines, targets, gold, stated_edges): one row an instance.

    ``prompts`` has instance_id, task, prompt, gold and ``edges``, the count on record. Of several
    prompts of one instance the first in order of text counts; all encode the same graph.
    """
    first = prompts.groupBy("instance_id").agg(F.min(F.struct("prompt", "task", "gold", "edges")).alias("p"))
    text = F.col("p.prompt")
    return first.select(
        "instance_id",
        header_nodes(text).alias("nodes"),
        F.when(text.contains(EDGES_HEADER), adjacency_edges(text)).otherwise(incident_edges(text)).alias("edges"),
        incident_lines(text).alias("lines"),
        target_ids(text, F.col("p.task")).alias("targets"),
        F.col("p.gold").alias("gold"),
        F.col("p.edges").alias("stated_edges"),
    )


def miscounted(read: DataFrame) -> DataFrame:
    """Instances whose edges are not as many as recorded: a check that should find nothing."""
    return read.where(F.col("stated_edges").isNotNull() & (F.size("edges") != F.col("stated_edges"))).select("instance_id", F.size("edges").alias("edges"), "stated_edges")


def edge_table(read: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, u, v) rows of a column ``edges``."""
    return read.select(key, F.explode("edges").alias("e")).select(key, "e.u", "e.v")


# --- what a saved primer states, read loosely ------------------------------------------------------


def stated(text: Column, feature: str) -> Column:
    """Node -> value as a primer's sentences give it; ``rwse`` gives the two values as an array."""
    number = {"degree": "([0-9]+)", "clustering": r"([0-9]+\.[0-9]+)"}
    if feature == "rwse":
        rx = r"Node ([0-9]+) has (?:[^.]*?, and )?return probability ([0-9]+\.[0-9]+) after 2 steps and ([0-9]+\.[0-9]+) after 3 steps"
        value = lambda s: F.array(F.regexp_extract(s, rx, 2).cast("double"), F.regexp_extract(s, rx, 3).cast("double"))
        rx = r"Node ([0-9]+) has (?:degree [0-9]+, )?(?:clustering coefficient [0-9.]+, )?(?:and )?return probability ([0-9]+\.[0-9]+) after 2 steps and ([0-9]+\.[0-9]+) after 3 steps"
    else:
        name = {"degree": "degree ", "clustering": "(?:degree [0-9]+,? )?(?:and )?clustering coefficient "}[feature]
        rx = f"Node ([0-9]+) has {name}{number[feature]}"
        kind = "int" if feature == "degree" else "double"
        value = lambda s: F.regexp_extract(s, rx, 2).cast(kind)
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    pairs = F.transform(found, lambda s: F.struct(F.regexp_extract(s, rx, 1).cast("int").alias("k"), value(s).alias("v")))
    return _last_of_each(pairs, "k", "v")


def nodes_listed(text: Column) -> Column:
    """How many nodes have a line of their own."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit("Node ([0-9]+) is connected to"), F.lit(1))))


def clustering_spread(text: Column) -> Column:
    """The population deviation of the clustering values that a prompt prints."""
    x = F.map_values(stated(text, "clustering"))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    return F.when(n > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / n))


def reworded(question: Column) -> Column:
    """The published question on an edge, asked without ``connected``; any other wording raises."""
    new = F.regexp_replace(question, PUBLISHED_QUESTION, "Q: Does an edge exist between Node $1 and Node $2?\nA: ")
    return F.when(question.rlike(PUBLISHED_QUESTION), new).otherwise(F.raise_error(F.concat(F.lit("unexpected wording: "), question)))


# --- corpora -------------------------------------------------------------------------------------


def build_corpus(edges: DataFrame, nodes: DataFrame, names: Sequence[str], conditions: Sequence[str], style: str = "zero_shot", prefix: Column | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Prompt rows of every graph, task and condition; one question a graph and task for all conditions.

    Graphs of fewer nodes than a task asks about have no row of it. ``prefix`` is what stands in
    instance_id between the task and the graph, ``asked`` the queried nodes (graph_id, a, b), else drawn.
    """
    asked = asked if asked is not None else tasks.targets(nodes)
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("nodes"))
    counts = edges.groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("edges"))
    texts = encode.encode(edges, nodes)
    primers = None
    for c in conditions:
        one = nodes.select("graph_id").distinct().select("graph_id", F.lit("").alias("primer")) if c == "none" else primer.render(edges, nodes, c)
        one = one.select("graph_id", F.lit(c).alias("condition"), "primer")
        primers = one if primers is None else primers.unionByName(one)
    rows = None
    for task in names:
        gold = tasks.gold(task, edges, nodes, asked).select("graph_id", F.lit(task).alias("task"), "a", "b", "gold")
        gold = gold.withColumn("question", tasks.question(task)).where({0: "true", 1: "a is not null", 2: "b is not null"}[tasks.ARITY.get(task, 0)])
        rows = gold if rows is None else rows.unionByName(gold)
    middle = prefix if prefix is not None else F.lit("graph")
    out = rows.join(texts, "graph_id").join(primers, "graph_id").join(sizes, "graph_id").join(counts, "graph_id", "left")
    return out.select(
        F.concat_ws("/", "task", middle, F.col("graph_id").cast("string")).alias("instance_id"), "task", "condition", F.lit(style).alias("style"),
        primer.build_prompt(F.coalesce("primer", F.lit("")), F.col("text"), F.col("question")).alias("prompt"), "gold", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"),
    )


def largest_graphs(nodes: DataFrame, k: int) -> DataFrame:
    """The ids of the k graphs with the most nodes, ties to the smaller id."""
    return nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "graph_id").limit(k).select("graph_id")


def stratified_graphs(keys: DataFrame, stratum: str, k: int) -> DataFrame:
    """The k first graphs of each stratum by id."""
    order = Window.partitionBy(stratum).orderBy("graph_id")
    return keys.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


#: The degrees that statements of each magnitude draw from.
BANDS = {"small": (1, 9), "large": (20, 39)}


def retrieval_probe(spark: SparkSession, statements: Sequence[int], positions: Sequence[float], count: int, seed: int = 0) -> DataFrame:
    """Prompts of k degree sentences with a question about the node at a position, without a graph.

    Degrees come from integer arithmetic on (k, position, magnitude, index, node) within the band of
    the magnitude, so that no value stands out by its size; any engine makes the same ones.
    """
    cells = [(k, float(p), m, *BANDS[m]) for k in statements for p in positions for m in BANDS]
    rows = spark.createDataFrame(cells, "statements int, position double, magnitude string, low int, high int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("idx"))
    k = F.col("statements")
    base = F.lit(seed).cast("long") + 100003 * k + 97 * F.round(1000 * F.col("position")).cast("long") + F.when(F.col("magnitude") == "small", 0).otherwise(7919) + F.col("idx")
    draw = lambda i: (F.col("low") + F.pmod(F.pmod(base, F.lit(1000003)) * 7919 + i.cast("long") * 104729 + i.cast("long") * i.cast("long") * 31, F.lit(1009)) % (F.col("high") - F.col("low") + 1)).cast("int")
    degrees = F.transform(F.sequence(F.lit(0), k - 1), draw)
    target = F.least(k - 1, F.greatest(F.lit(0), F.bround(F.col("position") * (k - 1)).cast("int")))
    rows = rows.withColumn("degrees", degrees).withColumn("target", target)
    sentence = lambda d, i: F.concat(F.lit("Node "), i.cast("string"), F.lit(" has degree "), d.cast("string"), F.lit("."))
    text = F.concat(F.array_join(F.transform("degrees", sentence), " "), F.lit("\n\nQ: What is the degree of node "), F.col("target").cast("string"), F.lit("?\nA: "))
    place = F.format_string("retrieval/k%d/pos%s/%s/%d", "statements", F.regexp_replace(F.col("position").cast("string"), r"\.0$", ""), F.col("magnitude"), F.col("idx"))
    return rows.select(
        place.alias("instance_id"), F.lit("node_degree").alias("task"), F.lit("retrieval").alias("condition"), F.lit("zero_shot").alias("style"), text.alias("prompt"),
        F.expr("degrees[target]").cast("string").alias("gold"), "statements", "position", "magnitude",
    )
