"""Questions about graphs with their gold answers: (graph_id, task, targets, question, gold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.operators import structure as st

#: Question texts; {a} and {b} are the targets.
QUESTIONS = {
    "node_count": "Q: How many nodes are in this graph?\nA: ",
    "edge_count": "Q: How many edges are in this graph?\nA: ",
    "cycle_check": "Q: Is there a cycle in this graph?\nA: ",
    "node_degree": "Q: What is the degree of node {a}?\nA: ",
    "connected_nodes": "Q: List all the nodes connected to {a} in alphabetical order.\nA: ",
    "edge_existence": "Q: Does an edge exist between Node {a} and Node {b}?\nA: ",
    "reachability": "Q: Is there a path from node {a} to node {b}?\nA: ",
    "disconnected_nodes": "Q: List all the nodes that are not connected to {a} in alphabetical order.\nA: ",
    "shortest_path": "Q: What is the length of the shortest path from node {a} to node {b}?\nA: ",
    "triangle_counting": "Q: How many triangles are in this graph?\nA: ",
    "maximum_flow": "Q: What is the maximum capacity of the flow from node {a} to node {b}?\nA: ",
}
ARITY = {"node_degree": 1, "connected_nodes": 1, "disconnected_nodes": 1, "edge_existence": 2, "reachability": 2, "shortest_path": 2, "maximum_flow": 2}


def targets(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(graph_id, a, b): two different nodes of each graph in a seeded order; b is null for one node."""
    gathered = nodes.groupBy("graph_id").agg(F.collect_list("node").alias("ns"))
    return gathered.select("graph_id", target_order(F.col("ns"), seed).alias("o")).select("graph_id", F.col("o")[0]["n"].alias("a"), F.try_element_at("o", F.lit(2))["n"].alias("b"))


def target_order(ns: Column, seed: int = 0) -> Column:
    """The nodes of an array as structs (h, n) in the seeded order in which they are asked about."""
    return F.sort_array(F.transform(ns, lambda n: F.struct(F.pmod(7919 * n + 104729 * F.col("graph_id") + seed, F.lit(1009)).alias("h"), n.alias("n"))))


def question(task: str):
    text = F.lit(QUESTIONS[task])
    return F.replace(F.replace(text, F.lit("{a}"), F.coalesce(F.col("a").cast("string"), F.lit(""))), F.lit("{b}"), F.coalesce(F.col("b").cast("string"), F.lit("")))


def gold(task: str, edges: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(graph_id, a, b, gold) of a task for targets (graph_id, a, b)."""
    yes_no = lambda c: F.when(c, "Yes").otherwise("No")
    if task == "node_count":
        return asked.join(st.node_count(nodes), "graph_id").withColumn("gold", F.col("n_nodes").cast("string"))
    if task == "edge_count":
        return asked.join(st.edge_count(edges, nodes), "graph_id").withColumn("gold", F.col("n_edges").cast("string"))
    if task == "triangle_counting":
        return asked.join(st.triangle_count(edges, nodes), "graph_id").withColumn("gold", F.col("n_triangles").cast("string"))
    if task == "cycle_check":
        counts = st.node_count(nodes).join(st.edge_count(edges, nodes), "graph_id").join(st.component_count(edges, nodes), "graph_id")
        cyclic = F.col("n_edges") - F.col("n_nodes") + F.col("n_components") > 0
        said = F.when(cyclic, "Yes, there is a cycle").otherwise("No, there is no cycle")
        return asked.join(counts.select("graph_id", said.alias("gold")), "graph_id")
    if task == "node_degree":
        d = st.degrees(edges, nodes).select("graph_id", F.col("node").alias("a"), F.col("degree").cast("string").alias("gold"))
        return asked.join(d, ["graph_id", "a"])
    if task == "connected_nodes":
        near = st.neighbours(edges).select("graph_id", F.col("node").alias("a"), F.array_join(F.transform("nbrs", lambda n: n.cast("string")), ", ").alias("g"))
        return asked.join(near, ["graph_id", "a"], "left").withColumn("gold", F.coalesce("g", F.lit("No nodes"))).drop("g")
    if task == "disconnected_nodes":
        listed = st.disconnected_nodes(edges, nodes, asked.select("graph_id", F.col("a").alias("node")))
        return asked.join(listed.select("graph_id", F.col("node").alias("a"), F.col("answer").alias("gold")), ["graph_id", "a"])
    two = asked.where("b is not null")
    if task == "edge_existence":
        e = edges.select("graph_id", "u", "v", F.lit(True).alias("hit"))
        keyed = two.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
        return keyed.join(e, ["graph_id", "u", "v"], "left").withColumn("gold", yes_no(F.col("hit").isNotNull())).drop("u", "v", "hit")
    if task == "reachability":
        labels = st.component_labels(edges, nodes)
        la = labels.select("graph_id", F.col("node").alias("a"), F.col("component").alias("ca"))
        lb = labels.select("graph_id", F.col("node").alias("b"), F.col("component").alias("cb"))
        return two.join(la, ["graph_id", "a"]).join(lb, ["graph_id", "b"]).withColumn("gold", yes_no(F.col("ca") == F.col("cb"))).drop("ca", "cb")
    if task == "shortest_path":
        keyed = two.withColumn("src", F.least("a", "b")).withColumn("dst", F.greatest("a", "b"))
        near = keyed.join(st.distances(edges, nodes), ["graph_id", "src", "dst"], "left")
        none = F.concat(F.lit("There is no path from node "), F.col("a").cast("string"), F.lit(" to node "), F.col("b").cast("string"))
        return near.withColumn("gold", F.coalesce(F.col("dist").cast("string"), none)).drop("src", "dst", "dist")
    if task == "maximum_flow":
        flows = st.max_flow(st.with_weights(edges), two.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst")))
        return two.join(flows.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("flow").cast("string").alias("gold")), ["graph_id", "a", "b"])
    raise ValueError(f"unknown task {task!r}")


def task_rows(edges: DataFrame, nodes: DataFrame, tasks: tuple[str, ...], seed: int = 0) -> DataFrame:
    """(graph_id, task, a, b, question, gold) for several tasks; graphs too small for a task are left out."""
    asked = targets(nodes, seed)
    out: DataFrame | None = None
    for task in tasks:
        rows = gold(task, edges, nodes, asked).select("graph_id", F.lit(task).alias("task"), "a", "b", question(task).alias("question"), "gold")
        out = rows if out is None else out.unionByName(rows)
    return out


def node_classification(nodes: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """(graph_id, node, block, label, shown): a class by block, shown for every other node."""
    label = F.when(F.col("block") == 0, labels[0]).otherwise(labels[1])
    return nodes.select("graph_id", "node", "block", label.alias("label"), (F.pmod("node", F.lit(2)) == 0).alias("shown"))


def few_shot(examples: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """(task, prefix): k examples a task in a seeded order, each opened by ``Example: ``."""
    order = Window.partitionBy("task").orderBy(F.xxhash64(F.lit(seed), "graph_id"), "graph_id")
    picked = examples.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    text = F.concat(F.lit("Example: "), F.col("question"), F.col("gold"), F.lit(".\n"))
    listed = picked.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("n", text.alias("t")))).alias("ts"))
    return listed.select("task", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("prefix"))
