"""Features of nodes, pairs and graphs for analysis and for models: informativeness, covariates, tensors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions.fmt import two_decimals
from graphspark.operators import structure, tasks


def covariates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, z, c, pos): degree against a random graph's, clustering less the graph's mean, the id."""
    w = Window.partitionBy("graph_id")
    rows = structure.clustering(edges, nodes).withColumns({"n": F.count(F.lit(1)).over(w), "s": F.sum("degree").over(w), "mc": F.avg("clustering").over(w)})
    others = F.col("n") - 1
    p = F.col("s") / (F.col("n") * others)
    sd = F.sqrt(others * p * (1 - p))
    return rows.select("graph_id", "node", F.when(sd > 0, (F.col("degree") - p * others) / sd).alias("z"), (F.col("clustering") - F.col("mc")).alias("c"), F.col("node").alias("pos"))


def printed_values(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, degree, clustering, rwse2, rwse3) as a primer prints them: strings of two decimals."""
    stats = structure.statistics_by_graph(edges, nodes)
    return stats.select("graph_id", "node", F.col("degree").cast("string").alias("degree"), *(two_decimals(F.col(c)).alias(c) for c in ("clustering", "rwse2", "rwse3")))


def informativeness(values: DataFrame, by: list[str]) -> DataFrame:
    """(graph_id, share, gain): how far printed values pin a node's degree.

    The share of nodes with the commonest degree among those that print the same, and what that adds
    to guessing the graph's commonest degree: 0 for nothing, 1 for every degree.
    """
    kinds = values.groupBy("graph_id", *by, "degree").agg(F.count(F.lit(1)).alias("k"))
    best = kinds.groupBy("graph_id", *by).agg(F.max("k").alias("k")).groupBy("graph_id").agg(F.sum("k").alias("hit"))
    base = values.groupBy("graph_id", "degree").agg(F.count(F.lit(1)).alias("k")).groupBy("graph_id").agg(F.max("k").alias("mode"), F.sum("k").alias("n"))
    share, floor = F.col("hit") / F.col("n"), F.col("mode") / F.col("n")
    return best.join(base, "graph_id").select("graph_id", share.alias("share"), F.when(floor < 1, (share - floor) / (1 - floor)).otherwise(0.0).alias("gain"))


def degree_terciles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, tercile): thirds of the average rank of a node's degree in its graph."""
    d = structure.degrees(edges, nodes)
    w = Window.partitionBy("graph_id")
    rank = (structure.average_rank(F.col("degree"), w) - 0.5) / F.count(F.lit(1)).over(w)
    return d.select("graph_id", "node", F.least(F.lit(2), F.floor(rank * 3)).cast("int").alias("tercile"))


def pair_features(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, a, b, degree_sum, clustering, rwse2) of pairs: sums and means of what is printed."""
    side = lambda s: values.select("graph_id", F.col("node").alias(s), *(F.col(c).cast("double").alias(f"{c}_{s}") for c in ("degree", "clustering", "rwse2")))
    both = pairs.join(side("a"), ["graph_id", "a"]).join(side("b"), ["graph_id", "b"])
    mean = lambda c: ((F.col(f"{c}_a") + F.col(f"{c}_b")) / 2).alias(c)
    return both.select("graph_id", "a", "b", (F.col("degree_a") + F.col("degree_b")).cast("int").alias("degree_sum"), mean("clustering"), mean("rwse2"))


def resampled_rate(nodes: DataFrame, task: str, hit: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(rate, sd): mean and deviation over draws of the share of graphs whose queried nodes are hits.

    ``hit`` is (graph_id, a) or (graph_id, a, b) rows that count; targets are drawn anew each time, in
    a seeded order of a graph's nodes, and only counts come together.
    """
    keys = [k for k in ("a", "b") if k in hit.columns]
    gathered = nodes.groupBy("graph_id").agg(F.collect_list("node").alias("ns"))
    drawn = gathered.select("graph_id", "ns", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    order = F.sort_array(F.transform("ns", lambda n: F.struct(F.xxhash64(F.lit(seed), "graph_id", "draw", n).alias("h"), n.alias("n"))))
    asked = drawn.select("graph_id", "draw", order.alias("o")).select("graph_id", "draw", F.get("o", F.lit(0))["n"].alias("a"), F.get("o", F.lit(1))["n"].alias("b"))
    marked = asked.join(hit.select("graph_id", *keys).distinct().withColumn("hit", F.lit(1)), ["graph_id", *keys], "left")
    if tasks.ARITY.get(task, 0) == 2:
        marked = marked.where("b is not null")
    rates = marked.groupBy("draw").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return rates.agg(F.avg("r").alias("rate"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(pooled, mean, fisher, graphs): a correlation over all nodes, the mean of graphs' own, and by Fisher's z."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    per = rows.groupBy("graph_id").agg(r.alias("r")).where("r is not null")
    clipped = F.least(F.greatest(F.col("r"), F.lit(-0.999999)), F.lit(0.999999))
    each = per.agg(F.avg("r").alias("mean"), F.tanh(F.avg(F.atanh(clipped))).alias("fisher"), F.count(F.lit(1)).alias("graphs"))
    return rows.agg(r.alias("pooled")).crossJoin(each)


def laplacian_positions(edges: DataFrame, nodes: DataFrame, units: int = 4) -> DataFrame:
    """(graph_id, node, lpe): the first left singular vectors of the normalised Laplacian, padded with zeros.

    A vector's sign is arbitrary; it is turned so that its largest entry is positive.
    """

    def run(graph: int, ns: np.ndarray, es: np.ndarray) -> list[tuple]:
        at = {int(x): i for i, x in enumerate(sorted(ns.tolist()))}
        a = np.zeros((len(at), len(at)))
        for u, v in es.tolist():
            a[at[u], at[v]] = a[at[v], at[u]] = 1
        d = a.sum(1)
        scale = np.divide(1, np.sqrt(d), out=np.zeros(len(d)), where=d > 0)
        laplacian = np.diag((d > 0).astype(float)) - scale[:, None] * a * scale[None, :]
        u, _, _ = np.linalg.svd(laplacian)
        u = u[:, :units] * np.where(np.take_along_axis(u, np.abs(u).argmax(0)[None, :], 0)[0, :units] < 0, -1, 1)
        u = np.pad(u, ((0, 0), (0, max(0, units - u.shape[1]))))
        return [(graph, n, u[i].astype(np.float32).tolist()) for n, i in at.items()]

    return structure.per_graph(edges, nodes, run, "graph_id long, node int, lpe array<float>")


def tensors(edges: DataFrame, nodes: DataFrame, asked: DataFrame | None = None, units: int = 4) -> DataFrame:
    """(graph_id, nodes, lpe, source, target, weights, readout): a graph as arrays, both directions of each edge.

    Weights are null unless every edge has one. ``asked`` (graph_id, a, b) gives the readout: the
    queried nodes with their role, node for one, source and target for two.
    """
    lists = laplacian_positions(edges, nodes, units).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node", "lpe"))).alias("ns"))
    weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("int")
    ends = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", weight.alias("w")))).alias("es"))
    rows = lists.join(ends, "graph_id", "left").withColumn("es", F.coalesce("es", F.array().cast("array<struct<u:int,v:int,w:int>>")))
    column = lambda c: F.transform("es", lambda e: e[c])
    weights = F.when((F.size("es") > 0) & F.forall("es", lambda e: e["w"].isNotNull()), F.concat(column("w"), column("w")))
    out = rows.select(
        "graph_id", F.transform("ns", lambda n: n["node"]).alias("nodes"), F.transform("ns", lambda n: n["lpe"]).alias("lpe"), F.concat(column("u"), column("v")).alias("source"),
        F.concat(column("v"), column("u")).alias("target"), weights.alias("weights"),
    )
    if asked is None:
        return out.withColumn("readout", F.array().cast("array<struct<node:int,role:string>>"))
    role = lambda c, r: F.struct(F.col(c).alias("node"), F.lit(r).alias("role"))
    listed = F.when(F.col("b").isNotNull(), F.array(role("a", "source"), role("b", "target"))).when(F.col("a").isNotNull(), F.array(role("a", "node"))).otherwise(F.array().cast("array<struct<node:int,role:string>>"))
    return out.join(asked.select("graph_id", listed.alias("readout")), "graph_id", "left")


def padded_sizes(rows: DataFrame, slack: float = 1.0) -> DataFrame:
    """(nodes, edges): sizes that hold every graph of ``tensors`` with some room: 1 + largest + slack deviations."""
    size = lambda c: F.floor(1 + F.max(F.size(c)) + slack * F.stddev_pop(F.size(c))).cast("int")
    return rows.agg(size("nodes").alias("nodes"), size("source").alias("edges"))


def padded(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``tensors`` filled up to the sizes of ``padded_sizes``, real entries marked; padding edges join the last node."""
    s = F.broadcast(sizes.select(F.col("nodes").alias("_n"), F.col("edges").alias("_e")))
    fill = lambda c, to, value: F.concat(c, F.array_repeat(value, F.greatest(F.lit(0), to - F.size(c)).cast("int")))
    last = (F.col("_n") - 1).cast("int")
    return rows.crossJoin(s).select(
        "graph_id", fill("nodes", F.col("_n"), F.lit(-1)).alias("nodes"), fill("source", F.col("_e"), last).alias("source"), fill("target", F.col("_e"), last).alias("target"),
        fill(F.transform("nodes", lambda n: F.lit(1)), F.col("_n"), F.lit(0)).alias("node_mask"), fill(F.transform("source", lambda n: F.lit(1)), F.col("_e"), F.lit(0)).alias("edge_mask"),
    )


def named(nodes: DataFrame, scheme: str) -> DataFrame:
    """Nodes with their names under a scheme."""
    from graphspark.operators.encode import name_of

    return nodes.withColumn("name", name_of(F.col("node"), scheme))


# --- examples ------------------------------------------------------------------------------------

#: Fixed value: what asks for reasoning.
STEP_BY_STEP = "Let's think step by step. "


def examples(edges: DataFrame, nodes: DataFrame, task: str, encoders: list[str], algorithm: Column | None = None, cot: bool = False, seed: int = 0) -> DataFrame:
    """Zero-shot rows (graph_id, text_encoding, question, answer, nnodes, nedges, task_description, algorithm, node_ids)."""
    from graphspark.operators.encode import encode

    rows = tasks.task_rows(edges, nodes, (task,), seed)
    sizes = structure.node_count(nodes).join(structure.edge_count(edges, nodes), "graph_id")
    ids = F.filter(F.array("a", "b"), lambda x: x.isNotNull())
    ids = {0: F.array().cast("array<int>"), 1: F.slice(ids, 1, 1), 2: ids}[tasks.ARITY.get(task, 0)]
    out = None
    for name in encoders:
        text = encode(edges, nodes, name)
        one = rows.join(text, "graph_id").join(sizes, "graph_id").select(
            "graph_id", F.lit(name).alias("text_encoding"), F.concat("text", "question", F.lit(STEP_BY_STEP if cot else "")).alias("question"), F.concat("gold", F.lit(".")).alias("answer"),
            F.col("n_nodes").alias("nnodes"), F.col("n_edges").alias("nedges"), F.col("question").alias("task_description"), (algorithm if algorithm is not None else F.lit("er")).alias("algorithm"), ids.alias("node_ids"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def few_shot_examples(pool: DataFrame, rows: DataFrame, k: int = 2, balanced: bool = False, seed: int = 0) -> DataFrame:
    """``rows`` of ``examples`` with k examples of ``pool`` before each question, another order for every row.

    ``balanced`` takes all but one with a Yes and one without, as a yes-or-no task needs. The pool is
    reduced to a few of each kind by a seeded order before rows meet it, so it has a bounded size.
    """
    kind = F.col("answer").startswith("Yes") if balanced else F.lit(True)
    order = Window.partitionBy("text_encoding", "kind").orderBy(F.xxhash64(F.lit(seed), "graph_id"), "graph_id")
    text = F.concat(F.lit("Example: "), F.col("question"), F.col("answer"), F.lit("\n"))
    few = pool.withColumn("kind", kind).withColumn("r", F.row_number().over(order)).where(F.col("r") <= 8 * k)
    shots = few.groupBy("text_encoding").agg(F.collect_list(F.struct("kind", "graph_id", text.alias("t"))).alias("shots"))
    joined = rows.join(F.broadcast(shots), "text_encoding", "left")
    keyed = F.sort_array(F.transform(F.filter("shots", lambda s: s["graph_id"] != F.col("graph_id")), lambda s: F.struct(F.xxhash64(F.lit(seed), F.col("graph_id"), s["graph_id"]).alias("h"), s["kind"].alias("kind"), s["t"].alias("t"))))
    first = lambda xs, n: F.slice(xs, 1, n)
    if balanced:
        chosen = F.concat(first(F.filter(keyed, lambda s: s["kind"]), k - 1), first(F.filter(keyed, lambda s: ~s["kind"]), 1))
    else:
        chosen = first(keyed, k)
    return joined.withColumn("question", F.concat(F.array_join(F.transform(chosen, lambda s: s["t"]), ""), "question")).drop("shots")


def example_sets(edges: DataFrame, nodes: DataFrame, names: list[str], encoders: list[str], k: int = 2, seed: int = 0) -> DataFrame:
    """Zero-shot, step-by-step and few-shot rows of several tasks in one table, told apart by (task, style)."""
    out = None
    for task in names:
        zero = examples(edges, nodes, task, encoders, seed=seed)
        styles = {"zero_shot": zero, "zero_cot": examples(edges, nodes, task, encoders, cot=True, seed=seed), "few_shot": few_shot_examples(examples(edges, nodes, task, encoders, seed=seed + 1), zero, k, task == "cycle_check", seed)}
        for style, rows in styles.items():
            one = rows.select(F.lit(task).alias("task"), F.lit(style).alias("style"), *zero.columns)
            out = one if out is None else out.unionByName(one)
    return out


def task_accuracy(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, accuracy): the share of answers that open with the expected one, case aside."""
    hit = F.lower(F.trim("prediction")).startswith(F.lower(F.rtrim(F.trim("answer"), F.lit("."))))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("accuracy"))
