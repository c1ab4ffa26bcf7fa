"""Examples for teaching and training: a cycle spelled out, hobbies by block, token rows with a target mask, ladders of corpora."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.operators import encode, primer, prompts, tasks
from graphspark.operators.planning import RUNGS
from graphspark.operators.rewire import levels, rewired_pair
from graphspark.operators.structure import per_graph
from graphspark.sources.graphs import fixed_size_random
from graphspark.sources.shared import settled

#: Algorithms whose graphs have a cycle, and whose graphs have none; what a node can like.
WITH_CYCLE, WITHOUT_CYCLE = ("er", "ba", "sbm", "sfn", "complete"), ("star", "path")
HOBBIES = ("soccer", "baseball", "tennis", "golf", "football", "surfing")


# --- cycles --------------------------------------------------------------------------------------


def one_cycle(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, cycle array<int>): a simple cycle of each graph that has one, its first node not repeated.

    A walk that never turns back where it came from goes on until it meets itself; dead ends are taken
    off beforehand, so it cannot get stuck.
    """

    def run(graph: int, ns: np.ndarray, es: np.ndarray) -> list[tuple]:
        near: dict[int, set[int]] = {}
        for u, v in es.tolist():
            if u != v:
                near.setdefault(u, set()).add(v)
                near.setdefault(v, set()).add(u)
        ends = [x for x, ys in near.items() if len(ys) == 1]
        while ends:
            x = ends.pop()
            for y in near.pop(x, ()):
                near[y].discard(x)
                if len(near[y]) == 1:
                    ends.append(y)
        core = {x for x, ys in near.items() if len(ys) >= 2}
        if not core:
            return []
        walk, at = [min(core)], {min(core): 0}
        while True:
            here, came = walk[-1], walk[-2] if len(walk) > 1 else None
            step = min(y for y in near[here] if y in core and y != came)
            if step in at:
                return [(graph, walk[at[step] :])]
            at[step] = len(walk)
            walk.append(step)

    return per_graph(edges, nodes, run, "graph_id long, cycle array<int>")


def cycle_examples(edges: DataFrame, nodes: DataFrame, algorithm: DataFrame, encoder: str = "incident", cot: bool = False) -> DataFrame:
    """(graph_id, algorithm, question, answer, example) on cycles; with ``cot`` a positive answer names one.

    ``algorithm`` is (graph_id, algorithm).
    """
    texts = encode.encode(edges, nodes, encoder)
    rows = texts.join(algorithm, "graph_id").join(one_cycle(edges, nodes), "graph_id", "left")
    name = lambda x: x.cast("string")
    pair = lambda x, i: F.concat(name(x), F.lit(" is connected to "), name(F.get("cycle", (i + 1) % F.size("cycle"))))
    said = F.concat(F.lit(" The cycle is: "), F.array_join(F.transform("cycle", pair), ", "), F.lit("."))
    yes = F.concat(F.lit("Yes, there is a cycle."), said if cot else F.lit(""))
    answer = F.when(F.col("cycle").isNotNull(), yes).otherwise("No, there is no cycle.")
    question = F.concat("text", F.lit(tasks.QUESTIONS["cycle_check"]))
    return rows.select("graph_id", "algorithm", question.alias("question"), answer.alias("answer"), F.concat(question, answer).alias("example"))


def cycle_shots(pool: DataFrame, rows: DataFrame, k: int = 2, seed: int = 0, kept: int = 8) -> DataFrame:
    """``rows`` (graph_id, ...) with ``shots``: k - 1 examples of graphs that have cycles, then one of a graph that has none.

    Each place draws an algorithm first and then one of its examples, both by hashes of the row and the
    place, so that rows draw apart and again alike. Of each algorithm the pool keeps ``kept`` examples, so
    what every row meets has a bounded size. An algorithm without examples is not drawn.
    """
    order = Window.partitionBy("algorithm").orderBy(F.xxhash64(F.lit(seed), "graph_id"), "graph_id")
    few = pool.where(F.col("algorithm").isin(*WITH_CYCLE, *WITHOUT_CYCLE)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= kept)
    lists = few.groupBy("algorithm").agg(F.array_sort(F.collect_list(F.struct("_r", "example"))).alias("l"))
    families = lists.agg(*(F.array_sort(F.collect_list(F.when(F.col("algorithm").isin(*family), F.struct("algorithm", "l")))).alias(name) for name, family in (("_with", WITH_CYCLE), ("_without", WITHOUT_CYCLE))))
    pick = lambda items, place, what: F.get(items, F.pmod(F.xxhash64(F.lit(seed), F.col("graph_id"), place, F.lit(what)), F.greatest(F.size(items), F.lit(1))).cast("int"))
    shot = lambda family, place: F.concat(F.lit("Example: "), pick(pick(F.col(family), place, "algorithm")["l"], place, "example")["example"], F.lit("\n"))
    places = F.sequence(F.lit(1), F.lit(k - 1)) if k > 1 else F.array().cast("array<int>")
    shots = F.concat(F.array_join(F.transform(places, lambda i: shot("_with", i)), ""), F.coalesce(shot("_without", F.lit(0)), F.lit("")))
    return rows.crossJoin(F.broadcast(families)).withColumn("shots", shots).drop("_with", "_without")


# --- node classification -------------------------------------------------------------------------


def hobby_rows(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(graph_id, asked, first, second, answer, told array of (node, hobby), statement, question).

    ``nodes`` has a block, 0 or 1. Of n nodes, n // 2 + 1 are drawn in a seeded order; what all but the
    last like is told, and the last is asked about. Two hobbies a graph, one for each block.
    """
    g = F.col("graph_id")
    order = F.pmod(7919 * F.col("node") + 104729 * g + seed, F.lit(1009))
    w = Window.partitionBy("graph_id")
    n = F.count(F.lit(1)).over(w)
    drawn = nodes.withColumn("_r", F.row_number().over(w.orderBy(order, "node"))).withColumn("_last", (F.floor(n / 2) + 1).cast("int")).where("_r <= _last")
    one = F.pmod(g, F.lit(len(HOBBIES))).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.floor(g / len(HOBBIES)), F.lit(len(HOBBIES) - 1)), F.lit(len(HOBBIES))).cast("int")
    names = F.array(*map(F.lit, HOBBIES))
    liked = F.when(F.col("block") == 0, F.get(names, one)).otherwise(F.get(names, two))
    last = F.col("_r") == F.col("_last")
    out = drawn.withColumn("_hobby", liked).groupBy("graph_id").agg(
        F.max(F.when(last, F.col("node"))).alias("asked"), F.max(F.when(last, F.col("_hobby"))).alias("answer"),
        F.array_sort(F.collect_list(F.when(~last, F.struct("_r", "node", F.col("_hobby").alias("hobby"))))).alias("told"),
    )
    line = lambda x: F.concat(F.lit("Node "), x["node"].cast("string"), F.lit(" likes "), x["hobby"], F.lit(".\n"))
    first, second = F.get(names, one), F.get(names, two)
    question = F.concat(F.lit("Q: Does node "), F.col("asked").cast("string"), F.lit(" like "), first, F.lit(" or "), second, F.lit("?\nA: "))
    return out.select("graph_id", "asked", first.alias("first"), second.alias("second"), "answer", F.transform("told", lambda x: F.struct(x["node"].alias("node"), x["hobby"].alias("hobby"))).alias("told"), F.array_join(F.transform("told", line), "").alias("statement"), question.alias("question"))


# --- training rows -------------------------------------------------------------------------------

#: What stands for the graph's own token before a question.
PLACEHOLDER = "<ctrl99>"


def tokenised(examples: DataFrame, tokenize: Callable[[list[str]], list[list[int]]] | Callable[[Column], Column], max_tokens: int, bos: int = 1, eos: int = 2, pad: int = 0, on_columns: bool = False) -> DataFrame:
    """``examples`` (question, answer, ...) with ``input_tokens``, ``target_mask`` and ``overflow``.

    The query is the question from its ``Q:`` on behind a placeholder. Ids are bos, the query's, the
    answer's and eos, padded to ``max_tokens``; the mask is 1 from the answer on. A row that is too long is
    cut and marked. ``tokenize`` maps a batch of texts to ids in an Arrow function, or with ``on_columns``
    a column of texts to a column of ids.
    """
    if on_columns:
        ids = tokenize
    else:

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def ids(texts: pd.Series) -> pd.Series:
            return pd.Series(tokenize([t or "" for t in texts]), dtype=object)

    start = F.greatest(F.instr("question", "Q:"), F.lit(1))
    query = F.concat(F.lit(PLACEHOLDER), F.substr(F.col("question"), start))
    rows = examples.withColumns({"_q": ids(query), "_a": ids(F.col("answer"))})
    whole = F.concat(F.array(F.lit(bos)), F.col("_q"), F.col("_a"), F.array(F.lit(eos)))
    ahead = F.size("_q") + 1
    padded = F.slice(F.concat(whole, F.array_repeat(F.lit(pad), max_tokens)), 1, max_tokens)
    mask = F.transform(F.sequence(F.lit(0), F.lit(max_tokens - 1)), lambda i: ((i >= ahead) & (i < F.size(whole))).cast("int"))
    return rows.select(*examples.columns, padded.alias("input_tokens"), mask.alias("target_mask"), (F.size(whole) > max_tokens).alias("overflow"))


def question_ids(row_tokens: Column, mask: Column) -> Column:
    """The ids of a row's question: past bos and the placeholder's first id, up to the answer."""
    end = F.array_position(mask, 1)
    return F.when(end > 2, F.slice(row_tokens, 3, F.greatest(end.cast("int") - 3, F.lit(0))))


# --- ladders and rewired corpora -----------------------------------------------------------------


def rung_tag(n: Column, degree: Column) -> Column:
    return F.concat(F.lit("n"), n.cast("string"), F.lit("k"), degree.cast("string"))


def levelled_corpus(edges: DataFrame, nodes: DataFrame, rung: DataFrame | Column, task: str, conditions: Sequence[str], rewired: bool = True, times: int = 3, seed: int = 0) -> DataFrame:
    """Prompt rows (instance_id ``task/rung/level/graph``, ...) of base graphs, and of each rewired low and high.

    ``rung`` is (graph_id, rung), or a column over ``nodes``, the number of a graph's nodes. A graph's question
    is drawn once and asked at every level and under every condition, so that all are paired. Graphs of a level
    are numbered apart while prompts are built. Questions on degrees under conditions that state no more than
    degrees and clustering are built where graphs are rewired, without a join.
    """
    stated = {part for c in conditions for part in primer.CONDITIONS[c]}
    if rewired and task == "node_degree" and stated <= {"degree", "clustering"}:
        named = _degree_corpus(edges, nodes, conditions, times, seed)
    else:
        named = _joined_corpus(edges, nodes, task, conditions, rewired, times, seed)
    named = named.withColumn("rung", rung) if isinstance(rung, Column) else named.join(rung, "graph_id")
    return named.withColumn("instance_id", F.concat_ws("/", F.lit(task), "rung", "level", F.col("graph_id").cast("string")))


def _degree_corpus(edges: DataFrame, nodes: DataFrame, conditions: Sequence[str], times: int, seed: int) -> DataFrame:
    """What ``_joined_corpus`` gives for questions on degrees, each prompt from the one row that the rewiring pass has of its graph and level."""
    rows = levels(edges, nodes, [("low", False, seed), ("high", True, seed + 1)], times)
    rows = rows.select("graph_id", "level", "edges", F.col("near").alias("all"), F.filter("near", lambda x: F.size(x["nbrs"]) > 0).alias("near"), F.transform("near", lambda x: x["node"]).alias("ns"))
    rows = rows.withColumns({"a": tasks.target_order(F.col("ns"), seed)[0]["n"], "b": F.lit(None), "es": F.col("near"), "text": encode.incident()})
    said = F.array(*(F.struct(F.lit(c).alias("condition"), primer.rendered(F.col("all"), c).alias("primer")) for c in conditions))
    gold = F.filter("all", lambda x: x["node"] == F.col("a"))[0]["degree"].cast("string")
    rows = rows.select("graph_id", "level", "edges", "text", tasks.question("node_degree").alias("question"), gold.alias("gold"), F.size("ns").alias("nodes"), F.inline(said))
    prompt = primer.build_prompt(F.col("primer"), F.col("text"), F.col("question"))
    return rows.select("graph_id", F.lit("node_degree").alias("task"), "condition", F.lit("zero_shot").alias("style"), prompt.alias("prompt"), "gold", "nodes", "edges", "level")


def _joined_corpus(edges: DataFrame, nodes: DataFrame, task: str, conditions: Sequence[str], rewired: bool, times: int, seed: int) -> DataFrame:
    tables = {"base": edges}
    if rewired:
        pair = settled(rewired_pair(edges, nodes, times, seed))
        tables |= {lv: pair.where(F.col("level") == lv).drop("level") for lv in ("low", "high")}
    asked = tasks.targets(nodes, seed)
    out = None
    for level, es in tables.items():
        rows = prompts.build_corpus(es, nodes, [task], conditions, prefix=F.lit(level), asked=asked)
        rows = rows.withColumn("graph_id", F.element_at(F.split("instance_id", "/"), -1).cast("long")).withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


def ladder(spark: SparkSession, count: int, rungs: Sequence[str] = (), seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, rung): ``count`` uniform graphs of each rung's size and mean degree; no rungs means all.

    An unknown rung raises, so that a misspelt one does not shrink a study. Graph ids count up within a rung.
    """
    table = {f"n{n}k{k}": (n, k) for n, k, _ in RUNGS}
    if unknown := sorted(set(rungs) - set(table)):
        raise ValueError(f"unknown rungs {unknown}")
    edges = nodes = named = None
    for i, (tag, (n, k)) in enumerate(table.items()):
        if rungs and tag not in rungs:
            continue
        keys = spark.range(count).select((F.lit(i * 1_000_000_000) + F.lit(seed) + F.col("id")).alias("graph_id"))
        parts = (fixed_size_random(n, round(k * n / 2), keys), keys.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("node")), keys.withColumn("rung", F.lit(tag)))
        edges, nodes, named = parts if edges is None else (a.unionByName(b) for a, b in zip((edges, nodes, named), parts))
    return edges, nodes, named
