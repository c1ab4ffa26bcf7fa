"""Where invented neighbours come from: what a graph offers around a node, and how often chance would hit it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.claims import walk_verdict
from graphspark.functions.probability import binomial_two_sided
from graphspark.operators import inference
from graphspark.operators.reports import change

_NONE = "array<int>"


def surroundings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, nbrs, beside, off, two, and the share of non-neighbours in each of the last three).

    ``beside`` are the neighbours of the ids next to a node's, ``off`` the ids next to its neighbours',
    ``two`` its neighbours' neighbours. Joins and aggregations by graph and node only.
    """
    arcs = edges.select("graph_id", F.col("u").alias("node"), F.col("v").alias("nbr")).unionByName(edges.select("graph_id", F.col("v").alias("node"), F.col("u").alias("nbr")))
    near = arcs.groupBy("graph_id", "node").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))
    whole = nodes.join(near, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("nbrs", F.array().cast(_NONE)).alias("nbrs"))
    graph = whole.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "nbrs"))).alias("m"))
    j = whole.join(graph, "graph_id")
    of = lambda x: F.coalesce(F.try_element_at("m", x), F.array().cast(_NONE))
    sets = j.withColumns(
        {
            "beside": F.array_union(of(F.col("node") - 1), of(F.col("node") + 1)),
            "off": F.array_distinct(F.flatten(F.transform("nbrs", lambda y: F.array(y - 1, y + 1)))),
            "two": F.array_distinct(F.flatten(F.transform("nbrs", of))),
            "rest": F.array_except(F.array_except(F.map_keys("m"), F.col("nbrs")), F.array("node")),
        }
    )
    share = lambda c: F.when(F.size("rest") > 0, F.size(F.array_intersect("rest", c)) / F.size("rest"))
    return sets.select("graph_id", "node", "nbrs", "beside", "off", "two", *(share(c).alias(f"{c}_chance") for c in ("beside", "off", "two")))


def invented_steps(rows: DataFrame, keys: Sequence[str], around: DataFrame) -> DataFrame:
    """(keys, closing, beside, off, beside_chance, off_chance): the steps of asserted invented walks that are no edges.

    ``rows`` has graph_id, ``walk`` and ``edges``. A step is ``closing`` if it is its walk's last.
    """
    step = lambda i: F.struct(F.get("walk", i).alias("x"), F.get("walk", i + 1).alias("y"), (i == F.size("walk") - 2).alias("closing"))
    steps = rows.select(*keys, "graph_id", "edges", F.explode(F.transform(F.sequence(F.lit(0), F.size("walk") - 2), step)).alias("s"))
    edge = F.struct(F.least("s.x", "s.y").alias("u"), F.greatest("s.x", "s.y").alias("v"))
    bad = steps.where(~F.array_contains("edges", edge)).select(*keys, "graph_id", F.col("s.x").alias("node"), F.col("s.y").alias("y"), F.col("s.closing").alias("closing"))
    j = bad.join(around, ["graph_id", "node"], "left")
    hit = lambda c: F.coalesce(F.array_contains(c, F.col("y")), F.lit(False)).alias(c)
    return j.select(*keys, "closing", hit("beside"), hit("off"), "beside_chance", "off_chance")


def invented_members(rows: DataFrame, keys: Sequence[str], around: DataFrame) -> DataFrame:
    """(keys, member, self, two, beside, off and their chances): the ids of answers that are no neighbours.

    ``rows`` has graph_id, the queried ``node`` and ``ids``.
    """
    j = rows.join(around, ["graph_id", "node"]).select("*", F.explode(F.array_except("ids", "nbrs")).alias("member"))
    hit = lambda c: F.array_contains(c, F.col("member")).alias(c)
    return j.select(*keys, "member", (F.col("member") == F.col("node")).alias("self"), *(hit(c) for c in ("two", "beside", "off")), *(f"{c}_chance" for c in ("two", "beside", "off")))


def missed_members(rows: DataFrame, keys: Sequence[str], around: DataFrame) -> DataFrame:
    """(keys, first, last, below, below_chance): the neighbours that answers leave out, by their place on the node's line."""
    j = rows.join(around, ["graph_id", "node"]).select("*", F.explode(F.array_except("nbrs", "ids")).alias("member"))
    below = F.size(F.filter("nbrs", lambda y: y < F.col("node"))) / F.size("nbrs")
    return j.select(*keys, (F.col("member") == F.array_min("nbrs")).alias("first"), (F.col("member") == F.array_max("nbrs")).alias("last"), (F.col("member") < F.col("node")).alias("below"), below.alias("below_chance"))


def walk_flags(found: Column, edges: Column) -> dict[str, Column]:
    """Of the cycles a text names: ``asserted`` an invented one, ``caught`` one (named and taken back), ``rejected_real``."""
    has = lambda verdict, rejected: F.exists(found, lambda c: (walk_verdict(c["walk"], edges) == verdict) & (c["rejected"] == rejected))
    return {"asserted": has("invented", False), "caught": has("invented", True), "rejected_real": has("real", True)}


def against_none(rows: DataFrame, keys: Sequence[str], measures: Sequence[str], family: Sequence[str] = ("measure", "arm")) -> DataFrame:
    """(measure, arm, condition, n, share_none, share, broke, fixed, p, q) of 0/1 measures, each primer against none on the same keys.

    The measures become rows, so that one self-join serves them all.
    """
    long = rows.select("arm", "condition", *keys, F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("x")) for m in measures))))
    j = inference.pairs(long, ["measure", "arm", *keys], "condition", "none", ["x"])
    out = j.groupBy("measure", "arm", "condition").agg(*change("x"), F.avg("x_a").alias("share_none"), F.avg("x_b").alias("share"))
    return inference.with_q(out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed"))), family=list(family)).drop("delta")


