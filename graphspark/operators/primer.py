"""Primers: statistics written out ahead of a graph, and read back strictly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.fmt import join_phrases, two_decimals
from graphspark.operators.structure import component_count, degrees, statistics_by_graph

#: The parts of each condition.
CONDITIONS: dict[str, tuple[str, ...]] = {
    "none": (),
    "components": ("components",),
    "degree": ("degree",),
    "clustering": ("clustering",),
    "rwse": ("rwse",),
    "all": ("degree", "clustering", "rwse"),
    "filler": ("filler",),
}

_NUMBER = r"([0-9]+(?:\.[0-9]{2}))"
#: One anchored pattern for every legal sentence; a sentence that fits none is an error.
SENTENCE = (
    r"^(?:This graph has (?:1 connected component|(?:0|[2-9]|[1-9][0-9]+) connected components)\."
    r"|Node [0-9]+ is simply present within the graph G\."
    r"|Node [0-9]+ has (?:DEGREE|CLUSTERING|RWSE|DEGREE and CLUSTERING|DEGREE and RWSE|CLUSTERING and RWSE|DEGREE, CLUSTERING, and RWSE)\.)$"
)
SENTENCE = (
    SENTENCE.replace("DEGREE", "degree [0-9]+")
    .replace("CLUSTERING", r"clustering coefficient [0-9]+\.[0-9]{2}")
    .replace("RWSE", r"return probability [0-9]+\.[0-9]{2} after [0-9]+ steps?(?:(?: and |, and |, )[0-9]+\.[0-9]{2} after [0-9]+ steps?)*")
)


def node_statistics(edges: DataFrame, nodes: DataFrame, k_max: int = 3) -> DataFrame:
    """(graph_id, node, degree, clustering, rwse2..): what primers are made of."""
    return statistics_by_graph(edges, nodes, k_max)


def degree_phrase(d: Column) -> Column:
    return F.concat(F.lit("degree "), d.cast("string"))


def clustering_phrase(c: Column, decimals: Callable[[Column], Column] = two_decimals) -> Column:
    return F.concat(F.lit("clustering coefficient "), decimals(c))


def rwse_phrase(values: dict[int, Column]) -> Column:
    steps = [F.concat(two_decimals(v), F.lit(f" after {k} step{'' if k == 1 else 's'}")) for k, v in sorted(values.items())]
    return F.concat(F.lit("return probability "), join_phrases(F.array(*steps)))


def components_sentence(n: Column) -> Column:
    return F.concat(F.lit("This graph has "), n.cast("string"), F.lit(" connected component"), F.when(n == 1, "").otherwise("s"), F.lit("."))


def _node_sentence(parts: tuple[str, ...], k_max: int, of: Callable[[str], Column] = F.col, decimals: Callable[[Column], Column] = two_decimals) -> Column:
    head = F.concat(F.lit("Node "), of("node").cast("string"))
    if parts == ("filler",):
        return F.concat(head, F.lit(" is simply present within the graph G."))
    made = {
        "degree": lambda: degree_phrase(of("degree")),
        "clustering": lambda: clustering_phrase(of("clustering"), decimals),
        "rwse": lambda: rwse_phrase({k: of(f"rwse{k}") for k in range(2, k_max + 1)}),
    }
    said = made[parts[0]]() if len(parts) == 1 else join_phrases(F.array(*(made[p]() for p in parts)))
    return F.concat(head, F.lit(" has "), said, F.lit("."))


def rendered(near: Column, condition: str) -> Column:
    """The primer of a graph whose nodes are an array of structs in order, of a condition that needs no more than their fields.

    ``clustering`` is the text with two decimals here.
    """
    parts = CONDITIONS[condition]
    return F.array_join(F.transform(near, lambda x: _node_sentence(parts, 3, lambda name: x[name], lambda c: c)), " ") if parts else F.lit("")


def render(edges: DataFrame, nodes: DataFrame, condition: str, k_max: int = 3) -> DataFrame:
    """(graph_id, primer) under a condition: the graph's sentence, then one a node in order."""
    parts = CONDITIONS[condition]
    graphs = nodes.select("graph_id").distinct()
    if not parts:
        return graphs.select("graph_id", F.lit("").alias("primer"))
    if parts == ("components",):
        return component_count(edges, nodes).select("graph_id", components_sentence(F.col("n_components")).alias("primer"))
    rows = nodes
    if parts != ("filler",):
        rows = degrees(edges, nodes) if parts == ("degree",) else statistics_by_graph(edges, nodes, k_max)
    said = rows.select("graph_id", F.struct("node", _node_sentence(parts, k_max).alias("s")).alias("x"))
    listed = said.groupBy("graph_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return listed.select("graph_id", F.array_join(F.transform("xs", lambda x: x["s"]), " ").alias("primer"))


def pad(primer: Column, ns: Column, target: int) -> Column:
    """The primer with filler sentences behind it, cycling over the nodes, until it has ``target`` chars."""
    filler = lambda n: F.concat(F.lit("Node "), n.cast("string"), F.lit(" is simply present within the graph G."))
    turns = F.sequence(F.lit(0), F.lit(max(0, target // 40)))
    added = F.aggregate(
        turns,
        primer,
        lambda text, i: F.when(
            F.length(text) < target,
            F.concat_ws(" ", F.when(F.length(text) > 0, text), filler(F.element_at(ns, (i % F.size(ns) + 1).cast("int")))),
        ).otherwise(text),
    )
    return F.when(F.size(ns) > 0, added).otherwise(primer)


def sentences(primer: Column) -> Column:
    return F.filter(F.split(primer, r"(?<=\.)\s+"), lambda s: s != "")


def parse(primers: DataFrame) -> DataFrame:
    """(…, components, degree, clustering, rwse, filler, ns) from a column ``primer``.

    degree and clustering are maps by node, rwse maps (node, k) strings to values, filler and ns are
    sorted node arrays. Sentences that fit no legal form raise, and so do two values of one node; a
    value said twice is one.
    """
    s = F.col("_s")
    rows = primers.withColumn("_s", sentences(F.col("primer")))
    bad = F.filter(s, lambda x: ~x.rlike(SENTENCE))
    rows = rows.withColumn("_s", F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("not a primer sentence: "), bad[0]))).otherwise(s))
    node = lambda x: F.regexp_extract(x, r"^Node ([0-9]+) ", 1).try_cast("int")

    def values(pattern: str, kind: str) -> Column:
        hits = F.filter(s, lambda x: x.rlike(pattern))
        return F.map_from_entries(F.array_distinct(F.transform(hits, lambda x: F.struct(node(x), F.regexp_extract(x, pattern, 1).cast(kind)))))

    walk = r"([0-9]+\.[0-9]{2}) after ([0-9]+) steps?"
    steps = F.flatten(
        F.transform(
            F.filter(s, lambda x: x.rlike("return probability")),
            lambda x: F.transform(
                F.arrays_zip(F.regexp_extract_all(x, F.lit(walk), F.lit(2)).alias("k"), F.regexp_extract_all(x, F.lit(walk), F.lit(1)).alias("p")),
                lambda z: F.struct(F.concat_ws(":", node(x).cast("string"), z["k"]), z["p"].cast("double")),
            ),
        )
    )
    stated = F.filter(s, lambda x: x.startswith("This graph has"))
    return rows.select(
        *primers.columns,
        F.when(F.size(stated) > 0, F.regexp_extract(stated[0], "([0-9]+)", 1).try_cast("int")).alias("components"),
        values("degree ([0-9]+)", "int").alias("degree"),
        values(r"clustering coefficient ([0-9]+\.[0-9]{2})", "double").alias("clustering"),
        F.map_from_entries(F.array_distinct(steps)).alias("rwse"),
        F.array_sort(F.array_distinct(F.transform(F.filter(s, lambda x: x.contains("simply present")), node))).alias("filler"),
        F.array_sort(F.array_distinct(F.transform(F.filter(s, lambda x: x.startswith("Node ")), node))).alias("ns"),
    )


def is_empty() -> Column:
    """Whether a parsed primer states nothing."""
    return F.col("components").isNull() & (F.size("ns") == 0)


def says_about(primer: Column, target: Column) -> Column:
    """The sentences about one node."""
    return F.array_join(F.filter(sentences(primer), lambda s: s.startswith(F.concat(F.lit("Node "), target.cast("string"), F.lit(" ")))), " ")


def build_prompt(primer: Column, encoding: Column, question: Column) -> Column:
    """Primer, blank line, encoding, question; no blank line for an empty primer."""
    return F.concat(F.when(primer != "", F.concat(primer, F.lit("\n\n"))).otherwise(F.lit("")), encoding, question)
