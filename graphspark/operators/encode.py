"""Graphs as text: one row a graph, sorted nodes and edges, string expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspark.functions.fmt import join_phrases
from graphspark.functions.spans import let
from graphspark.operators.structure import neighbours

#: Node names by scheme, in the order of node ids.
NAMES = {
    "popular": (
        "James Robert John Michael David Mary Patricia Jennifer Linda Elizabeth William Richard Joseph Thomas "
        "Christopher Barbara Susan Jessica Sarah Karen Daniel Lisa Matthew Nancy Anthony Betty Mark Margaret Donald "
        "Sandra Steven Ashley Paul Kimberly Andrew Emily Joshua Donna Kenneth Michelle Kevin Carol Brian Amanda George "
        "Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Sharon Jeffrey Laura Ryan Cynthia Jacob Dorothy "
        "Gary Olivia Nicholas Emma Eric Sophia Jonathan Ava Stephen Isabella Scott Mia Justin Abigail Brandon Madison "
        "Frank Chloe Benjamin Victoria Samuel Lauren Gregory Hannah Alexander Grace Frank Alexis Raymond Alice Patrick "
        "Samantha Jack Natalie Dennis Anna Jerry Taylor Tyler Kayla Henry Hailey Douglas Jasmine Peter Nicole Adam Amy "
        "Nathan Christina Zachary Andrea Jose Leah Walter Angelina Harold Valerie Kyle Veronica Ethan Carl Arthur Roger "
        "Noah"
    ).split(),
    "south_park": (
        "Eric Kenny Kyle Stan Tolkien Heidi Bebe Liane Sharon Linda Gerald Veronica Michael Jimbo Herbert Malcolm "
        "Gary Steve Chris Wendy"
    ).split(),
    "got": (
        "Ned Cat Daenerys Jon Bran Sansa Arya Cersei Jaime Petyr Robert Jorah Viserys Joffrey Maester Theon Rodrik Lysa "
        "Stannis Osha"
    ).split(),
    "politician": (
        "Barack Jimmy Arnold Bernie Bill Kamala Hillary Elizabeth John Ben Joe Alexandria George Nancy Pete Madeleine "
        "Elijah Gabrielle Al"
    ).split(),
    "alphabet": [chr(65 + i) * n for n in (1, 2) for i in range(26)],
}


def name_of(node: Column, scheme: str = "integer") -> Column:
    """The name of a node id; an id past the end of its scheme raises."""
    if scheme in ("integer", "nx_node_name"):
        return node.cast("string")
    if scheme not in NAMES:
        raise ValueError(f"unknown naming {scheme!r}")
    names = F.array(*(F.lit(n) for n in NAMES[scheme]))
    missing = F.raise_error(F.concat(F.lit(f"no name in {scheme!r} for node "), node.cast("string")))
    return F.coalesce(F.try_element_at(names, (node + 1).cast("int")), F.when(node.isNotNull(), missing))


def graph_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, ns, es, near): sorted nodes, sorted edges, and (node, nbrs) of connected nodes."""
    ns = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_set("node")).alias("ns"))
    es = edges.groupBy("graph_id").agg(F.sort_array(F.collect_set(F.struct("u", "v"))).alias("es"))
    near = neighbours(edges).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node", "nbrs"))).alias("near"))
    return ns.join(es, "graph_id", "left").join(near, "graph_id", "left")


def _per_edge(text: Callable[[Column, Column], Column], scheme: str) -> Column:
    lines = F.transform(F.col("es"), lambda e: text(name_of(e["u"], scheme), name_of(e["v"], scheme)))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def _names(scheme: str) -> Column:
    return let(F.transform("ns", lambda n: name_of(n, scheme)), join_phrases)


def _if_edges(text: str) -> Column:
    return F.when(F.size("es") > 0, F.lit(text)).otherwise(F.lit(""))


def adjacency(scheme: str = "integer") -> Column:
    head = F.lit("In an undirected graph, (i,j) means that node i and node j are connected with an undirected edge. G describes a graph among nodes ")
    pairs = F.array_join(F.transform("es", lambda e: F.concat(F.lit("("), name_of(e["u"], scheme), F.lit(", "), name_of(e["v"], scheme), F.lit(")"))), " ")
    return F.concat(head, _names(scheme), F.lit(".\n"), _if_edges("The edges in G are: "), F.coalesce(pairs, F.lit("")), F.lit(".\n"))


def incident(scheme: str = "integer") -> Column:
    """One line a connected node; the line opens with the node's number, its neighbours are named."""
    def line(x: Column) -> Column:
        listed = F.array_join(F.transform(x["nbrs"], lambda n: name_of(n, scheme)), ", ")
        word = F.when(F.size(x["nbrs"]) > 1, "nodes").otherwise("node")
        return F.concat(F.lit("Node "), x["node"].cast("string"), F.lit(" is connected to "), word, F.lit(" "), listed, F.lit(".\n"))

    lines = F.coalesce(F.array_join(F.transform("near", line), ""), F.lit(""))
    return F.concat(F.lit("G describes a graph among nodes "), _names(scheme), F.lit(".\n"), _if_edges("In this graph:\n"), lines)


def _sentences(opening: str, intro: str, text: Callable[[Column, Column], Column], scheme: str, end: str = "") -> Column:
    return F.concat(F.lit(opening), _names(scheme), F.lit(".\n"), _if_edges(intro), _per_edge(text, scheme), F.lit(end))


def friendship(scheme: str = "popular") -> Column:
    say = lambda a, b: F.concat(a, F.lit(" and "), b, F.lit(" are friends.\n"))
    return _sentences("G describes a friendship graph among nodes ", "We have the following edges in G:\n", say, scheme)


def social_network(scheme: str = "popular") -> Column:
    say = lambda a, b: F.concat(a, F.lit(" and "), b, F.lit(" are connected.\n"))
    return _sentences("G describes a social network graph among nodes ", "We have the following edges in G:\n", say, scheme)


def coauthorship(scheme: str = "popular") -> Column:
    """Ends in one period; callers that need the doubled one of older texts append it."""
    say = lambda a, b: F.concat(a, F.lit(" and "), b, F.lit(" wrote a paper together.\n"))
    return _sentences("G describes a coauthorship graph among nodes ", "In this coauthorship graph:\n", say, scheme)


def expert(scheme: str = "alphabet") -> Column:
    say = lambda a, b: F.concat(a, F.lit(" -> "), b, F.lit("\n"))
    return _sentences("You are a graph analyst and you have been given a graph G among nodes ", "G has the following undirected edges:\n", say, scheme)


def triples(scheme: str = "integer", etype: str = "linked") -> Column:
    """(subject, predicate, object) of every edge."""
    parts = F.transform("es", lambda e: F.concat(F.lit("("), name_of(e["u"], scheme), F.lit(f", {etype}, "), name_of(e["v"], scheme), F.lit(")")))
    return F.concat(F.coalesce(F.array_join(parts, " "), F.lit("")), F.lit(".\n"))


#: Encoder names and the node names each one goes with. A caller may register a function of its own.
ENCODERS: dict[str, Callable[[], Column]] = {
    "adjacency": adjacency,
    "incident": incident,
    "friendship": friendship,
    "south_park": lambda: friendship("south_park"),
    "got": lambda: friendship("got"),
    "politician": lambda: social_network("politician"),
    "social_network": social_network,
    "expert": expert,
    "coauthorship": coauthorship,
    "triples": triples,
}


def encode(edges: DataFrame, nodes: DataFrame, encoder: str | Callable[[], Column] = "incident") -> DataFrame:
    """(graph_id, text) of every graph under a named encoder or a function that returns a column."""
    build = ENCODERS[encoder] if isinstance(encoder, str) else encoder
    return graph_rows(edges, nodes).select("graph_id", build().alias("text"))


def rename_nodes(text: Column, scheme: str) -> Column:
    """``Node 3`` and ``node 3`` with the node's name in place of the number."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(.*?)(?:\b([Nn]ode) ([0-9]+)\b|\z)"), F.lit(0))
    named = F.transform(
        parts,
        lambda p: F.when(
            p.rlike(r"(?s)\b[Nn]ode [0-9]+\z"),
            F.concat(F.regexp_extract(p, r"(?s)\A(.*\b[Nn]ode )[0-9]+\z", 1), name_of(F.regexp_extract(p, r"([0-9]+)\z", 1).try_cast("int"), scheme)),
        ).otherwise(p),
    )
    return F.array_join(named, "")


def unname_nodes(text: Column, scheme: str) -> Column:
    """Names back to numbers, the longest first, on word boundaries."""
    names = NAMES[scheme]
    for i in sorted(range(len(names)), key=lambda i: -len(names[i])):
        text = F.regexp_replace(text, rf"\b{names[i]}\b", str(i))
    return text
