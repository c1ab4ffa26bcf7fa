"""Structural statistics of graph collections, as joins and aggregations keyed by graph.

Every function takes ``edges`` (graph_id, u, v), u < v and distinct, and where isolated nodes matter
``nodes`` (graph_id, node). Sums and counts are pre-aggregated; no graph is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph_id, node, nbr): every edge from either end. A self-loop comes once."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("nbr")), F.struct(F.col("v").alias("node"), F.col("u").alias("nbr")))
    return edges.select("graph_id", F.explode(F.array_distinct(ends)).alias("e")).select("graph_id", "e.node", "e.nbr")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, degree): one aggregation over nodes and edge ends; a self-loop counts twice."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node"), F.lit(1).alias("one"))
    return nodes.select("graph_id", "node", F.lit(0).alias("one")).union(ends).groupBy("graph_id", "node").agg(F.sum("one").cast("int").alias("degree"))


def node_count(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))


def edge_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, n_edges), 0 for a graph of nodes alone."""
    graphs = nodes.select("graph_id", F.lit(0).alias("one")).distinct()
    return graphs.union(edges.select("graph_id", F.lit(1))).groupBy("graph_id").agg(F.sum("one").cast("long").alias("n_edges"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(graph_id, node, nbrs): sorted neighbour arrays of the nodes that have any."""
    return both_ways(edges).groupBy("graph_id", "node").agg(F.sort_array(F.collect_set("nbr")).alias("nbrs"))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, a, b, c) with a < b < c: two edges from a node up, closed by the third."""
    e = edges.where("u < v")
    ab = e.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b"))
    ac = e.select("graph_id", F.col("u").alias("a"), F.col("v").alias("c"))
    bc = e.select("graph_id", F.col("u").alias("b"), F.col("v").alias("c"))
    return ab.join(ac, ["graph_id", "a"]).where("b < c").join(bc, ["graph_id", "b", "c"]).select("graph_id", "a", "b", "c")


def triangle_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    graphs = nodes.select("graph_id", F.lit(0).alias("one")).distinct()
    return graphs.union(triangles(edges).select("graph_id", F.lit(1))).groupBy("graph_id").agg(F.sum("one").cast("long").alias("n_triangles"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, degree, clustering): 2 T / (d (d - 1)), 0 below two neighbours."""
    through = triangles(edges).select("graph_id", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("t"))
    deg = degrees(edges, nodes)
    d = F.col("degree")
    value = F.when(d < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / (d * (d - 1)))
    return deg.join(through, ["graph_id", "node"], "left").select("graph_id", "node", "degree", value.alias("clustering"))


def return_probabilities(edges: DataFrame, nodes: DataFrame, steps: int = 3) -> DataFrame:
    """(graph_id, node, rwse2, ..., rwse<steps>): chances that a random walk is back after k steps.

    Walk probabilities are joined one step at a time; two and three steps need one join with
    degrees each. An isolated node has 0.
    """
    deg = degrees(edges, nodes).where("degree > 0")
    arcs = both_ways(edges).join(deg.withColumnRenamed("degree", "d"), ["graph_id", "node"])
    step = arcs.select("graph_id", F.col("node").alias("at"), F.col("nbr").alias("to"), (1.0 / F.col("d")).alias("p"))
    walk = step.select("graph_id", F.col("at").alias("node"), F.col("to").alias("at"), F.col("p").alias("q"))
    out = nodes
    for k in range(2, steps + 1):
        walk = (
            walk.join(step, ["graph_id", "at"])
            .groupBy("graph_id", "node", "to")
            .agg(F.sum(F.col("q") * F.col("p")).alias("q"))
            .select("graph_id", "node", F.col("to").alias("at"), "q")
        )
        back = walk.where("node = at").select("graph_id", "node", F.col("q").alias(f"rwse{k}"))
        out = out.join(back, ["graph_id", "node"], "left").fillna(0.0, [f"rwse{k}"])
    return out


def statistics_by_graph(edges: DataFrame, nodes: DataFrame, steps: int = 3) -> DataFrame:
    """(graph_id, node, degree, clustering, rwse2, ..., rwse<steps>) from each graph's matrix.

    The same values as ``clustering`` and ``return_probabilities`` give, for graphs of at most a few
    hundred nodes: everything of a graph comes from one shuffle instead of a join for each step.
    """

    def run(graph: int, ns: np.ndarray, es: np.ndarray) -> list[tuple]:
        at = {int(x): i for i, x in enumerate(ns)}
        a = np.zeros((len(ns), len(ns)))
        for u, v in es.tolist():
            a[at[u], at[v]] += 1
            if u != v:
                a[at[v], at[u]] += 1
        d = a.sum(1) + np.diag(a)
        plain = a - np.diag(np.diag(a))
        through = np.einsum("ij,jk,ki->i", plain, plain, plain, optimize=True)
        c = np.divide(through, d * (d - 1), out=np.zeros(len(ns)), where=d > 1)
        p = np.divide(a, a.sum(1)[:, None], out=np.zeros_like(a), where=a.sum(1)[:, None] > 0)
        back, walk = [], p
        for _ in range(2, steps + 1):
            walk = walk @ p
            back.append(np.diag(walk))
        return list(zip([graph] * len(ns), ns.tolist(), d.astype(int).tolist(), c.tolist(), *(b.tolist() for b in back)))

    names = ", ".join(f"rwse{k} double" for k in range(2, steps + 1))
    return per_graph(edges, nodes, run, f"graph_id long, node int, degree int, clustering double, {names}")


def per_graph(edges: DataFrame, nodes: DataFrame, fn: Callable[[int, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Run ``fn(graph_id, nodes, edges)`` on every graph; it returns rows of ``schema``.

    For what is sequential within one small graph. Edges and nodes are dealt by graph and sorted, so
    a task streams over its graphs and holds one at a time.
    """
    both = nodes.select("graph_id", F.col("node").alias("u"), F.lit(-1).alias("v")).union(edges.select("graph_id", "u", "v"))

    def split(graph: int, rows: np.ndarray) -> list[tuple]:
        alone = rows[:, 1] < 0
        return fn(graph, rows[alone, 0], rows[~alone])

    return _streamed(both.select("graph_id", "v", "u"), lambda graph, rows: split(graph, rows[:, ::-1]), schema)


def _streamed(rows: DataFrame, fn: Callable[[int, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Run ``fn(graph_id, matrix)`` on every graph's rows of whole numbers, in the order of their columns."""
    columns = [c for c in rows.columns if c != "graph_id"]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current: int | None = None

        def close() -> list[tuple]:
            return fn(current, np.concatenate(held))

        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("graph_id").to_numpy()
            rows = np.stack([batch.column(c).to_numpy() for c in columns], 1)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if current is not None and ids[lo] != current:
                    out += close()
                    held = []
                current = int(ids[lo])
                held.append(rows[lo:hi])
            if out:
                yield _batch(out, names, arrow)
        if held:
            out = close()
            if out:
                yield _batch(out, names, arrow)

    arrow = _arrow(schema)
    return _dealt(rows).mapInArrow(run, schema)


def per_batch(edges: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]], schema: str, graphs: int = 2000, rows: int = 1 << 18) -> DataFrame:
    """Run ``fn(graph_ids, sizes, u, v)`` on the edges of whole graphs, many at once; it yields tuples of arrays, the columns of ``schema``.

    Edges are dealt by graph and sorted by graph, v and u, as ``per_graph`` has them; ``sizes`` are the
    graphs' numbers of edges. A call has at most ``graphs`` graphs and, but for what one graph or Arrow
    batch brings, ``rows`` edges.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros((0, 3), np.int64)]

        def done(table: np.ndarray, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(begin), graphs):
                at = begin[lo : lo + graphs]
                end = begin[lo + graphs] if lo + graphs < len(begin) else len(table)
                for out in fn(table[at, 0], np.diff(np.append(at, end)), table[at[0] : end, 2], table[at[0] : end, 1]):
                    yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(arrow.field(n).type) for n, c in zip(names, out)], names)

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("graph_id", "v", "u")], 1))
            if sum(map(len, held)) < rows:
                continue
            table = np.concatenate(held)
            begin = _begins(table[:, 0])
            # The last graph may go on in the next batch.
            yield from done(table[: begin[-1]], begin[:-1])
            held = [table[begin[-1] :].copy()]
        table = np.concatenate(held)
        yield from done(table, _begins(table[:, 0]))

    arrow = _arrow(schema)
    return _dealt(edges.select("graph_id", "v", "u")).mapInArrow(run, schema)


def _begins(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.append(np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1]))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by graph and sorted by it and their other columns.

    Dealt by a hash of the graph, as no join is: a repartition by what joins below are dealt by is left out of the
    plan, and where adaptive execution then broadcasts or splits one of those joins, a graph's rows part.
    """
    return rows.repartition(F.xxhash64("graph_id")).sortWithinPartitions("graph_id", *(c for c in rows.columns if c != "graph_id"))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _batch(rows: list[tuple], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*rows))], names)


def component_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node reachable, an isolated node itself."""

    def label(graph: int, ns: np.ndarray, es: np.ndarray) -> list[tuple]:
        up = {int(x): int(x) for x in ns}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in es.tolist():
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
        return [(graph, x, root(x)) for x in up]

    return per_graph(edges, nodes, label, "graph_id long, node int, component int")


def component_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    labels = component_labels(edges, nodes)
    return labels.groupBy("graph_id").agg(F.count(F.when(F.col("node") == F.col("component"), 1)).alias("n_components"))


def largest_component(labels: DataFrame) -> DataFrame:
    return labels.groupBy("graph_id", "component").count().groupBy("graph_id").agg(F.max("count").alias("largest_cc"))


def distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, src, dst, dist) of all connected pairs src < dst, by breadth-first search."""

    def search(graph: int, ns: np.ndarray, es: np.ndarray) -> list[tuple]:
        near: dict[int, list[int]] = {int(x): [] for x in ns}
        for a, b in es.tolist():
            near[a].append(b)
            near[b].append(a)
        out = []
        for s in near:
            dist, front = {s: 0}, [s]
            while front:
                nxt = []
                for x in front:
                    for y in near[x]:
                        if y not in dist:
                            dist[y] = dist[x] + 1
                            nxt.append(y)
                front = nxt
            out += [(graph, s, t, d) for t, d in dist.items() if s < t]
        return out

    return per_graph(edges, nodes, search, "graph_id long, src int, dst int, dist int")


def max_flow(arcs: DataFrame, queries: DataFrame) -> DataFrame:
    """(graph_id, src, dst, flow) for queries (graph_id, src, dst) over (graph_id, u, v, weight).

    Undirected capacities; shortest augmenting paths within one small graph.
    """

    def run(graph: int, rows: np.ndarray) -> list[tuple]:
        # Queries come before the arcs.
        first = int(np.searchsorted(rows[:, 0], 1))
        cap: dict[int, dict[int, int]] = {}
        for _, a, b, w in rows[first:].tolist() if first else ():
            for x, y in ((a, b), (b, a)):
                cap.setdefault(x, {})
                cap[x][y] = cap[x].get(y, 0) + w
        out = []
        for _, s, t, _ in rows[:first].tolist():
            rest = {x: dict(ys) for x, ys in cap.items()}
            flow = 0
            while s in rest and t in rest and s != t:
                back, front = {s: s}, [s]
                while front and t not in back:
                    nxt = []
                    for x in front:
                        for y, c in rest[x].items():
                            if c > 0 and y not in back:
                                back[y] = x
                                nxt.append(y)
                    front = nxt
                if t not in back:
                    break
                path, x = [], t
                while x != s:
                    path.append((back[x], x))
                    x = back[x]
                push = min(rest[a][b] for a, b in path)
                for a, b in path:
                    rest[a][b] -= push
                    rest[b][a] = rest[b].get(a, 0) + push
                flow += push
            out.append((graph, s, t, flow))
        return out

    asked = queries.select("graph_id", F.lit(0).alias("kind"), F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(0).cast("long").alias("w"))
    both = asked.union(arcs.select("graph_id", F.lit(1).alias("kind"), "u", "v", F.col("weight").cast("long")))
    return _streamed(both, run, "graph_id long, src int, dst int, flow long")


def with_weights(edges: DataFrame) -> DataFrame:
    """Edges with weights 1 to 10 where none is given, from a hash of the edge."""
    given = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("int")
    drawn = (F.pmod(7 * F.col("u") + 3 * F.col("v") + F.col("graph_id"), F.lit(10)) + 1).cast("int")
    return edges.withColumn("weight", F.coalesce(given, drawn))


def modal_degree_share(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, share): how many nodes have the commonest degree."""
    counts = degrees(edges, nodes).groupBy("graph_id", "degree").count()
    return counts.groupBy("graph_id").agg((F.max("count") / F.sum("count")).alias("share"))


def rwse_degree_correlation(edges: DataFrame, nodes: DataFrame, k: int = 2) -> DataFrame:
    """(graph_id, r): Pearson correlation of degree and return probability, null if one is constant."""
    both = degrees(edges, nodes).join(return_probabilities(edges, nodes, k), ["graph_id", "node"])
    d, p = F.col("degree").cast("double"), F.col(f"rwse{k}")
    return both.groupBy("graph_id").agg(F.try_divide(F.covar_pop(d, p), F.stddev_pop(d) * F.stddev_pop(p)).alias("r"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, a, b, shared) for pairs (graph_id, a, b)."""
    near = neighbours(edges)
    left = near.select("graph_id", F.col("node").alias("a"), F.col("nbrs").alias("na"))
    right = near.select("graph_id", F.col("node").alias("b"), F.col("nbrs").alias("nb"))
    joined = pairs.join(left, ["graph_id", "a"], "left").join(right, ["graph_id", "b"], "left")
    return joined.select("graph_id", "a", "b", F.coalesce(F.size(F.array_intersect("na", "nb")), F.lit(0)).alias("shared"))


def disconnected_nodes(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(graph_id, node, answer): nodes without an edge to the target, sorted as strings."""
    t = targets.select("graph_id", F.col("node").alias("target"))
    others = t.join(nodes, "graph_id").where("node <> target")
    linked = both_ways(edges).select("graph_id", F.col("node").alias("target"), F.col("nbr").alias("node"))
    left = others.join(linked, ["graph_id", "target", "node"], "left_anti")
    listed = left.groupBy("graph_id", "target").agg(F.array_join(F.sort_array(F.collect_list(F.col("node").cast("string"))), ", ").alias("answer"))
    return t.join(listed, ["graph_id", "target"], "left").select("graph_id", F.col("target").alias("node"), F.coalesce("answer", F.lit("No nodes")).alias("answer"))


def topology(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a graph: n, m, realised density, mean degree, components, largest, triangles, clustering.

    Node-level values are brought together once and aggregated once.
    """
    labels = component_labels(edges, nodes)
    per_node = clustering(edges, nodes).join(labels, ["graph_id", "node"])
    sizes = Window.partitionBy("graph_id", "component")
    rows = per_node.withColumn("cc", F.count(F.lit(1)).over(sizes))
    d = F.col("degree")
    return rows.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        (F.sum("degree") / 2).cast("long").alias("n_edges"),
        F.when(F.count(F.lit(1)) > 1, F.sum("degree") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1))).otherwise(F.lit(0.0)).alias("density_real"),
        F.avg("degree").alias("mean_degree"),
        F.count(F.when(F.col("node") == F.col("component"), 1)).alias("n_components"),
        F.max("cc").alias("largest_cc"),
        F.round(F.sum(F.col("clustering") * d * (d - 1)) / 6).cast("long").alias("n_triangles"),
        F.avg("clustering").alias("mean_clustering"),
    )


def corpus_report(topo: DataFrame) -> DataFrame:
    """One row on a collection: shares of connected, edgeless, triangle-free graphs and density deciles."""
    deciles = F.percentile("density_real", F.array(*(F.lit(i / 10) for i in range(11))))
    flag = lambda c: F.avg(c.cast("double"))
    return topo.agg(
        F.count(F.lit(1)).alias("graphs"),
        flag(F.col("n_components") == 1).alias("connected"),
        flag(F.col("n_edges") == 0).alias("edgeless"),
        flag(F.col("n_triangles") == 0).alias("triangle_free"),
        F.avg("mean_clustering").alias("mean_clustering"),
        deciles.alias("density_deciles"),
    )


def graph_keys(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, key): node count and sorted edge list; equal for identical graphs."""
    listed = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("es"))
    text = F.concat_ws(" ", F.transform("es", lambda e: F.concat_ws("-", e["u"].cast("string"), e["v"].cast("string"))))
    return node_count(nodes).join(listed, "graph_id", "left").select("graph_id", F.concat(F.col("n_nodes").cast("string"), F.lit(":"), F.coalesce(text, F.lit(""))).alias("key"))


def multiset_difference(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys (column ``key``) that one side has more often than the other, each way."""
    a, b = left.select("key"), right.select("key")
    return a.exceptAll(b), b.exceptAll(a)


def average_rank(value: Column, window) -> Column:
    """Ranks in which ties share their mean."""
    ordered = window.orderBy(value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ordered.rangeBetween(0, 0)) - 1) / 2
