"""Graph collections as two tables: edges (graph_id, u, v) with u < v, and nodes (graph_id, node)."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphspark.sources.shared import derived, settled

EDGES = "graph_id long, u int, v int"
NODES = "graph_id long, node int"

#: Node counts of the size classes, and the algorithms in the order of a pool's quota.
SIZE_CLASSES = {"small": (5, 9), "medium": (10, 14), "large": (15, 19)}
ALGORITHMS = ("er", "ba", "sbm", "sfn", "complete", "star", "path")
SPLIT_SEEDS = {"train": 9876, "test": 1234, "valid": 5432}


def order_graphs(spark: SparkSession, sf_dir: str, size: int = 40) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes), one graph per customer: nodes are part classes bought, edges join what one order holds.

    A session derives the two tables once and writes them, sorted by graph within their files; whatever
    reads graphs then starts from a scan.
    """
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem")]
    made = lambda part: lambda: _order_graphs(spark, sf_dir, size)[part].sortWithinPartitions("graph_id")
    return derived(spark, f"order-edges-{size}", inputs, made(0)), derived(spark, f"order-nodes-{size}", inputs, made(1))


def _order_graphs(spark: SparkSession, sf_dir: str, size: int) -> tuple[DataFrame, DataFrame]:
    """An order has a handful of lines, so pairing them within the order is linear in the table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.pmod("l_partkey", F.lit(size)).cast("int").alias("node"))
    bought = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("o_custkey").alias("graph_id"), "o_orderkey", "node")
    # Dealt by order once: what follows up to the edges' own distinct needs no other shuffle.
    sets = bought.where("graph_id is not null and o_orderkey is not null and node is not null").repartition("graph_id", "o_orderkey").distinct()
    nodes = sets.select("graph_id", "node").distinct()
    other = sets.withColumnRenamed("node", "v")
    edges = sets.withColumnRenamed("node", "u").join(other, ["graph_id", "o_orderkey"]).where("u < v").select("graph_id", "u", "v").distinct()
    return edges, nodes


def arithmetic_corpus(spark: SparkSession, graphs: int, size: int = 40, thousandths: tuple[int, ...] = (100, 200, 350, 500)) -> tuple[DataFrame, DataFrame]:
    """Graphs whose edges come from integer arithmetic alone, the same in any engine.

    graph_id is index * len(thousandths) + position of the density.
    """
    levels = F.array(*(F.lit(p) for p in thousandths))
    keys = spark.range(graphs).select(F.col("id").alias("g"), F.posexplode(levels).alias("k", "p"))
    keys = keys.select((F.col("g") * len(thousandths) + F.col("k")).alias("graph_id"), "g", F.col("p").cast("long").alias("p"))
    one = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 2))).alias("u"))
    two = one.select("*", F.explode(F.sequence(F.col("u") + 1, F.lit(size - 1))).alias("v"))
    u, v, g, p = F.col("u").cast("long"), F.col("v").cast("long"), F.col("g"), F.col("p")
    hashed = 7919 * u * u + 104729 * v + 1299709 * u * v + 15485863 * (g + 1) * (u + 3 * v + p)
    edges = two.where(hashed % 1000 < p).select("graph_id", "u", "v")
    nodes = keys.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("node"))
    return edges, nodes


def _random_graph(algorithm: str, n: int, rng: random.Random, low: float, high: float) -> set[tuple[int, int]]:
    """One undirected graph on nodes 0..n-1 by the named model."""
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    if algorithm == "er":
        p = rng.uniform(low, high)
        return {e for e in pairs if rng.random() < p}
    if algorithm == "complete":
        return set(pairs)
    if algorithm == "star":
        return {(0, b) for b in range(1, n)}
    if algorithm == "path":
        return {(a, a + 1) for a in range(n - 1)}
    if algorithm == "sbm":
        blocks = rng.randint(2, 4 if n < 10 else 8 if n < 15 else 10)
        of = [rng.randrange(blocks) for _ in range(n)]
        chance = {(a, b): rng.random() for a in range(blocks) for b in range(a, blocks)}
        return {(a, b) for a, b in pairs if rng.random() < chance[min(of[a], of[b]), max(of[a], of[b])]}
    if algorithm == "ba":
        m = rng.randint(1, max(1, n - 1))
        edges = {(0, b) for b in range(1, min(n, m + 1))}
        ends = [x for e in edges for x in e]
        for new in range(m + 1, n):
            targets: set[int] = set()
            while len(targets) < m:
                targets.add(rng.choice(ends))
            edges |= {(min(t, new), max(t, new)) for t in targets}
            ends += [*targets, *([new] * m)]
        return edges
    if algorithm == "sfn":
        edges, ends = {(0, 1), (1, 2), (0, 2)}, [0, 1, 1, 2, 2, 0]
        count = 3
        while count < n:
            draw = rng.random()
            if draw < 0.95:
                a, b = count, rng.choice(ends)
                count += 1
            else:
                a, b = rng.choice(ends), rng.choice(ends)
            edges.add((min(a, b), max(a, b)))
            ends += [a, b]
        return edges
    raise ValueError(f"unknown algorithm {algorithm!r}")


def generate(spark: SparkSession, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs for rows (graph_id, algorithm, seed, low, high, min_nodes, max_nodes), one task a slice.

    A graph depends on its own row only, so any number of them is made in parallel and again alike.
    Self-loops of the scale-free model stay (u = v).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[int, int, int]] = []
            for r in frame.itertuples():
                rng = random.Random(int(r.seed))
                n = rng.randint(int(r.min_nodes), int(r.max_nodes))
                out += [(r.graph_id, -1, x) for x in range(n)]
                out += [(r.graph_id, *e) for e in sorted(_random_graph(r.algorithm, n, rng, r.low, r.high))]
            yield pd.DataFrame(out, columns=["graph_id", "u", "v"]).astype({"graph_id": "int64", "u": "int32", "v": "int32"})

    made = settled(keys.mapInPandas(run, EDGES))
    return made.where("u >= 0"), made.where("u < 0").select("graph_id", F.col("v").alias("node"))


def pool_keys(spark: SparkSession, count: int, seed: int, algorithms: tuple[str, ...] = ALGORITHMS, low: float = 0.0, high: float = 1.0, size_class: str | None = None) -> DataFrame:
    """Keys of a pool spread evenly over the algorithms; the first ones take the remainder."""
    share, rest = divmod(count, len(algorithms))
    quota = [(a, seed + ALGORITHMS.index(a), share + (i < rest)) for i, a in enumerate(algorithms)]
    table = spark.createDataFrame(quota, "algorithm string, base int, quota int").where("quota > 0")
    rows = table.select("*", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("idx"))
    classes = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ([SIZE_CLASSES[size_class]] if size_class else SIZE_CLASSES.values())))
    pick = F.element_at(classes, (F.pmod(F.hash("base", "idx"), F.size(classes)) + 1).cast("int"))
    return rows.select(
        F.xxhash64("algorithm", "base", "idx").alias("graph_id"),
        "algorithm",
        (F.col("base").cast("long") * 1_000_003 + F.col("idx")).alias("seed"),
        F.lit(low).alias("low"),
        F.lit(high).alias("high"),
        pick["lo"].alias("min_nodes"),
        pick["hi"].alias("max_nodes"),
    )


def sweep_keys(spark: SparkSession, sizes: tuple[int, ...], densities: tuple[float, ...], count: int, seed: int) -> DataFrame:
    """One key per (size, density, index); the seed depends on all three and no two coincide."""
    rows = (
        spark.createDataFrame([(n, d) for n in sizes for d in densities], "n int, density double")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("idx"))
        .withColumn("seed", F.lit(seed) + 1_000_000 * (1 + F.round(F.col("density") * 1000)).cast("long") + 1000 * F.col("n") + F.col("idx"))
    )
    return rows.select(
        F.col("seed").alias("graph_id"), F.lit("er").alias("algorithm"), "seed", F.col("density").alias("low"), F.col("density").alias("high"), F.col("n").alias("min_nodes"), F.col("n").alias("max_nodes"), "density", "idx"
    )


def fixed_size_random(nodes_per_graph: int, edges_per_graph: int, keys: DataFrame) -> DataFrame:
    """Uniform graphs of a fixed number of edges: the first pairs in a seeded hash order."""
    u = F.explode(F.sequence(F.lit(0), F.lit(nodes_per_graph - 2)))
    pairs = keys.select("graph_id", u.alias("u")).select("graph_id", "u", F.explode(F.sequence(F.col("u") + 1, F.lit(nodes_per_graph - 1))).alias("v"))
    order = Window.partitionBy("graph_id").orderBy(F.xxhash64("graph_id", "u", "v"), "u", "v")
    return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= edges_per_graph).drop("n")


def labelled_graphs(spark: SparkSession, n: int) -> DataFrame:
    """Every labelled graph on n <= 6 nodes: (mask, degrees array, edges array)."""
    if not 1 <= n <= 6:
        raise ValueError("1 to 6 nodes")
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    masks = spark.range(1 << len(pairs)).withColumnRenamed("id", "mask")
    bit = lambda i: F.shiftright("mask", i).bitwiseAND(F.lit(1))
    degree = [sum((bit(i) for i, e in enumerate(pairs) if x in e), F.lit(0)).cast("int") for x in range(n)]
    listed = F.array(*(F.when(bit(i) == 1, F.array(F.lit(a), F.lit(b))) for i, (a, b) in enumerate(pairs))) if pairs else F.array()
    return masks.select("mask", F.array(*degree).alias("degrees"), F.filter(listed, lambda e: e.isNotNull()).alias("edges"))


def orient(edges: DataFrame, seed: int = 1234) -> DataFrame:
    """Each undirected edge in one direction by a fair seeded coin: (graph_id, src, dst)."""
    heads = F.pmod(F.xxhash64(F.lit(seed), "graph_id", "u", "v"), F.lit(2)) == 0
    return edges.select("graph_id", F.when(heads, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(heads, F.col("v")).otherwise(F.col("u")).alias("dst"))


def undirect(arcs: DataFrame) -> DataFrame:
    """Undirected simple edges of arcs (graph_id, src, dst); parallels go, self-loops stay."""
    return arcs.select("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def coauthorship(papers: DataFrame) -> DataFrame:
    """Edges between authors of one paper, from (paper_id, author_ids)."""
    a = F.explode(F.array_distinct("author_ids"))
    one = papers.select("paper_id", "author_ids", a.alias("u"))
    return one.select("u", F.explode(F.array_distinct("author_ids")).alias("v")).where("u < v").distinct()


def bipartite(papers: DataFrame) -> DataFrame:
    """Edges (author, paper) from (paper_id, author_ids)."""
    return papers.select(F.explode(F.array_distinct("author_ids")).alias("author"), "paper_id").distinct()


def expand_hops(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """(id, hop) of all ids within ``hops`` links (src, dst both ways) of those in ``start`` (id)."""
    both = links.select("src", "dst").union(links.select("dst", "src"))
    seen = start.select("id", F.lit(0).alias("hop"))
    front = start.select("id")
    for hop in range(1, hops + 1):
        front = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.union(front.select("id", F.lit(hop)))
    return seen


def without_attributes(nodes: DataFrame) -> DataFrame:
    """Nodes without blocks, names or positions."""
    return nodes.select("graph_id", "node").distinct()


def gaps_in_ids(nodes: DataFrame) -> DataFrame:
    """Graphs whose nodes are not 0 to n - 1: a check before nodes are named that should find nothing."""
    per = nodes.groupBy("graph_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count_distinct("node").alias("n"))
    return per.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1))
