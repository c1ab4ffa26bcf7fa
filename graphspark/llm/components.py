"""Distributed connected components by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import Forest, cut

_EDGE = "a long, b long"


def _local_forest(batches):
    """Replace the edges of a partition, a bounded block at a time, by a spanning forest."""
    limit = 500_000
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
        if len(forest.up) > limit:
            members, roots = forest.edges()
            yield pa.RecordBatch.from_pydict({"a": pa.array(members, pa.int64()), "b": pa.array(roots, pa.int64())})
            forest = Forest()
    members, roots = forest.edges()
    yield pa.RecordBatch.from_pydict({"a": pa.array(members, pa.int64()), "b": pa.array(roots, pa.int64())})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    low = low.select("n", F.least("n", "m").alias("m"))
    linked = both.join(low, both["a"] == low["n"])
    return linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    linked = down.join(low, down["a"] == low["n"])
    moved = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Label every node that has an edge with the smallest node id it can reach.

    Returns (node long, component long). Edges may repeat, point either way or be loops; rows with
    a null end are ignored, and a node that only has loops is not returned. No edges give no rows.

    Each round is a large star and a small star: every node hands its neighbours the smallest one
    it knows. Minima are pre-aggregated before the shuffle and meet the edges in an ordinary
    equi-join, so a hub's edges are split by the skew-join rule instead of meeting in one task.
    Every round is cut with a reliable checkpoint. Rounds grow with the logarithm of the diameter.
    """
    spark = edges.sparkSession
    pairs = (
        edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .mapInArrow(_local_forest, _EDGE)
    )
    pairs = cut(pairs)
    if pairs.isEmpty():
        return spark.createDataFrame([], "node long, component long")
    mark = None
    while True:
        pairs = cut(_small_star(_large_star(pairs).distinct()).where("a <> b").distinct())
        now = pairs.agg(
            F.count(F.lit(1)).alias("n"),
            F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))").alias("s"),
        ).first()
        if (now.n, now.s) == mark:
            break
        mark = (now.n, now.s)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
