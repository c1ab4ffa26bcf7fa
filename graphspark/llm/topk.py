"""Exact top-k inner products by bounds from segment means and deviations, coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by a task at a time; more are answered block after block.
QUERY_BLOCK = 4096


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) of each length of the usable vectors of an Arrow list column.

    Vectors that are null, empty, or hold null or non-finite components are left out.
    """
    lengths = np.array([len(v) if v is not None else 0 for v in column.to_pylist()]) if column.null_count else np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, int)
    if not lengths.any():
        return []
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (lengths > 0) & (finite[starts + lengths] == finite[starts])
    out = []
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def segment_features(x: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(L) * (mean, population deviation) of ``parts`` near-equal segments of each row.

    The inner product of two rows of features bounds that of the rows themselves from above:
    within a segment, sum(x y) = L m m' + sum((x-m)(y-m')) <= L (m m' + s s'). Equivalently,
    L ((m-m')^2 + (s-s')^2) bounds the squared distance from below.
    """
    cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = x[:, lo:hi]
        out += [part.mean(1) * np.sqrt(hi - lo), part.std(1) * np.sqrt(hi - lo)]
    return np.stack(out, 1)


class _Best:
    """The k best (score, id) of each query so far, ties to the smaller id, each id once."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, n
        self.q = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.floor = np.full(n, -np.inf)

    def offer(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((-score, ids, q))
        q, ids, score = q[order], ids[order], score[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, score = q[once], ids[once], score[once]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        start = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - start
        keep = rank < self.k
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]
        full = rank == self.k - 1
        self.floor[q[full]] = score[full]


def _levels(d: int) -> list[int]:
    return [p for p in (2, 8, 16) if p < d] or [1]


def search_block(
    queries: tuple[np.ndarray, np.ndarray], batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): the k best of the given candidates for every query.

    Bounds are taken on 2, 8 and then 16 segments; a pair leaves as soon as one falls below the
    query's k-th best score so far, and exact scores are computed for the rest.
    """
    qid, qx = queries
    best = _Best(len(qid), k)
    levels = _levels(qx.shape[1])
    qf = [segment_features(qx, p) for p in levels]
    qn = np.sqrt((qx * qx).sum(1))
    step = 64  # a small first block sets the floors that prune the others
    for ids, x in batches:
        if x.shape[1] != qx.shape[1]:
            continue
        hi = 0
        while hi < len(ids):
            lo, hi = hi, min(len(ids), hi + step)
            step = 1024
            cid, cx = ids[lo:hi], x[lo:hi]
            cf = [segment_features(cx, p) for p in levels]
            # Room for rounding, so that no bound is below the score it stands for.
            slack = 1e-9 * qn[:, None] * np.sqrt((cx * cx).sum(1))[None, :] + 1e-6
            q, c = np.nonzero(qf[0] @ cf[0].T + slack >= best.floor[:, None])
            for a, b in zip(qf[1:], cf[1:]):
                if len(q) > 200_000:
                    near = (a @ b.T + slack)[q, c] >= best.floor[q]
                else:
                    near = np.einsum("ij,ij->i", a[q], b[c]) + slack[q, c] >= best.floor[q]
                q, c = q[near], c[near]
            other = qid[q] != cid[c]
            q, c = q[other], c[other]
            if len(q) > 100_000:
                score = np.rint(qx @ cx.T)[q, c]
            else:
                score = np.einsum("ij,ij->i", qx[q], cx[c])
            score = np.rint(score).astype(np.int64)
            near = score >= best.floor[q]
            best.offer(q[near], cid[c[near]], score[near])
    return qid[best.q], best.id, best.score


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k highest inner products.

    Components become floor(scale * x). Both tables need ``id_col`` and ``vector_col``; other
    columns are ignored. A query's own id is no candidate of it. Fewer than k candidates give all;
    ties go to the smaller id; repeated rows with one id count once, with their best score, and a
    repeated query id is asked once, with its smallest usable vector. Rows with a null id, a null or
    empty vector, or null or non-finite components take no part, as do candidates of another
    length than the query. Scores must lie below 2^53 in size to be exact. Empty tables give no rows.

    Queries are read in blocks of at most QUERY_BLOCK, so what a task holds has a bound; every
    block meets all candidates where they lie, each task hands on at most k rows a query, and only
    those are shuffled.
    """
    spark = vectors.sparkSession
    asked = (
        queries.select(F.col(id_col).cast("long").alias("q"), F.col(vector_col).cast("array<double>").alias("v"))
        .where("q is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
        .groupBy("q")
        .agg(F.min("v").alias("v"))
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")

    def runner(shared):
        def run(batches):
            blocks = shared.value

            def usable():
                for batch in batches:
                    for at, x in _matrices(batch.column("v")):
                        yield batch.column("id").to_numpy(zero_copy_only=False)[at], np.floor(scale * x)

            if len(blocks) == 1:
                results = [search_block(blocks[0], usable(), k)]
            else:
                held = list(usable())
                results = [search_block(b, iter(held), k) for b in blocks]
            for q, c, s in results:
                yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": c, "score": s})

        return run

    def answered(block: list) -> DataFrame:
        by_length: dict[int, list] = {}
        for q, v in block:
            if v and all(c is not None and np.isfinite(c) for c in v):
                by_length.setdefault(len(v), []).append((q, v))
        packed = [(np.array([q for q, _ in g], np.int64), np.floor(scale * np.array([v for _, v in g]))) for g in by_length.values()]
        shared = spark.sparkContext.broadcast(packed)
        return rows.mapInArrow(runner(shared), "query_id long, vec_id long, score long")

    found: DataFrame | None = None
    block: list = []
    for row in asked.toLocalIterator(prefetchPartitions=False):
        block.append((row.q, row.v))
        if len(block) == QUERY_BLOCK:
            found, block = (answered(block) if found is None else found.union(answered(block))), []
    if block or found is None:
        found = answered(block) if found is None else found.union(answered(block))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
