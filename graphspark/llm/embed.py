"""Embedding near-duplicates: range joins of boxes in rotated subspaces, found links verified exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import Forest, cut, in_worker, tidy
from graphspark.llm.components import connected_components

#: Vectors that the boxes are fitted on, at most; every vector is dealt to its box and compared.
SAMPLE = 4096
#: Bytes of vectors in one block, at most.
BLOCK_BYTES = 4 << 20
#: Rows of a tile, pairs of a product, and pairs verified at once.
_TILE, _PRODUCT, _VERIFIED = 512, 2 << 20, 100_000


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal d x d matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Cells:
    """A k-d split of space into axis-parallel boxes that cover all of it; neighbours have near numbers."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.axis: list[int] = []
        self.at: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.leaves = 0
        self.root = self._grow(sample, depth)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray, depth: int) -> int:
        if depth == 0 or len(x) < 2:
            return self._leaf()
        axis = int(np.argmax(x.var(0)))
        at = float(np.median(x[:, axis]))
        me = len(self.axis)
        self.axis.append(axis)
        self.at.append(at)
        self.low.append(0)
        self.high.append(0)
        below = x[:, axis] < at
        self.low[me] = self._grow(x[below], depth - 1)
        self.high[me] = self._grow(x[~below], depth - 1)
        return me

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The box of every row, from 1."""
        out = np.empty(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, idx = stack.pop()
            if node < 0:
                out[idx] = -node
            elif len(idx):
                low = x[idx, self.axis[node]] < self.at[node]
                stack += [(self.low[node], idx[low]), (self.high[node], idx[~low])]
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled down first, so that squares cannot overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Subspaces:
    def __init__(self, d: int, block: int, threshold: float) -> None:
        self.turn = rotation(d)
        count = max(1, d // block)
        self.starts = np.linspace(0, d, count + 1).astype(int)[:-1]
        #: Squared distance of a linked pair at most, over all subspaces, with room for rounding.
        self.budget = 2 * (1 - threshold) + 1e-4
        self.d = d
        self.threshold = threshold
        #: More than a product in single precision of two unit vectors can be off.
        self.slack = 1.2e-7 * (d + 16)

    def apart(self, low: np.ndarray, high: np.ndarray, boxes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Squared distance of one box to each of ``boxes``, subspace by subspace until it is beyond the budget."""
        out = np.zeros(len(boxes[0]))
        for lo, hi in zip(self.starts, [*self.starts[1:], self.d]):
            near = np.flatnonzero(out <= self.budget)
            gap = np.maximum(0, np.maximum(boxes[0][near, lo:hi] - high[lo:hi], low[lo:hi] - boxes[1][near, lo:hi]))
            out[near] += (gap * gap).sum(1)
        return out


def _tiles(x: np.ndarray, idx: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows ``idx`` in groups of at most ``size``, by medians along the widest axes."""
    if len(idx) == 0:
        return []
    if len(idx) <= size:
        return [idx]
    axis = int(np.argmax(np.ptp(x[idx], axis=0)))
    order = idx[np.argpartition(x[idx, axis], len(idx) // 2)]
    half = len(idx) // 2
    return _tiles(x, order[:half], size) + _tiles(x, order[half:], size)


@dataclass
class _Block:
    node: np.ndarray
    copies: np.ndarray
    #: Unit vectors in double and in single precision, tile by tile.
    unit: np.ndarray
    single: np.ndarray
    #: Where tiles begin and end, and their boxes in the rotated space.
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _block(node: bytes, copies: bytes, x: bytes, kind: type, space: _Subspaces) -> _Block:
    y = _normal(np.frombuffer(x, kind).reshape(-1, space.d).astype(np.float64))
    z = y @ space.turn
    tiles = _tiles(z, np.arange(len(y)), _TILE)
    order = np.concatenate(tiles)
    low, high = (np.array([how(z[t], axis=0) for t in tiles]) for how in (np.min, np.max))
    node, copies = (np.frombuffer(c, np.int64)[order] for c in (node, copies))
    y = y[order]
    return _Block(node, copies, y, y.astype(np.float32), np.cumsum([0, *map(len, tiles)]), low, high)


def _links(a: _Block, b: _Block, same: bool, space: _Subspaces):
    """Yield arrays (i, j) of linked rows of two blocks, or of one with itself, then each pair once."""
    for t in range(len(a.low)):
        lo, hi = a.cuts[t], a.cuts[t + 1]
        near = np.flatnonzero(space.apart(a.low[t], a.high[t], (b.low, b.high)) <= space.budget)
        if same:
            near = near[near >= t]
        # Tiles in reach, as many at once as a product has room for.
        wide = max(1, _PRODUCT // _TILE // _TILE)
        for s in range(0, len(near), wide):
            other = np.concatenate([np.arange(b.cuts[u], b.cuts[u + 1]) for u in near[s : s + wide]])
            product = a.single[lo:hi] @ b.single[other].T
            hits = np.flatnonzero(product >= np.float32(space.threshold - space.slack))
            i, j, told = hits // len(other), other[hits % len(other)], product.ravel()[hits]
            i = i + lo
            if same:
                i, j, told = (c[j > i] for c in (i, j, told))
            sure = told >= np.float32(space.threshold + space.slack)
            unsure = np.flatnonzero(~sure)
            for v in range(0, len(unsure), _VERIFIED):
                at = unsure[v : v + _VERIFIED]
                sure[at] = np.einsum("ij,ij->i", a.unit[i[at]], b.unit[j[at]]) >= space.threshold
            if sure.any():
                yield i[sure], j[sure]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, block: int = 8, leaf_rows: int = 32768, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean), one row for every row.

    Two rows link if the cosine of their vectors, in double precision, is at least ``threshold``.
    n_links counts the other rows linked directly, component_id is the smallest id reachable and
    kept tells whether that is the row itself. Vectors that are null, empty, all zero, or hold null
    or non-finite components link with nothing; neither do vectors of different lengths. Rows with
    equal vectors are one class: copies are counted, never paired. Of rows with one id each counts
    as a row of its own. Rows with a null id stay, count as links, and are never kept. Empty tables
    give no rows.

    Unit vectors are rotated and split into subspaces of about ``block`` dimensions. They are laid out
    by k-d boxes (fitted on at most SAMPLE vectors), in parts of about ``leaf_rows`` that are packed into
    blocks. Squared distance is at most 2 - 2 * threshold for a linked pair, so a block meets those
    whose box is within that budget over all subspaces, and so do the tiles of two blocks; what meets is
    compared whole. Blocks are read where they lie, so each vector is written once, however many
    it meets: work is quadratic where boxes part little, disk and memory are not. A pair of parts
    hands on link counts and spanning edges instead of links. Classes are told apart by their
    vectors, and rows find theirs by a 128-bit hash.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must lie between 0.5 and 1")
    spark = vectors.sparkSession
    v = F.col("v")
    usable = (
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0)
    )
    # Adding 0.0 makes one zero of the two, so that equal vectors group.
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda c: c + F.lit(0).cast("float")).alias("v"))
    rows = rows.withColumn("v", F.when(usable, v))
    keys = [F.when(v.isNotNull(), F.xxhash64(F.lit(i), v)).alias(f"h{i}") for i in (1, 2)]
    classes = rows.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"))
    classes = cut(classes.select("*", *keys, F.monotonically_increasing_id().alias("node")))
    tidy(spark)

    found: list[DataFrame] = []
    for d, total in [(r.d, r.n) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]:
        if total > 1:
            found.append(_linked(classes.where(F.size("v") == d), total, _Subspaces(d, block, threshold), leaf_rows))
    counted = "node long, links long, other long"
    if found:
        results = found[0]
        for more in found[1:]:
            results = results.union(more)
        results = cut(results)
    else:
        results = spark.createDataFrame([], counted)
    del found
    tidy(spark)
    direct = results.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(results.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # Vectors stay behind from here on.
    named = classes.drop("v").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    table = (
        named.join(lowest, "component")
        .join(direct, "node", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    out = rows.select("id", *keys).join(table, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _blocks(classes: DataFrame, total: int, space: _Subspaces, leaf_rows: int) -> DataFrame:
    """(block, node, copies, x, low, high): vectors of one length, packed in the order of their boxes.

    ``node``, ``copies`` and ``x`` hold the rows' bytes, ``low`` and ``high`` the box of all in the
    rotated space. A part has about ``leaf_rows`` rows, fewer where there would be fewer than four parts.
    """
    depth = min(max(0, math.ceil(math.log2(total / _TILE))), int(math.log2(SAMPLE)) - 3)
    sample = [r.v for r in classes.orderBy(F.xxhash64(F.lit(3), "node")).limit(SAMPLE).select("v").collect()]
    cells = Cells(_normal(np.array(sample, np.float64)) @ space.turn, depth)
    parts = max(min(4, total // 2048), -(-total // leaf_rows))
    width = 4 if classes.schema["v"].dataType.elementType.simpleString() == "float" else 8
    most = max(1, min(leaf_rows // 2, BLOCK_BYTES // (width * space.d)))

    def values(batch):
        return np.ascontiguousarray(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, space.d))

    def lay(batches):
        for batch in batches:
            if batch.num_rows:
                x = values(batch)
                leaf = cells.leaf_of(_normal(x.astype(np.float64)) @ space.turn)
                offsets = pa.py_buffer((np.arange(len(x) + 1) * space.d * width).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("node"), batch.column("copies"), packed], ["leaf", "node", "copies", "x"])

    def packed(tables):
        node, copies = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("node", "copies"))
        x = b"".join(e for t in tables for e in t.column("x").to_pylist())
        z = _normal(np.frombuffer(x, np.float32 if width == 4 else np.float64).reshape(-1, space.d).astype(np.float64)) @ space.turn
        low, high = (pa.array([c.tolist()], pa.list_(pa.float64())) for c in (z.min(0), z.max(0)))
        bytes_ = [pa.array([c], pa.binary()) for c in (node.tobytes(), copies.tobytes(), x)]
        return pa.RecordBatch.from_arrays([*bytes_, low, high], ["node", "copies", "x", "low", "high"])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, most - n)
                batch = batch.slice(len(take))
                held.append(take)
                n += len(take)
                if n == most:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    laid = classes.select("node", "copies", "v").mapInArrow(in_worker("embed", lay), "leaf int, node long, copies long, x binary")
    laid = laid.repartitionByRange(parts, "leaf", "node").sortWithinPartitions("leaf", "node").coalesce(parts)
    blocks = laid.mapInArrow(in_worker("embed", pack), "node binary, copies binary, x binary, low array<double>, high array<double>")
    return cut(blocks.withColumn("block", F.monotonically_increasing_id()))


def _linked(classes: DataFrame, total: int, space: _Subspaces, leaf_rows: int) -> DataFrame:
    """Link counts (node, links, null) and spanning edges (node, null, other) of vectors of one length."""
    blocks = _blocks(classes, total, space, leaf_rows)
    tidy(classes.sparkSession)
    kind = np.float32 if classes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    a, b = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "ab")
    gap = F.zip_with(
        F.zip_with("b_low", "a_high", lambda x, y: x - y),
        F.zip_with("a_low", "b_high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= space.budget
    # Every pair of parts is a task that reads both where they lie; nothing is shuffled.
    met = a.hint("shuffle_replicate_nl").join(b, (F.col("a_block") <= F.col("b_block")) & near)

    def compare(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        forest = Forest()
        last: tuple[int, _Block] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if last is None or last[0] != r["a_block"]:
                    last = r["a_block"], _block(r["a_node"], r["a_copies"], r["a_x"], kind, space)
                left, same = last[1], r["a_block"] == r["b_block"]
                right = left if same else _block(r["b_node"], r["b_copies"], r["b_x"], kind, space)
                counts = [held.setdefault(r[f"{side}_block"], (x.node, np.zeros(len(x.node), np.int64)))[1] for side, x in (("a", left), ("b", right))]
                # Rows of both under one number, and the component that each is known to be in.
                shift = 0 if same else len(left.node)
                node = left.node if same else np.concatenate([left.node, right.node])
                label = np.arange(len(node))
                for i, j in _links(left, right, same, space):
                    counts[0] += np.bincount(i, right.copies[j], len(left.node)).astype(np.int64)
                    counts[1] += np.bincount(j, left.copies[i], len(right.node)).astype(np.int64)
                    new = label[i] != label[j + shift]
                    if new.any():
                        label = _merged(label, label[i[new]], label[j[new] + shift])
                root = np.full(len(node), np.iinfo(np.int64).max)
                np.minimum.at(root, label, node)
                for member, top in zip(node[root[label] != node].tolist(), root[label][root[label] != node].tolist()):
                    forest.join(member, top)
        for node, counts in held.values():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(counts[some]), pa.nulls(len(some), pa.int64())], ["node", "links", "other"]
            )
        members, roots = forest.edges()
        yield pa.RecordBatch.from_arrays(
            [pa.array(members, pa.int64()), pa.nulls(len(members), pa.int64()), pa.array(roots, pa.int64())], ["node", "links", "other"]
        )

    wanted = [c for c in met.columns if not c.endswith(("_low", "_high"))]
    return met.select(*wanted).mapInArrow(in_worker("embed", compare), "node long, links long, other long")


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after each of ``a`` has become one with its ``b``: every round hands on the smaller of two."""
    up = np.arange(len(label))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            return up[label]
        low = np.minimum(x, y)
        np.minimum.at(up, x, low)
        np.minimum.at(up, y, low)
        while True:
            down = up[up]
            if (down == up).all():
                break
            up = down
