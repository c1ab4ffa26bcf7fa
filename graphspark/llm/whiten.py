"""Whitening of vectors: a covariance summed tile by tile over shuffled column blocks, then one small eigenproblem."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import in_worker, sorted_groups

#: Entries beyond this have no fixed-point form in a long; a vector with one takes no part.
LARGEST = 2.0**56
#: Eigenvalues below this share of the largest are rounding: their components do not exist.
NO_RANK = 2.0**-48
#: Dimensions whose covariance the driver takes apart.
MAX_DIMENSIONS = 8192
#: Bytes of column blocks that leave a task at a time.
SENT = 16_000_000


@dataclass(frozen=True)
class Whitening:
    """What a fit list gives: its size, exact sums, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: float
    shift: int
    widest: int

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Each dimension's mean as a whole number and what remains of it, of at most a half."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [float(s - self.n * w) / self.n for s, w in zip(self.sums, whole)]
        return np.array(whole, np.int64), np.array(rest, np.float64)


def usable(v: Column) -> Column:
    """Not null, not empty, and all entries finite numbers that have a fixed-point form."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))


def fixed_point(v: Column, scale: float, shift: int) -> Column:
    """floor(scale * c) + shift of every entry, as longs."""
    return F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _narrow(y: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    top = int(np.abs(y).max(initial=0))
    return np.ascontiguousarray(y, next(t for t, most in ((np.int8, 1 << 7), (np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 64)) if top < most))


def tiled_gram(blocks: DataFrame, d: int, centre, tile: int) -> np.ndarray:
    """The sum over all rows of y'y, where y = ``centre`` of a row, for rows ``x`` of ``d`` entries.

    Dimensions are cut into blocks of ``tile``, and pairs of blocks are the tiles. Every batch of
    rows is a row-block; the column blocks that a tile needs of it travel under the key (tile,
    row-block), so that a hot tile or source is spread over all tasks. A task multiplies its pairs
    and keeps one sum for each tile; those sums then meet by tile. Whole numbers whose products
    add up to less than 2^53 are summed exactly, whatever the order.
    """
    cuts = list(range(0, d, tile)) + [d]
    spans = list(zip(cuts[:-1], cuts[1:]))
    pairs = [(i, j) for i in range(len(spans)) for j in range(i, len(spans))]

    def send(batches):
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(b for b in batches if b.num_rows):
            y = centre(_matrix(batch.column("x"), d))
            if y.dtype.kind == "i":
                y = _narrow(y)
            columns = [np.ascontiguousarray(y[:, lo:hi]).tobytes() for lo, hi in spans]
            step = max(1, SENT // (2 * len(columns[0]) + 1))
            for at in range(0, len(pairs), step):
                some = pairs[at : at + step]
                yield pa.RecordBatch.from_pydict(
                    {
                        "tile": pa.array(range(at, at + len(some)), pa.int32()),
                        "block": pa.array([(part << 32) + number] * len(some), pa.int64()),
                        "kind": pa.array([y.dtype.str] * len(some), pa.string()),
                        "a": pa.array([columns[i] for i, _ in some], pa.binary()),
                        "b": pa.array([None if i == j else columns[j] for i, j in some], pa.binary()),
                    }
                )

    def multiply(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for tile_id, kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "a", "b"))):
                i, j = pairs[tile_id]
                left = _block(a, kind, spans[i])
                right = left if b is None else _block(b, kind, spans[j])
                product = left.T @ right
                sums[tile_id] = sums[tile_id] + product if tile_id in sums else product
        if sums:
            yield pa.RecordBatch.from_pydict({"tile": pa.array(list(sums), pa.int32()), "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    def add(batches):
        for tile_id, table in sorted_groups(batches, "tile"):
            total = sum(np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist())
            yield pa.RecordBatch.from_pydict({"tile": pa.array([tile_id], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    sent = blocks.mapInArrow(in_worker("whiten", send), "tile int, block long, kind string, a binary, b binary")
    partial = sent.repartition("tile", "block").mapInArrow(in_worker("whiten", multiply), "tile int, sums binary")
    summed = partial.repartition("tile").sortWithinPartitions("tile").mapInArrow(in_worker("whiten", add), "tile int, sums binary")
    out = np.zeros((d, d))
    for row in summed.toLocalIterator():
        (a, b), (c, e) = (spans[k] for k in pairs[row.tile])
        part = np.frombuffer(row.sums, np.float64).reshape(b - a, e - c)
        out[a:b, c:e] = part
        out[c:e, a:b] = part.T
    return out


def _block(data: bytes, kind: str, span: tuple[int, int]) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, span[1] - span[0]).astype(np.float64)


def lengths(vectors: DataFrame, vector_col: str = "embedding") -> list[int]:
    """The lengths of the usable vectors."""
    v = F.col(vector_col)
    return sorted(r.d for r in vectors.where(usable(v)).select(F.size(v).alias("d")).distinct().collect())


def fit(vectors: DataFrame, d: int, components: int = 32, vector_col: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, tile: int = 32) -> Whitening | None:
    """Mean and leading components of all usable vectors of length ``d``; None if there are none.

    Sums and, below 2^53, products are exact, so the result depends neither on the order of rows nor
    on how they are partitioned. Components of no variance are left out.
    """
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MAX_DIMENSIONS}")
    v = F.col(vector_col)
    x = vectors.where(usable(v) & (F.size(v) == d)).select(fixed_point(v, scale, shift).alias("x"))

    def count(batches):
        n, sums, low, high = 0, np.zeros(d, object), None, None
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column("x"), d)
                n += len(y)
                # Two halves of a long each, so that sums of any number of rows are exact.
                sums = sums + ((y >> 32).sum(0).astype(object) << 32) + (y & 0xFFFFFFFF).sum(0).astype(object)
                low = y.min(0) if low is None else np.minimum(low, y.min(0))
                high = y.max(0) if high is None else np.maximum(high, y.max(0))
        if n:
            columns = {"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d), "total": pa.array([str(s) for s in sums]), "low": pa.array(low), "high": pa.array(high)}
            yield pa.RecordBatch.from_pydict(columns)

    counted = x.mapInArrow(in_worker("whiten", count), "i int, n long, total string, low long, high long")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    known = counted.groupBy("i").agg(F.sum("n").alias("n"), total, F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not known:
        return None
    n, sums = known[0].n, tuple(int(r.total) for r in known)
    widest = max(max(abs(n * r.low - s), abs(n * r.high - s)) for r, s in zip(known, sums))
    blank = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, scale, shift, widest)
    whole, rest = blank.centre()
    gram = tiled_gram(x, d, lambda y: y - whole, tile)
    covariance = gram / n - np.outer(rest, rest)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    kept = min(components, int((values > NO_RANK * max(values[0], 0)).sum()))
    return Whitening(n, sums, values[:kept], axes[:, :kept], trace, scale, shift, widest)


def whiten(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, deviation decimal(38,0), whitened array<double>) of every usable vector of the model's length.

    deviation is the exact sum of (n * x - S)^2. Rows with one id, copies and null ids stay as they are.
    """
    d = len(model.sums)
    whole, rest = model.centre()
    project = model.vectors / np.sqrt(model.values)
    n, short = model.n, model.widest**2 * d < 2**63
    left = [s - n * int(w) for s, w in zip(model.sums, whole)]
    v = F.col(vector_col)
    kind = vectors.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = _matrix(batch.column("x"), d) - whole
            # n * x - S, where S = n * whole + left: longs if their squares fit, else Python's own.
            if short:
                apart = y * n - np.array(left, np.int64)
                deviation = (apart * apart).sum(1).tolist()
            else:
                deviation = [sum((n * a - s) ** 2 for a, s in zip(row, left)) for row in y.tolist()]
            white = (y - rest) @ project
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * white.shape[1])
            arrays = pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([str(s) for s in deviation], pa.string()), arrays], ["vec_id", "deviation", "whitened"])

    rows = vectors.where(usable(v) & (F.size(v) == d)).select(F.col(id_col).alias("vec_id"), fixed_point(v, model.scale, model.shift).alias("x"))
    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = rows.mapInArrow(in_worker("whiten", run), schema)
    return out.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def identity_error(white: DataFrame, model: Whitening, tile: int = 32) -> float:
    """The largest entry, in absolute value, of the whitened rows' covariance minus the identity.

    Measured over the rows themselves, by the same tiles; 0 where there are no components.
    """
    k = len(model.values)
    if k == 0:
        return 0.0
    gram = tiled_gram(white.select(F.col("whitened").alias("x")), k, lambda y: y, tile)
    return float(np.abs(gram / model.n - np.eye(k)).max())


def whiten_all(vectors: DataFrame, components: int = 32, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, component int, n long, deviation decimal, whitened double, explained double, identity_error double).

    One row for every usable vector and component, from 1 by falling eigenvalue, up to ``components``.
    Entries are taken as whole numbers, floor(64 * c) + 1000000. Vectors that are null, empty, or hold
    null, non-finite or immense (2^56) entries give no rows and take no part in the fit. Vectors of
    another length are a fit list of their own, read in passes of its own. A component of no variance does not exist: equal
    vectors, or a single one, have none and so give no rows. Copies and rows of one id count as often
    as they come, null ids stay, other columns are not read, and an empty table gives no rows.
    """
    parts = []
    for d in lengths(vectors, vector_col):
        model = fit(vectors, d, components, vector_col)
        white = whiten(vectors, model, vector_col, id_col)
        error = identity_error(white, model)
        explained = F.array(*(F.lit(e) for e in model.explained)) if len(model.values) else F.array().cast("array<double>")
        long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        parts.append(
            long.select(
                "vec_id",
                (F.col("at") + 1).cast("int").alias("component"),
                F.lit(model.n).cast("long").alias("n"),
                "deviation",
                "whitened",
                explained[F.col("at")].alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            )
        )
    if not parts:
        id_type = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
