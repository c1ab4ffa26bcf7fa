"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``.

    Only where neither that setting nor a context-level folder exists does this set one, under the
    warehouse, which executors share by definition.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        if chosen is None:
            chosen = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(chosen)
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder and forget how it was made.

    Shuffle files and older checkpoints that nothing refers to any more go when the driver collects
    its garbage, which a driver with room seldom does by itself; so that a long job does not fill its
    executors' disks, it is asked to here.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of what nothing refers to any more.

    A table that was handed to ``cut`` is still held while ``cut`` runs; its files can go only after.
    """
    gc.collect()
    spark._jvm.System.gc()


_HELD: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Return what Arrow and the C library hold in reserve to the system, as far as they can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _begin(name: str, leave: Callable[[], None] | None) -> None:
    for other in [n for n in _HELD if n != name]:
        _HELD.pop(other)()
    if leave is not None:
        _HELD[name] = leave


def in_worker(name: str, run: Callable, end: Callable[[], None] | None = None, leave: Callable[[], None] | None = None) -> Callable:
    """``run`` for mapInArrow, which leaves no more in a worker than it found.

    Workers are used again by later tasks and stages. ``end`` is called after every task, and is to
    forget what the task has remembered; ``leave`` when another operator begins in the worker, and
    is to drop tables that ``name``'s tasks share. Both must be functions of a module, or else they
    work on copies that travel with the task.
    """

    def bounded(batches):
        _begin(name, leave)
        # A task makes many containers and no cycles to speak of; what there is goes at its end.
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if end is not None:
                end()
            gc.enable()
            _give_back()

    return bounded


def sorted_groups(
    batches: Iterable[pa.RecordBatch], key: str
) -> Iterator[tuple[int, pa.Table]]:
    """Split batches already sorted by the integer column ``key`` into one table per key.

    Holds one group and one batch at a time.
    """
    held: list[pa.RecordBatch] = []
    held_key: int | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(keys)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            k = int(keys[lo])
            if held and k != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = k
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


class Forest:
    """Union-find over arbitrary integer labels; the smaller label is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.find(a), self.find(b)
        if ra == rb:
            return False
        if ra > rb:
            ra, rb = rb, ra
        self.up[rb] = ra
        return True

    def edges(self) -> tuple[list[int], list[int]]:
        """One (member, root) pair for each member that is not its own root."""
        members = [x for x in self.up if self.find(x) != x]
        return members, [self.find(x) for x in members]
