"""Whitening against numpy and exact integers."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import whiten


def _frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n long, component string, x string, whitened double, tile int, block long")


def _odd(i, v):
    return (i, v, 3, "c", "x", 0.5, 1, 2)


def _check(got, vectors, k=32):
    """``vectors``: (id, list of floats) of one length that all take part."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    rank = min(k, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * rank
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    white, true = [], []
    for (i, _), row, c in zip(vectors, x, centred):
        mine = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, rank + 1))
        assert {r.n for r in mine} == {n} and {r.deviation for r in mine} == {sum((n * a - s) ** 2 for a, s in zip(row, sums))}
        assert np.allclose([r.explained for r in mine], values[:rank] / np.trace(cov), rtol=1e-8)
        white.append([r.whitened for r in mine])
        true.append(c)
    white, true = np.array(white), np.array(true)
    error = np.abs(white.T @ white / n - np.eye(rank)).max()
    assert error < 1e-7 and {r.identity_error for r in got} == {got[0].identity_error} and abs(got[0].identity_error - error) < 1e-9
    # The projection is linear in the centred vectors, along unit eigenvectors.
    axes = np.linalg.lstsq(true, white * np.sqrt(values[:rank]), rcond=None)[0]
    inside = cov @ axes
    assert np.allclose(inside, axes * values[:rank], atol=1e-6 * values[0])


@pytest.mark.parametrize(("d", "tile", "parts"), [(13, 5, 7), (40, 32, 3), (4, 32, 1), (33, 1, 2)])
def test_components_deviations_and_identity(spark, d, tile, parts):
    rng = np.random.default_rng(d)
    data = rng.standard_normal((90, d)) @ rng.standard_normal((d, d)) + rng.standard_normal(d) * 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    frame = _frame(spark, [_odd(*r) for r in rows]).repartition(parts)
    model = whiten.fit(frame, d, tile=tile)
    again = whiten.fit(frame.repartition(2), d, tile=max(1, tile // 2))
    assert model.sums == again.sums and np.array_equal(model.values, again.values) and np.array_equal(model.vectors, again.vectors)
    _check(whiten.whiten_all(frame).collect(), rows)


def test_rows_without_a_vector_and_other_lengths(spark):
    rng = np.random.default_rng(1)
    long = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    short = [(100 + i, rng.standard_normal(2).tolist()) for i in range(9)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (203, [float("nan")] * 6), (204, [float("inf"), 0.0]), (205, [1e300, 0.0])]
    out = whiten.whiten_all(_frame(spark, [_odd(*r) for r in long + short + bad], "double"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    _check([r for r in got if r.vec_id < 100], long)
    _check([r for r in got if r.vec_id >= 100], short)


def test_copies_null_ids_and_no_variance(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, [3.0, 1.0])]
    got = whiten.whiten_all(_frame(spark, [_odd(*r) for r in rows])).collect()
    # Two distinct vectors have one component; each stands one deviation from the mean.
    assert sorted((r.vec_id is None, r.component, abs(round(r.whitened, 9))) for r in got) == [(False, 1, 1.0)] * 3 + [(True, 1, 1.0)]
    assert all(r.n == 4 and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)
    same = _frame(spark, [_odd(i, [0.5, 0.25, 0.125]) for i in range(5)])
    assert whiten.whiten_all(same).count() == 0
    assert whiten.whiten_all(_frame(spark, [_odd(1, [0.5])])).count() == 0
    assert whiten.whiten_all(same.limit(0)).count() == 0
    assert whiten.whiten_all(_frame(spark, [_odd(1, None)])).count() == 0


def test_large_entries_have_exact_deviations(spark):
    rows = [(i, [float(2**40 * (i % 7)), float(i)]) for i in range(50)]
    out = whiten.whiten_all(_frame(spark, [_odd(*r) for r in rows], "double"))
    x = [[64 * int(a) + 1_000_000 for a in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((50 * a - s) ** 2 for a, s in zip(row, sums)) for i, row in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in out.where("component = 1").collect()} == want
    assert max(want.values()) > 2**63


def test_tiles_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(whiten, "SENT", 1)
    x = spark.range(300).select(F.array(*((F.col("id") * k % 11).cast("long") for k in range(7))).alias("x"))
    data = np.array([[i * k % 11 for k in range(7)] for i in range(300)])
    assert np.array_equal(whiten.tiled_gram(x, 7, lambda y: y, 2), data.T @ data)
