from __future__ import annotations

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphspark.operators import draws, statistics


def _word(unit, label, k):
    return int(hashlib.md5(f"{unit}{label}{k // 8}".encode()).hexdigest()[4 * (k % 8) : 4 * (k % 8) + 4], 16)


def _weight(unit, draw):
    return sum(_word(unit, ":", draw) >= s for s in draws.STEPS)


def test_weights_are_poisson_counts_of_a_hash(spark):
    got = spark.range(600).select("id", draws.weights(F.col("id"), 20).alias("w")).collect()
    assert all(r.w == [_weight(r.id, k) for k in range(20)] for r in got[:40])
    flat = np.array([r.w for r in got])
    assert abs(flat.mean() - 1) < 0.03 and abs(flat.var() - 1) < 0.06
    # Draws of one unit, and units of one draw, are independent.
    assert abs(np.corrcoef(flat.T)[np.triu_indices(20, 1)]).max() < 0.2


def test_resampled_sums_and_interval_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(f"c{i % 3}", rng.randrange(25), rng.randrange(3), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "cell string, unit long, x int, y double")
    got = {(r.cell, r.draw): (r.x, r.y) for r in draws.resampled(df, ["cell"], "unit", {"x": F.col("x"), "y": F.col("y")}, 40).collect()}
    want = {}
    for cell, unit, x, y in rows:
        for k in range(40):
            if w := _weight(unit, k):
                a, b = want.get((cell, k), (0, 0.0))
                want[cell, k] = (a + w * x, b + w * y)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)
    ci = {r.cell: (r.low, r.high) for r in draws.interval(draws.resampled(df, ["cell"], "unit", {"x": F.col("x")}, 40), ["cell"], F.col("x")).collect()}
    for cell, (low, high) in ci.items():
        assert np.allclose((low, high), np.percentile([v[0] for (c, _), v in want.items() if c == cell], [2.5, 97.5]))


def test_halves_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(i % 2, u, rng.randrange(2)) for i in range(2) for u in range(30)]
    df = spark.createDataFrame(rows, "cell int, unit long, x int")
    got = draws.halves(df, ["cell"], "unit", {"x": F.col("x")}, 37).collect()
    assert sorted((r.cell, r.split) for r in got) == sorted(itertools.product((0, 1), range(37)))
    for r in got:
        first = [x for c, u, x in rows if c == r.cell and _word(u, "/", r.split // 16) >> (r.split % 16) & 1]
        total = [x for c, _, x in rows if c == r.cell]
        assert (r.n1, r.x1, r.n2, r.x2) == (len(first), sum(first), len(total) - len(first), sum(total) - sum(first))
    assert abs(np.mean([r.n1 for r in got]) - 15) < 1.5


def test_an_interval_covers_what_it_should(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{c}", c * 1000 + u, float(x)) for c in range(120) for u, x in enumerate(rng.normal(1.0, 1.0, 60))]
    drawn = draws.resampled(spark.createDataFrame(rows, "cell string, unit long, x double"), ["cell"], "unit", {"x": F.col("x"), "n": F.lit(1)}, 160)
    ci = draws.interval(drawn, ["cell"], F.col("x") / F.col("n")).collect()
    assert 0.86 <= np.mean([r.low <= 1.0 <= r.high for r in ci]) <= 0.99


@pytest.mark.parametrize("seed", range(4))
def test_tail_of_unequal_chances_against_all_outcomes(seed):
    rng = random.Random(seed)
    chances = [rng.choice([0.0, 1.0, 0.25, rng.random()]) for _ in range(12)]
    law = np.zeros(13)
    for hits in itertools.product((0, 1), repeat=12):
        law[sum(hits)] += math.prod(q if h else 1 - q for q, h in zip(chances, hits))
    q, n = np.unique(chances, return_counts=True)
    for k in range(14):
        assert math.isclose(statistics.poisson_binomial_tail(q, n, k), law[k:].sum(), abs_tol=1e-12)


def test_hits_by_chance(spark):
    rows = pd.DataFrame({"g": ["a"] * 40 + ["b"] * 3, "q": [0.1] * 20 + [0.5] * 20 + [0.2, None, 0.0], "h": [True] * 17 + [False] * 26})
    got = {r.g: r for r in statistics.hits_by_chance(spark.createDataFrame(rows), ["g"], "q", "h").collect()}
    ten, half = (np.array([math.comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(21)]) for p in (0.1, 0.5))
    assert got["a"].hits == 17 and math.isclose(got["a"].expected, 12) and math.isclose(got["a"].p, np.convolve(ten, half)[17:].sum())
    assert got["b"].n == 2 and got["b"].p == 1.0
