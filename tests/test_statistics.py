from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.operators import inference, solver, statistics


def _pairs(spark, counts, stratum=0, gold=0):
    rows = [(a, b, stratum, gold) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "correct_a int, correct_b int, density int, gold int")


def test_effects_and_intervals(spark):
    df = _pairs(spark, {(0, 0): 30, (0, 1): 25, (1, 0): 5, (1, 1): 40}).unionByName(_pairs(spark, {(0, 1): 5, (1, 1): 15}, 1))
    r = statistics.effects(df, [], ["density"], draws=4000).first()
    assert (r.n, r.broke, r.fixed) == (120, 5, 30) and math.isclose(r.delta, 100 * 25 / 120)
    # Within strata a pair's change has these variances; the interval is about two of the sum's deviations.
    var = 100 * (0.3 - 0.2**2) + 20 * (0.25 - 0.25**2)
    half = 1.96 * 100 * math.sqrt(var) / 120
    assert abs((r.high - r.low) / 2 - half) < 0.1 * half and r.low < r.delta < r.high
    same = statistics.equivalent(_pairs(spark, {(0, 0): 3000, (1, 1): 3000, (0, 1): 10, (1, 0): 10}), [], ["density"], draws=500).first()
    assert same.equivalent and same.low > -3


def test_balanced_change_against_all_swaps(spark):
    yes, no = [(0, 1), (1, 0), (0, 1), (1, 1), (0, 1)], [(1, 0), (0, 0), (0, 1), (1, 1)]
    rows = [(a, b, 1) for a, b in yes] + [(a, b, 0) for a, b in no]
    df = spark.createDataFrame(rows, "correct_a int, correct_b int, gold int")
    r = statistics.balanced_effects(df, [], "gold").first()

    def change(signs):
        d = [s * (b - a) for s, (a, b, _) in zip(signs, rows)]
        return 50 * (sum(d[:5]) / 5 + sum(d[5:]) / 4)

    seen = change([1] * 9)
    all_ = [change(s) for s in itertools.product([1, -1], repeat=9)]
    assert math.isclose(r.delta, seen) and math.isclose(r.p, np.mean([abs(x) >= abs(seen) - 1e-9 for x in all_]))


def test_label_permutation_against_all_orders(spark):
    values, labels = [1.0, 2.0, 2.0, 5.0, 7.0, 9.0], [0, 0, 1, 0, 1, 1]
    df = spark.createDataFrame([("g", v, x) for v, x in zip(values, labels)], "g string, v double, x int")
    r = statistics.label_permutation(df, [], ["g"], "x", "v", draws=20_000).first()
    gap = lambda chosen: np.mean([values[i] for i in chosen]) - np.mean([values[i] for i in range(6) if i not in chosen])
    seen = gap([2, 4, 5])
    exact = np.mean([abs(gap(c)) >= abs(seen) - 1e-12 for c in itertools.combinations(range(6), 3)])
    assert math.isclose(r.gap, seen) and abs(r.p - exact) < 0.02
    assert statistics.two_sample_permutation(df, ["g"], "x", "v", draws=100).first().gap == r.gap


def test_trend(spark):
    rng = np.random.default_rng(0)
    rows = [(float(x), int(rng.random() < 0.1 + 0.25 * x)) for x in (0, 1, 2, 3) for _ in range(60)]
    df = spark.createDataFrame(rows, "x double, v int")
    r = statistics.trend(df, [], "x", "v", draws=200).first()
    assert math.isclose(r.slope, np.polyfit([a for a, _ in rows], [b for _, b in rows], 1)[0], rel_tol=1e-9)
    assert r.p_slope < 0.02 and r.p_between < 0.02


def test_power_of_the_sign_test(spark):
    df = _pairs(spark, {(0, 0): 40, (1, 1): 40, (0, 1): 10, (1, 0): 10})
    r = statistics.detectable_effect(df, []).first()
    share = 0.5 + r.mde * r.n / (2 * r.changed)
    p = [min(1.0, 2 * sum(math.comb(20, i) for i in range(min(k, 20 - k) + 1)) / 2**20) for k in range(21)]
    power = sum(math.comb(20, k) * share**k * (1 - share) ** (20 - k) for k in range(21) if p[k] <= 0.05)
    assert abs(power - 0.8) < 1e-6
    n = spark.range(1).select(statistics.required_pairs(F.lit(0.1), F.lit(0.2), F.lit(0.8)).alias("n")).first().n
    assert 120 < n < 260


def test_power_of_millions_of_pairs():
    """As exact sums say for a few pairs; for millions as the normal law says, in a blink."""
    for k, share in ((1, 0.9), (6, 1.0), (21, 0.7), (400, 0.57)):
        p = [min(1.0, 2 * sum(math.comb(k, i) for i in range(min(w, k - w) + 1)) / 2**k) for w in range(k + 1)]
        power = sum(math.comb(k, w) * share**w * (1 - share) ** (k - w) for w in range(k + 1) if p[w] <= 0.05)
        assert math.isclose(statistics._power(k, share, 0.05), power, rel_tol=1e-9, abs_tol=1e-12)
    began = time.time()
    for k in (3_000_000, 300_000_000):
        shift = 2 * math.sqrt(k) * 0.0014
        normal = 0.5 * math.erfc((1.959964 - shift) / math.sqrt(2)) + 0.5 * math.erfc((1.959964 + shift) / math.sqrt(2))
        assert abs(statistics._power(k, 0.5014, 0.05) - normal) < 2e-3
    assert time.time() - began < 5


def test_distributions(spark):
    one = spark.range(1).select(
        statistics.fisher_exact(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("f"), statistics.binomial_greater(F.lit(7), F.lit(10), F.lit(0.5)).alias("b"), statistics.correlation_p(F.lit(0.5), F.lit(12)).alias("r"),
        statistics.normal_two_sided(F.lit(1.959964)).alias("z"),
    ).first()
    assert math.isclose(one.f, 34 / 70) and math.isclose(one.b, 176 / 1024) and abs(one.r - 0.0978) < 1e-3 and abs(one.z - 0.05) < 1e-6


def test_rank_statistics(spark):
    rng = np.random.default_rng(1)
    x, label = rng.integers(0, 12, 200), rng.integers(0, 2, 200)
    y = x + rng.integers(0, 9, 200)
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(x, y, label)], "x int, y int, g int")
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == a)) + 1 for a in v])
    r = statistics.spearman(df, [], "x", "y").first()
    assert math.isclose(r.r, np.corrcoef(rank(x), rank(y))[0, 1], rel_tol=1e-9)
    u = statistics.mann_whitney(df, [], "g", "y").first()
    assert math.isclose(u.u, sum((a > b) + 0.5 * (a == b) for a in y[label == 1] for b in y[label == 0])) and 0 <= u.p <= 1


def test_least_squares_with_robust_errors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=80) * (1 + abs(x[:, 0]))
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    got = statistics.ols(df, "y", ["a", "b"])
    m = np.column_stack([np.ones(80), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    e, inv = y - m @ beta, np.linalg.inv(m.T @ m)
    se = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv) * 80 / 77)
    assert np.allclose([g[1] for g in got], beta) and np.allclose([g[2] for g in got], se)
    fit = solver.fit_least_squares(df, [F.col("a"), F.col("b"), F.lit(1.0)], F.col("y"))
    assert np.allclose(fit, [beta[1], beta[2], beta[0]])


def test_route_split_sums_to_the_effect(spark):
    rows = [("x", "x", 0, 1), ("x", "y", 1, 0), ("y", "y", 0, 1), ("x", "y", 0, 1), ("y", "x", 1, 1)]
    df = spark.createDataFrame(rows, "route_a string, route_b string, correct_a int, correct_b int")
    r = statistics.route_split(df, []).first()
    assert math.isclose(r.total, r.switch + r.stay) and math.isclose(r.total, sum(r.by_route.values())) and math.isclose(r.total, 40.0)


@pytest.mark.parametrize("bins", [1, 3, 50])
def test_running_sums_in_bins(spark, bins):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(n)) for g in ("a", "b") for v, n in zip(rng.permutation(60), rng.integers(1, 9, 60))]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(4)
    got = {(r.g, r.v): (r.s, r.next) for r in inference.running_sums(df, "v", {"s": "n"}, ["g"], following="next", bins=bins).collect()}
    for g, v, _ in rows:
        later = [w for h, w, _ in rows if h == g and w > v]
        assert got[g, v] == (sum(n for h, w, n in rows if h == g and w <= v), min(later) if later else None)


def test_cut_is_the_best_split(spark):
    rows = [(1.0, "No"), (2.0, "No"), (2.0, "Yes"), (3.0, "Yes"), (4.0, "No"), (5.0, "Yes"), (None, "Yes")]
    df = spark.createDataFrame(rows, "x double, gold string")
    cut = solver.fit_cut(df, F.col("x"), F.col("gold"))
    right = lambda c: sum((x > c) == (g == "Yes") for x, g in rows if x is not None)
    cuts = [1.5, 2.5, 3.5, 4.5]
    assert cut == max(cuts, key=lambda c: (right(c), -c))
    assert solver.fit_cut(df.where("x = 1"), F.col("x"), F.col("gold")) == 1.0


def test_reconstruction_against_all_graphs():
    n, pairs = 5, list(itertools.combinations(range(5), 2))
    stats = {}
    for mask in range(1 << len(pairs)):
        a = np.zeros((n, n))
        for i, (u, v) in enumerate(pairs):
            a[u, v] = a[v, u] = mask >> i & 1
        d = a.sum(1)
        p = np.divide(a, d[:, None], out=np.zeros_like(a), where=d[:, None] > 0)
        c = np.divide(np.diag(a @ a @ a), d * (d - 1), out=np.zeros(n), where=d > 1)
        said = (tuple(d.astype(int)), tuple(np.round(c, 2)), tuple(np.round(np.diag(p @ p), 2)), tuple(np.round(np.diag(p @ p @ p), 2)))
        stats.setdefault(said, set()).add(solver._listed([int(x) for x in np.flatnonzero(a[0])]))
    answered = 0
    for (d, c, two, three), lists in stats.items():
        got = solver._reconstructed(dict(enumerate(d)), {i: float(x) for i, x in enumerate(c)}, {i: {2: float(two[i]), 3: float(three[i])} for i in range(n)}, 0)
        if got is not None:
            answered += 1
            assert lists == {got}
    assert answered > 0.4 * len(stats)


@pytest.mark.parametrize("seed", range(6))
def test_reconstruction_against_every_set_of_neighbours(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        n = int(rng.integers(5, 9))
        a = np.triu(rng.random((n, n)) < rng.uniform(0.2, 0.8), 1).astype(float)
        a += a.T
        d = a.sum(1).astype(int)
        p = np.divide(a, d[:, None], out=np.zeros_like(a), where=d[:, None] > 0)
        c = np.round(np.divide(np.diag(a @ a @ a), d * (d - 1), out=np.zeros(n), where=d > 1), 2)
        two, three = np.round(np.diag(p @ p), 2), np.round(np.diag(p @ p @ p), 2)
        settled, joined, apart = solver._peel(list(range(n)), d.tolist(), 0)
        if settled or d[0] == 0:
            continue
        fitting = []
        for near in itertools.combinations([v for v in range(1, n) if d[v]], d[0]):
            if not set(joined) <= set(near) or set(apart) & set(near) or abs(sum(1 / d[v] for v in near) - d[0] * two[0]) > 0.005 * d[0] + 1e-9:
                continue
            possible = True
            for j in range(1, n):
                if d[j]:
                    pool = sorted(1 / d[v] for v in range(1, n) if v != j and d[v])
                    k, rest = (d[j] - 1, d[j] * two[j] - 1 / d[0]) if j in near else (d[j], d[j] * two[j])
                    possible &= k <= len(pool) and sum(pool[:k]) - 0.005 * d[j] - 1e-9 <= rest <= sum(pool[len(pool) - k :]) + 0.005 * d[j] + 1e-9
            products = sorted(1 / d[u] / d[v] for u, v in itertools.combinations(near, 2))
            edges = [e for e in range(len(products) + 1) if not products or abs(e / len(products) - c[0]) <= 0.005 + 1e-9]
            half, slack = d[0] * three[0] / 2, 0.0025 * d[0] + 1e-9
            if possible and (d[0] < 2 or any(sum(products[:e]) - slack <= half <= sum(products[len(products) - e :]) + slack for e in edges)):
                fitting.append(solver._listed(near))
        got = solver._reconstructed(dict(enumerate(d.tolist())), dict(enumerate(c.tolist())), {i: {2: float(two[i]), 3: float(three[i])} for i in range(n)}, 0)
        assert fitting and got == (fitting[0] if len(fitting) == 1 else None)


def test_island_posterior(spark):
    answers = spark.createDataFrame([("x", "a", 3), ("x", "b", 1), ("y", "a", 2)], "degrees string, answer string, k int")
    b = solver.island_bounds(answers).first()
    assert b.rows == 6 and math.isclose(b.determined, 2 / 6) and math.isclose(b.bayes, 5 / 6)
    said = spark.createDataFrame([("x", "b"), ("y", "a")], "degrees string, said string")
    r = solver.island_posterior(answers, said).first()
    assert math.isclose(r.rule, 3 / 6) and r.worst_excess <= 0
