"""Effects, intervals and tests over counts: whatever can be counted first is, so that a test's data is a
few numbers a stratum however many rows it looks at.

A paired 0/1 value has four patterns, a permuted label a count at each value. Resampling rows then is
drawing counts, and many permutation distributions have a closed form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.functions.probability import binomial_two_sided
from graphspark.operators.inference import running_sums, with_q

PATTERNS = ("n00", "n01", "n10", "n11")


def _schema(rows: DataFrame, cell: Sequence[str], more: str) -> str:
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*cell).schema]
    return ", ".join([*kept, more])


def _grouped(rows: DataFrame, cell: Sequence[str], run: Callable[[pd.DataFrame], dict], more: str) -> DataFrame:
    """One row of ``run`` for each cell of already counted ``rows``."""
    names = [f.split()[0] for f in more.split(", ")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        return pd.DataFrame([(*key, *(out.get(n) for n in names))], columns=[*cell, *names])

    if not cell:
        rows, cell = rows.withColumn("_all", F.lit(0)), ["_all"]
        return rows.groupBy("_all").applyInPandas(one, _schema(rows, cell, more)).drop("_all")
    return rows.groupBy(*cell).applyInPandas(one, _schema(rows, cell, more))


def patterns(joined: DataFrame, group: Sequence[str], value: str = "correct") -> DataFrame:
    """(group, n00, n01, n10, n11): pairs by the value under the control and under the condition."""
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    return joined.groupBy(*group).agg(*(F.sum(((a == int(p[1])) & (b == int(p[2]))).cast("long")).alias(p) for p in PATTERNS))


def effects(joined: DataFrame, cell: Sequence[str], strata: Sequence[str], value: str = "correct", draws: int = 2000, seed: int = 0, percentiles: tuple[float, float] = (2.5, 97.5)) -> DataFrame:
    """(cell, n, delta, low, high, broke, fixed, p): paired change in points with an interval.

    Pairs are resampled within strata: of a stratum only its four pattern counts matter, and a
    resample of them is a multinomial draw. Cells are drawn from streams of their own.
    """
    counted = patterns(joined, [*cell, *strata], value)

    def run(pdf: pd.DataFrame) -> dict:
        c = pdf.sort_values(list(strata))[list(PATTERNS)].to_numpy(np.int64) if strata else pdf[list(PATTERNS)].to_numpy(np.int64)
        n = c.sum()
        rng = np.random.default_rng([seed, *c.sum(0).tolist()])
        change = np.zeros(draws)
        for row in c[c.sum(1) > 0]:
            drawn = rng.multinomial(row.sum(), row / row.sum(), draws)
            change += drawn[:, 1] - drawn[:, 2]
        low, high = np.percentile(100 * change / n, percentiles)
        return {"n": int(n), "delta": float(100 * (c[:, 1] - c[:, 2]).sum() / n), "low": float(low), "high": float(high), "broke": int(c[:, 2].sum()), "fixed": int(c[:, 1].sum())}

    out = _grouped(counted, cell, run, "n long, delta double, low double, high double, broke long, fixed long")
    return out.withColumn("p", binomial_two_sided(F.col("broke"), F.col("fixed")))


def equivalent(joined: DataFrame, cell: Sequence[str], strata: Sequence[str], within: float = 3.0, **how) -> DataFrame:
    """``effects`` with a 90 % interval, and whether that lies within so many points of none."""
    out = effects(joined, cell, strata, percentiles=(5.0, 95.0), **how)
    return out.withColumn("equivalent", (F.round("low", 6) > -within) & (F.round("high", 6) < within))


def _sign_sums(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and chances of the sum of k fair signs."""
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(k + 1) - math.lgamma(x + 1) - math.lgamma(k - x + 1) for x in i]) - k * math.log(2)
    return 2 * i - k, np.exp(logs)


def balanced_effects(joined: DataFrame, cell: Sequence[str], gold: str, value: str = "correct") -> DataFrame:
    """(cell, n, delta, p): paired change of balanced accuracy in points.

    Under the null each pair's two values may swap; only the pairs that differ move, so the change is
    a sum of fair signs on the yes rows and one on the no rows, and p is exact.
    """
    counted = patterns(joined, [*cell, gold], value)

    def run(pdf: pd.DataFrame) -> dict:
        halves = [(int(r["n01"]), int(r["n10"]), int(sum(r[p] for p in PATTERNS))) for _, r in pdf.sort_values(gold).iterrows()]
        halves = [h for h in halves if h[2]]
        if len(halves) != 2:
            return {"n": int(sum(h[2] for h in halves))}
        delta = sum(50 * (up - down) / n for up, down, n in halves)
        (x, p), (y, q) = (_sign_sums(up + down) for up, down, _ in halves)
        # Both sums ascend: for each value of one, the other must lie beyond a bound on either side.
        x, y, far = 50 * x / halves[0][2], 50 * y / halves[1][2], abs(delta) - 1e-9
        upto = np.concatenate([[0.0], np.cumsum(q)])
        below, above = np.searchsorted(y, -far - x, "right"), np.searchsorted(y, far - x, "left")
        tail = np.where(below >= above, upto[-1], upto[below] + upto[-1] - upto[above])
        return {"n": sum(h[2] for h in halves), "delta": float(delta), "p": float(min(1.0, (p * tail).sum()))}

    return _grouped(counted, cell, run, "n long, delta double, p double")


def _one_of(chance: float, times: int) -> np.ndarray:
    """The chances of 0, 1, ... hits in so many trials of one chance: powers by squaring, then a product."""
    out, power = np.ones(1), np.array([1 - chance, chance])
    while times:
        if times & 1:
            out = np.convolve(out, power)
        times >>= 1
        if times:
            power = np.convolve(power, power)
    return out


def poisson_binomial_tail(chances: np.ndarray, times: np.ndarray, hits: int) -> float:
    """The chance of ``hits`` or more in independent trials of unequal chances, exact to double precision.

    ``times`` says how many trials have each chance. What is certain is counted, not convolved.
    """
    keep = (chances > 0) & (chances < 1) & (times > 0)
    hits -= int(times[chances >= 1].sum())
    if hits <= 0:
        return 1.0
    parts = sorted((_one_of(float(q), int(n)) for q, n in zip(chances[keep], times[keep])), key=len)
    while len(parts) > 1:  # the two shortest first
        a, b = parts.pop(0), parts.pop(0)
        parts.append(np.convolve(a, b))
        parts.sort(key=len)
    law = parts[0] if parts else np.ones(1)
    return float(min(1.0, law[hits:].sum())) if hits < len(law) else 0.0


def hits_by_chance(rows: DataFrame, group: Sequence[str], chance: str, hit: str) -> DataFrame:
    """(group, n, hits, expected, p): how many hits, how many by chance, and the chance of as many or more.

    Each row has a chance of its own; rows of one chance are counted before they come together, and
    the sum's law is the product of theirs. Rows without a chance are left out.
    """
    counted = rows.where(F.col(chance).isNotNull() & ~F.isnan(F.col(chance).cast("double"))).groupBy(*group, F.col(chance).cast("double").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(hit).cast("long")).alias("_k"))

    def run(pdf: pd.DataFrame) -> dict:
        q, n, k = pdf["_q"].to_numpy(), pdf["_n"].to_numpy(np.int64), int(pdf["_k"].sum())
        return {"n": int(n.sum()), "hits": k, "expected": float((q * n).sum()), "p": poisson_binomial_tail(q, n, k)}

    return _grouped(counted, group, run, "n long, hits long, expected double, p double")


def label_permutation(rows: DataFrame, cell: Sequence[str], group: Sequence[str], label: str, value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(cell, gap, p): difference of means by a 0/1 label, labels permuted within groups.

    A permutation only changes how many labels each value of a group has, so it is drawn from the
    hypergeometric distribution of those counts; rows are counted before they are dealt out.
    """
    counted = rows.groupBy(*cell, *group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_k"))

    def run(pdf: pd.DataFrame) -> dict:
        pdf = pdf.dropna(subset=["_v", "_k"]).sort_values([*group, "_v"])
        n, k, v = (pdf[c].to_numpy() for c in ("_n", "_k", "_v"))
        ones, all_, total = k.sum(), n.sum(), float((n * v).sum())
        if ones == 0 or ones == all_:
            return {}
        gap = lambda s: s / ones - (total - s) / (all_ - ones)
        seen, sums = gap(float((k * v).sum())), np.zeros(draws)
        rng = np.random.default_rng([seed, int(all_), int(ones)])
        parts = pdf.groupby(list(group), sort=False).indices.values() if group else [np.arange(len(pdf))]
        for at in parts:
            if k[at].sum():
                sums += rng.multivariate_hypergeometric(n[at].astype(np.int64), int(k[at].sum()), draws, method="marginals") @ v[at]
        return {"gap": float(seen), "p": float(((np.abs(gap(sums)) >= abs(seen) - 1e-12).sum() + 1) / (draws + 1))}

    return _grouped(counted, cell, run, "gap double, p double")


def two_sample_permutation(rows: DataFrame, cell: Sequence[str], label: str, value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(cell, gap, p) of two unpaired groups told apart by a 0/1 label."""
    return label_permutation(rows, cell, [], label, value, draws, seed)


def trend(rows: DataFrame, cell: Sequence[str], level: str, value: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """(cell, slope, between, p_slope, p_between): does a value move with a numeric level?

    The slope of level means by least squares over rows, the sum of squares between levels, and for
    both the share of permutations of levels over rows that reach as far.
    """
    counted = rows.groupBy(*cell, F.col(level).cast("double").alias("_x"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))

    def run(pdf: pd.DataFrame) -> dict:
        table = pdf.dropna().pivot_table(index="_x", columns="_v", values="_n", aggfunc="sum", fill_value=0)
        c, x, v = table.to_numpy(np.int64), table.index.to_numpy(float), table.columns.to_numpy(float)
        if len(x) < 2 or c.sum() < 3:
            return {}
        m = c.sum(1)
        mean = (c.sum(0) * v).sum() / m.sum()
        dx = x - (m * x).sum() / m.sum()

        def both(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return (s * dx).sum(-1) / (m * dx * dx).sum(), (m * (s / m - mean) ** 2).sum(-1)

        slope, between = both(c @ v)
        rng = np.random.default_rng([seed, *m.tolist()])
        # All draws together: a level takes its rows from what is left, one value after another.
        left, sums = np.tile(c.sum(0), (draws, 1)), np.zeros((draws, len(x)))
        for i, size in enumerate(m):
            want, rest = np.full(draws, size), left.sum(1)
            for k, value in enumerate(v):
                rest = rest - left[:, k]
                got = rng.hypergeometric(left[:, k], rest, want) if rest.any() or want.any() else np.zeros(draws, np.int64)
                left[:, k] -= got
                want = want - got
                sums[:, i] += got * value
        slopes, squares = both(sums)
        p = lambda hits: float((hits.sum() + 1) / (draws + 1))
        return {"slope": float(slope), "between": float(between), "p_slope": p(np.abs(slopes) >= abs(slope) - 1e-12), "p_between": p(squares >= between - 1e-12)}

    return _grouped(counted, cell, run, "slope double, between double, p_slope double, p_between double")


# --- sign tests, power ---------------------------------------------------------------------------


#: Standard deviations from its mean beyond which a binomial's chances are below the smallest double.
_REACH = 40


def _near_mean(k: int, share: float) -> tuple[int, np.ndarray]:
    """(first, chances) of a binomial count of k, from ``first`` on, as far as a double holds them.

    Ratios of neighbours are summed away from the mode, so that nothing of the size of log k! comes up.
    """
    if share <= 0 or share >= 1:
        return (k if share >= 1 else 0), np.ones(1)
    reach = math.ceil(_REACH * math.sqrt(k * share * (1 - share))) + _REACH**2
    mode = min(k, int((k + 1) * share))
    lo, hi = max(0, mode - reach), min(k, mode + reach)
    i = np.arange(lo, hi, dtype=float)
    steps = np.log((k - i) / (i + 1)) + (math.log(share) - math.log1p(-share))
    logs = np.concatenate([-np.cumsum(steps[: mode - lo][::-1])[::-1], [0.0], np.cumsum(steps[mode - lo :])])
    chances = np.exp(logs)
    return lo, chances / chances.sum()


def _lower_bound(changed: int, alpha: float) -> int:
    """The most wins among ``changed`` differing pairs that the exact sign test rejects as too few; -1 if none are."""
    first, chance = _near_mean(changed, 0.5)
    below = chance[: max(0, (changed + 1) // 2 - first)]
    return first - 1 + int((2 * np.cumsum(below) <= alpha + 1e-12).sum())


def _power(changed: int, share: float, alpha: float, bound: int | None = None) -> float:
    """The chance that the exact sign test rejects if each differing pair is a win with chance ``share``."""
    bound = _lower_bound(changed, alpha) if bound is None else bound
    if bound < 0:
        return 0.0
    first, chance = _near_mean(changed, share)
    return float(chance[: max(0, bound + 1 - first)].sum() + chance[max(0, changed - bound - first) :].sum())


def detectable_effect(joined: DataFrame, cell: Sequence[str], value: str = "correct", power: float = 0.8, alpha: float = 0.05) -> DataFrame:
    """(cell, n, changed, mde): the smallest paired change, as a share, that the exact sign test finds at ``power``.

    The pairs that differ keep their number while more of them become gains. Null where even all
    gains would not do.
    """
    counted = patterns(joined, cell, value)

    def run(pdf: pd.DataFrame) -> dict:
        c = pdf[list(PATTERNS)].to_numpy(np.int64).sum(0)
        n, changed = int(c.sum()), int(c[1] + c[2])
        out = {"n": n, "changed": changed}
        bound = _lower_bound(changed, alpha)
        if changed and _power(changed, 1.0, alpha, bound) >= power:
            lo, hi = 0.5, 1.0
            for _ in range(40):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if _power(changed, mid, alpha, bound) >= power else (mid, hi)
            out["mde"] = float((2 * hi - 1) * changed / n)
        return out

    return _grouped(counted, cell, run, "n long, changed long, mde double")


@F.pandas_udf(T.LongType())
def required_pairs(delta: pd.Series, discordance: pd.Series, power: pd.Series) -> pd.Series:
    """The fewest pairs at which the exact sign test finds a change of ``delta`` (share) at a discordance."""

    def one(d: float, q: float, goal: float) -> int | None:
        if not (0 < abs(d) <= q <= 1):
            return None
        share = 0.5 + abs(d) / (2 * q)
        hi = 1
        while _power(hi, share, 0.05) < goal:
            hi *= 2
            if hi > 1 << 20:
                return None
        lo = hi // 2
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _power(mid, share, 0.05) >= goal else (mid, hi)
        return math.ceil(hi / q)

    return pd.Series([one(*r) for r in zip(delta, discordance, power)], dtype="Int64")


# --- distributions as columns ----------------------------------------------------------------------


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """The two-sided p of a Pearson correlation of n pairs."""

    def one(x, k):
        if x is None or x != x or k is None or k < 3:
            return None
        if abs(x) >= 1:
            return 0.0
        df = k - 2
        return _beta_tail(df / 2, 0.5, 1 - x * x)

    return pd.Series([one(*row) for row in zip(r, n)], dtype="float64")


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """The two-sided p of a 2 x 2 table: all tables of its margins that are no likelier."""

    def one(a, b, c, d):
        a, b, c, d = (int(x) for x in (a, b, c, d))
        top, left, n = a + b, a + c, a + b + c + d
        if n == 0:
            return None
        lo, hi = max(0, left - (c + d)), min(top, left)
        logs = np.array([_log_choose(top, x) + _log_choose(n - top, left - x) for x in range(lo, hi + 1)]) - _log_choose(n, left)
        chance = np.exp(logs)
        return float(min(1.0, chance[chance <= chance[a - lo] * (1 + 1e-7)].sum()))

    return pd.Series([one(*row) for row in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_greater(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """The chance of k or more successes of n at p each."""

    def one(k, n, p):
        if n is None or k is None or p is None or p != p:
            return None
        return 1.0 if k <= 0 else _beta_tail(k, n - k + 1, p)

    return pd.Series([one(*row) for row in zip(k, n, p)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


# --- ranks -----------------------------------------------------------------------------------------


def pearson(rows: DataFrame, cell: Sequence[str], x: str, y: str) -> DataFrame:
    """(cell, n, r, p, slope): correlation, its p, and the slope of y on x; null for a constant."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    got = rows.where(ok).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("r"), F.regr_slope(b, a).alias("slope"))
    return got.withColumn("p", correlation_p("r", "n"))


def _average_ranks(rows: DataFrame, cell: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with the rank of a value, ties sharing their mean; distinct values are ranked, in bins."""
    counts = rows.groupBy(*cell, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, "_v", {"_upto": "_c"}, cell).select(*cell, "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return rows.withColumn("_v", F.col(value).cast("double")).join(ranked, [*cell, "_v"]).drop("_v")


def spearman(rows: DataFrame, cell: Sequence[str], x: str, y: str) -> DataFrame:
    """(cell, n, r, p): the correlation of average ranks."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*cell, x, y)
    ranked = _average_ranks(_average_ranks(ok, cell, x, "_rx"), cell, y, "_ry")
    return pearson(ranked, cell, "_rx", "_ry").drop("slope")


def mann_whitney(rows: DataFrame, cell: Sequence[str], label: str, value: str) -> DataFrame:
    """(cell, n1, n0, u, p): the rank-sum statistic of the labelled rows; normal p with ties and continuity."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*cell, F.col(value).cast("double").alias("_v")).agg(F.sum((F.col(label) == 1).cast("long")).alias("a"), F.sum((F.col(label) == 0).cast("long")).alias("b"))
    run = running_sums(counts, "_v", {"_b": "b"}, cell)
    t = F.col("a") + F.col("b")
    per = run.groupBy(*cell).agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(F.col("a") * (F.col("_b") - F.col("b") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - n1 * n0 / 2) - 0.5, F.lit(0.0)) / sd
    return per.withColumn("p", F.when(sd > 0, normal_two_sided(z))).drop("ties")


def ols(rows: DataFrame, y: str, xs: Sequence[str]) -> list[tuple[str, float, float]]:
    """(term, coefficient, HC1 standard error) of a regression with an intercept, from sums of products."""
    terms = ["const", *xs]
    k = len(terms)
    base = rows.select(F.lit(1.0).alias("const"), *(F.col(x).cast("double").alias(x) for x in xs), F.col(y).cast("double").alias("_y")).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = base.agg(F.count(F.lit(1)), *(F.sum(F.col(terms[i]) * F.col(terms[j])) for i, j in pairs), *(F.sum(F.col(t) * F.col("_y")) for t in terms)).first()
    if got[0] <= k:
        return []

    def square(values: Sequence[float]) -> np.ndarray:
        m = np.zeros((k, k))
        for (i, j), v in zip(pairs, values):
            m[i, j] = m[j, i] = v
        return m

    inverse = np.linalg.pinv(square(got[1 : 1 + len(pairs)]))
    beta = inverse @ np.array(got[1 + len(pairs) :], float)
    e = F.col("_y") - sum((F.col(t) * float(b) for t, b in zip(terms, beta)), F.lit(0.0))
    meat = square(base.agg(*(F.sum(F.col(terms[i]) * F.col(terms[j]) * e * e) for i, j in pairs)).first())
    cov = inverse @ meat @ inverse * got[0] / (got[0] - k)
    return [(t, float(b), float(math.sqrt(max(v, 0.0)))) for t, b, v in zip(terms, beta, np.diag(cov))]


# --- decompositions and flags ----------------------------------------------------------------------


def route_split(joined: DataFrame, cell: Sequence[str], route: str = "route", value: str = "correct") -> DataFrame:
    """(cell, total, switch, stay, by_route): a paired effect in points, split two ways that each sum to it.

    By whether a pair's route changed, and by the condition's route: its share times its accuracy
    less the accuracy without.
    """
    d = F.col(f"{value}_b").cast("double") - F.col(f"{value}_a")
    moved = F.col(f"{route}_a") != F.col(f"{route}_b")
    whole = joined.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg(d)).alias("total"), F.sum(F.when(moved, d).otherwise(0.0)).alias("s"), F.avg(F.col(f"{value}_a").cast("double")).alias("base")
    )
    per = joined.groupBy(*cell, F.col(f"{route}_b").alias("_r")).agg(F.count(F.lit(1)).alias("_k"), F.avg(F.col(f"{value}_b").cast("double")).alias("_acc"))
    both = per.join(whole, list(cell)) if cell else per.crossJoin(F.broadcast(whole))
    part = F.struct(F.col("_r"), (100 * F.col("_k") / F.col("n") * (F.col("_acc") - F.col("base"))).alias("v"))
    parts = both.groupBy(*cell).agg(F.map_from_entries(F.array_sort(F.collect_list(part))).alias("by_route"))
    out = whole.join(parts, list(cell)) if cell else whole.crossJoin(F.broadcast(parts))
    return out.select(*cell, "total", (100 * F.col("s") / F.col("n")).alias("switch"), (F.col("total") - 100 * F.col("s") / F.col("n")).alias("stay"), "by_route")


def log_odds(broke: Column, fixed: Column) -> Column:
    """log(fixed / broken), half a pair added to each: the same at every baseline under one shift of log-odds."""
    return F.log((fixed + 0.5) / (broke + 0.5))


def median_relative_error(rows: DataFrame, group: Sequence[str], predicted: str = "pred", gold: str = "gold") -> DataFrame:
    """(group, error, n): the median of |answer - gold| / gold over numeric answers to a gold other than 0."""
    p, g = F.col(predicted).try_cast("double"), F.col(gold).try_cast("double")
    return rows.where(p.isNotNull() & (g != 0)).groupBy(*group).agg(F.median(F.abs(p - g) / g).alias("error"), F.count(F.lit(1)).alias("n"))


def near_threshold(rows: DataFrame, p: str, draws: int, q: float = 0.05, family: Sequence[str] = ()) -> DataFrame:
    """``rows`` with near_threshold: the step-up threshold of a simulated p lies within its two standard errors."""
    w = Window.partitionBy(*family)
    rank = F.row_number().over(w.orderBy(p))
    line = q * rank / F.count(F.lit(1)).over(w)
    error = F.sqrt(F.col(p) * (1 - F.col(p)) / draws)
    return rows.withColumn("near_threshold", F.abs(F.col(p) - line) <= 2 * error)


def rejected(rows: DataFrame, p: str = "p", q: float = 0.05, family: Sequence[str] = ()) -> DataFrame:
    """``rows`` with reject: the step-up procedure at rate q rejects."""
    return with_q(rows, p, family, "_q").withColumn("reject", F.coalesce(F.col("_q") <= q, F.lit(False))).drop("_q")
