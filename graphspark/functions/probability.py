"""Exact tests and intervals as column expressions over counts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binomial_two_sided(b: Column, c: Column) -> Column:
    """The exact two-sided binomial p of b against c at one half: McNemar's test; 1 without either."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    start = F.struct((-n * math.log(2.0)).cast("double").alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        start,
        lambda s, i: F.struct(
            (s["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum")
        ),
        lambda s: s["sum"],
    )
    return F.when((n == 0) | (b == c), 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def _tail_at_least(k: int, n: int, p: float) -> float:
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _invert(fn, target: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fn(mid) < target else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact interval of a share of k in n."""
    low = 0.0 if k == 0 else _invert(lambda p: _tail_at_least(k, n, p), alpha / 2)
    high = 1.0 if k == n else _invert(lambda p: _tail_at_least(k + 1, n, p), 1 - alpha / 2)
    return low, high


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def exact_paired_interval(b: pd.Series, c: pd.Series, n: pd.Series) -> pd.DataFrame:
    """The exact conditional interval of (c - b) / n, from that of c in b + c; null without either."""
    out = []
    for bb, cc, nn in zip(b, c, n):
        m = int(bb + cc)
        if m == 0 or nn == 0:
            out.append((None, None))
            continue
        low, high = clopper_pearson(int(cc), m)
        out.append(((2 * low - 1) * m / nn, (2 * high - 1) * m / nn))
    return pd.DataFrame(out, columns=["low", "high"])


def mde_points(discordance: Column, n: Column) -> Column:
    """Percentage points that a paired comparison of n detects at 80 % power and 5 %."""
    return 100 * (1.959964 + 0.841621) * F.sqrt(discordance / n)


def required_pairs(delta: Column, discordance: Column) -> Column:
    """Pairs that detect ``delta`` (a share) at that power."""
    return F.ceil(discordance * (1.959964 + 0.841621) ** 2 / (delta * delta))
