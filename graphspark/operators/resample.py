"""Resampling tests: a cell's values become one bounded group of an Arrow function.

A cell is what one test looks at; cells run in parallel. Values are summed by cluster before the
shuffle, so a group has a row a cluster, not a row a response.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cluster_sums(joined: DataFrame, cell: Sequence[str], cluster: str, a: str, b: str) -> DataFrame:
    d = F.col(b).cast("double") - F.col(a).cast("double")
    return joined.groupBy(*cell, cluster).agg(F.sum(d).alias("d"), F.count(F.lit(1)).alias("n"), F.sum((d != 0).cast("int")).alias("changed"))


def sign_flip_test(joined: DataFrame, cell: Sequence[str], cluster: str, a: str, b: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(cell, delta, p, clusters): a cluster's differences flip sign together.

    All sign patterns are summed up to 20 clusters, then p has no add-one; beyond, seeded draws with
    one added to both counts.
    """
    sums = _cluster_sums(joined, cell, cluster, a, b)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(cluster)["d"].to_numpy()
        total = pdf["n"].sum()
        seen = abs(d.sum())
        m = len(d)
        if m <= 20:
            out = np.zeros(1)
            for x in d:
                out = np.concatenate([out + x, out - x])
            p = float((np.abs(out) >= seen - 1e-12).mean())
        else:
            rng = np.random.default_rng(seed)
            hits = 0
            for lo in range(0, draws, 256):
                signs = rng.integers(0, 2, (min(256, draws - lo), m)) * 2 - 1
                hits += int((np.abs(signs @ d) >= seen - 1e-12).sum())
            p = (hits + 1) / (draws + 1)
        return pd.DataFrame([(*key, float(d.sum() / total), p, m)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*cell).schema) + ", delta double, p double, clusters long"
    return sums.groupBy(*cell).applyInPandas(run, schema)


def cluster_bootstrap(joined: DataFrame, cell: Sequence[str], cluster: str, a: str, b: str, draws: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(cell, delta, low, high): percentile interval over resampled clusters; null under 10 changes."""
    sums = _cluster_sums(joined, cell, cluster, a, b)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        d, n = pdf["d"].to_numpy(), pdf["n"].to_numpy()
        delta = float(d.sum() / n.sum())
        if pdf["changed"].sum() < 10:
            return pd.DataFrame([(*key, delta, None, None)])
        rng = np.random.default_rng(seed)
        stats = np.empty(draws)
        for i in range(draws):
            pick = rng.integers(0, len(d), len(d))
            stats[i] = d[pick].sum() / n[pick].sum()
        stats.sort()
        low, high = int(alpha / 2 * draws), min(draws - 1, int((1 - alpha / 2) * draws))
        return pd.DataFrame([(*key, delta, float(stats[low]), float(stats[high]))])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*cell).schema) + ", delta double, low double, high double"
    return sums.groupBy(*cell).applyInPandas(run, schema)
