from __future__ import annotations

from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphspark.operators import planning, solver


def test_peel_agrees_with_all_realisations():
    peel = solver.peeled_neighbours.func
    for n in (1, 2, 3, 4, 5):
        pairs = list(combinations(range(n), 2))
        by_degrees: dict[tuple, list] = {}
        for mask in range(1 << len(pairs)):
            es = [e for i, e in enumerate(pairs) if mask >> i & 1]
            d = tuple(sum(x in e for e in es) for x in range(n))
            by_degrees.setdefault(d, []).append(es)
        for d, graphs in by_degrees.items():
            for t in range(n):
                got = peel(pd.Series([list(range(n))]), pd.Series([list(d)]), pd.Series([t]))[0]
                lists = {", ".join(str(x) for x in range(n) if tuple(sorted((x, t))) in es) or "No nodes" for es in graphs}
                if got is not None:
                    assert lists == {got}
                if len(graphs) == 1:
                    assert got is not None


def test_rungs_bands_and_ids(spark):
    rows = planning.rungs(spark)
    assert rows.count() == 18 and planning.feasible(rows, 8192, 512).count() == rows.where("tokens * 2 <= 7680").count()
    acc = spark.createDataFrame([("m", 40, 8, 0.5), ("m", 300, 8, 0.5), ("m", 80, 4, 0.95)], "model string, n int, mean_degree int, accuracy double")
    limits = spark.createDataFrame([("m", 3000)], "model string, reading_limit int")
    got = {(r.n, r.mean_degree): (r.band, r.valid) for r in planning.model_bands(rows, acc, limits).collect()}
    assert got == {(40, 8): ("informative", True), (300, 8): ("informative", False), (80, 4): ("ceiling", False)}
    ids = spark.createDataFrame([("node_degree/size40/p0.2/s500000/7",), ("cycle_check/12",)], "i string")
    parts = [r.p for r in ids.select(planning.instance_parts(F.col("i")).alias("p")).collect()]
    assert tuple(parts[0]) == ("node_degree", 40, 0.2, 500000, 7) and tuple(parts[1]) == ("cycle_check", None, None, None, 12)


def test_yes_no_and_gains(spark):
    rows = spark.createDataFrame([("Yes.", "yes it is"), ("No.", "No\nyes"), ("No.", "yes or no"), ("Yes.", "maybe")], "t string, p string")
    r = planning.yes_no_metrics(rows, "t", "p").first()
    assert (r.accuracy, r.ambiguous, r.indeterminate) == (0.5, 0.25, 0.25)
    with pytest.raises(Exception, match="unclear target"):
        planning.yes_no_metrics(spark.createDataFrame([("maybe", "yes")], "t string, p string"), "t", "p").collect()
    bars = spark.createDataFrame([("a", "none", 0.1), ("a", "degree", 0.9), ("b", "none", 0.5), ("b", "degree", 0.52)], "task string, condition string, bar double")
    assert {r.task: r.offers for r in planning.route_gains(bars).collect()} == {"a": True, "b": False}


def test_screen(spark):
    row = planning.screen(spark, 12, 4, graphs=2).withColumn("v", planning.verdict()).first()
    assert 0 < row.modal_share <= 1 and row.v.split(":")[0] in ("pass", "fail")
