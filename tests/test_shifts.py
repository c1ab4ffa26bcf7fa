from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.operators import shifts


def _long(spark):
    """Pattern ``up`` rises under one condition in three of four arms, ``flat`` never moves."""
    rng, rows = random.Random(1), []
    for arm in ("m0", "m1", "m2", "m3"):
        for g in range(40):
            for c in ("none", "degree", "rwse"):
                up = int(c == "degree" and arm != "m3" and g < 20)
                rows.append((arm, "t", g, c, int(g == 5 and c == "rwse"), rng.randrange(2), up, g % 2, None))
    return spark.createDataFrame(rows, "arm string, task string, graph_id long, condition string, truncated int, exact int, up int, flat int, other int")


def test_shifts_trends_and_associations(spark):
    long = shifts.unpivoted(_long(spark), {"up": ("t",), "flat": ("t",), "other": ("u",)}, ["arm", "task", "graph_id", "condition", "truncated", "exact"])
    assert {r.pattern for r in long.select("pattern").distinct().collect()} == {"up", "flat"}
    found = shifts.pattern_shifts(long, ["graph_id"], ["task", "pattern", "arm"])
    got = {(r.pattern, r.arm, r.condition): r for r in found.collect()}
    assert len(got) == 16
    r = got["up", "m0", "degree"]
    assert (r.n, r.share_none, r.share, r.shift, r.a_only, r.b_only, r.n_fin) == (40, 0.0, 50.0, 50.0, 0, 20, 40)
    assert math.isclose(r.p, 2.0**-19) and math.isclose(r.q, 2.0**-19 * 16 / 3)
    assert got["flat", "m0", "rwse"].q == 1.0 and got["up", "m3", "degree"].shift == 0 and got["up", "m0", "rwse"].n_fin == 39
    trend = shifts.trends(found, ["task", "pattern", "condition"]).collect()
    assert [(t.pattern, t.condition, t.sign, t.with_it, t.others) for t in trend] == [("up", "degree", 1, ["m0", "m1", "m2"], ["m3"])]
    keys = ["task", "pattern", "condition"]
    near = shifts.associations(long, shifts.trends(found, keys), keys).collect()
    assert {(r.arm, r.n_on, r.n_off) for r in near} == {("m0", 20, 20), ("m1", 20, 20), ("m2", 20, 20)}
    ci = {(r.pattern, r.arm, r.condition): r for r in shifts.shift_intervals(long, ["graph_id"], ["task", "pattern", "arm"], "graph_id", 100).collect()}
    assert 20 < ci["up", "m0", "degree"].low < 50 < ci["up", "m0", "degree"].high < 80
    # All arms see the same draws of graphs.
    assert ci["up", "m0", "degree"][3:] == ci["up", "m1", "degree"][3:] and ci["flat", "m0", "degree"].low == 0.0


@pytest.mark.parametrize(
    ("effect", "truncated", "q", "states", "kind"),
    [(9.0, 0.0, 0.01, True, 0), (9.0, 0.0, 0.01, False, 1), (9.0, -5.0, 0.01, True, 2), (9.0, 0.0, 0.2, True, 3), (-1.0, 0.0, 0.2, False, 4), (-3.0, 0.0, 0.2, False, 5), (-8.0, 4.0, 0.01, False, 6), (-8.0, 3.0, 0.01, False, 7), (0.0, 0.0, 1.0, False, 4)],
)
def test_eight_kinds_of_change(spark, effect, truncated, q, states, kind):
    df = spark.createDataFrame([(effect, truncated, q, states)], "e double, t double, q double, s boolean")
    assert df.select(shifts.kind_of_change(F.col("e"), F.col("t"), F.col("q"), F.col("s")).alias("k")).first().k == shifts.KINDS[kind]


def test_slope_with_a_level_for_each_band(spark):
    rng = np.random.default_rng(3)
    rows = [("a", b, float(x), 10.0 * b + 2.0 * float(x) + float(rng.normal(0, 0.3)), f"{b}/{i}") for b in range(3) for i, x in enumerate(rng.uniform(0, 1, 15))]
    rows += [("b", b, float(x), 10.0 * b + float(rng.normal(0, 1)), f"{b}/{i}") for b in range(3) for i, x in enumerate(rng.uniform(0, 1, 15))]
    rows += [("c", b, 1.0, float(b), f"{b}/0") for b in range(3)]
    df = spark.createDataFrame(rows, "cell string, band int, x double, y double, unit string")
    got = {r.cell: r for r in shifts.slope_with_levels(df, ["cell"], "band", "x", "y", "unit").collect()}
    for cell in "ab":
        part = [r for r in rows if r[0] == cell]
        design = np.array([[float(r[1] == b) for b in range(3)] + [r[2]] for r in part])
        assert math.isclose(got[cell].slope, np.linalg.lstsq(design, np.array([r[3] for r in part]), rcond=None)[0][-1], rel_tol=1e-9)
    assert got["a"].p <= 2 / 401 and got["b"].p > 0.02 and got["c"].slope is None
