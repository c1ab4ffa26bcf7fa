from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphspark.operators import runs


def test_generations_alignment_and_noise(spark):
    rows = [("q1", 3, 1, "a"), ("q1", 1, 0, "a"), ("q2", 2, 1, "b"), ("q3", 5, 1, "c"), ("q3", 9, 1, "d"), ("q1", 7, 1, "z")]
    df = runs.generations(spark.createDataFrame(rows, "q string, event int, correct int, response string"), ["q"], "event")
    assert sorted((r.q, r.event, r.generation) for r in df.collect()) == [("q1", 1, 1), ("q1", 3, 2), ("q1", 7, 3), ("q2", 2, 1), ("q3", 5, 1), ("q3", 9, 2)]
    one, two = df.where("generation = 1"), df.where("generation = 2")
    j = runs.aligned(one, two, ["q"], ["correct", "response"])
    floor = runs.noise_floor(j.withColumn("g", F.lit("all")), ["g"]).first()
    assert (floor.n, floor.identical, floor.changed, floor.share) == (2, 1, 1, 50.0)
    assert [r.q for r in runs.unstable(j, ["q"]).collect()] == ["q1"]
    over = runs.unmatched(one.withColumn("g", F.lit(1)), two.withColumn("g", F.lit(1)), ["q", "g"], ["g"]).first()
    assert (over.left_only, over.right_only, over.both) == (1, 0, 2)


def test_contrasts_leave_out_levels_that_are_cut(spark):
    rows = []
    for level, graph, condition in itertools.product((1, 2), range(20), ("none", "degree")):
        cut = int(level == 2 and condition == "degree" and graph < 3)
        rows.append(("m", level, graph, condition, int(condition == "degree" and graph < 8 and not cut), cut))
    df = spark.createDataFrame(rows, "run string, level int, graph int, condition string, correct int, truncated int")
    r = runs.contrasts(df, ["run"], "level", ["graph"], ["degree"]).first()
    assert (r.n, r.fixed, r.broke, r.left_out, r.delta, r.d_truncated) == (20, 8, 0, 1, 40.0, 0.0)


def test_follow_up_sets_are_held_to_their_plan(spark):
    planned = spark.createDataFrame([(i, "p") for i in range(5)], "k int, prompt string")
    rows = spark.createDataFrame([(0, "p"), (1, "p"), (1, "p"), (2, "other"), (9, "p"), (3, None)], "k int, prompt string")
    got = {r.problem: r.n for r in runs.follow_up_problems(planned, rows, ["k"], ["prompt"]).collect()}
    assert got == {"missing": 1, "unplanned": 1, "repeated": 1, "other_prompt": 2}
    assert {r.n for r in runs.follow_up_problems(planned, planned, ["k"], ["prompt"]).collect()} == {0}
    assert {r.n for r in runs.follow_up_problems(planned.limit(0), planned.limit(0), ["k"]).collect()} == {0}


@pytest.mark.parametrize("seed", range(3))
def test_division_and_fallout_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(u % 3, u, rng.choice("abx"), rng.randrange(3)) for u in range(60) for _ in range(rng.randrange(9))]
    factors = {"f": ["a", "b"], "g": [0, 1]}
    df = spark.createDataFrame(rows, "part int, u int, f string, g int")
    kept = runs.divided(df, ["u"], factors)
    by = {}
    for _, u, f, g in rows:
        if f in "ab" and g < 2:
            by.setdefault(u, set()).add((f, g))
    whole = {u for u, cells in by.items() if len(cells) == 4}
    assert {r.u for r in kept.collect()} == whole and kept.where("f = 'x' or g = 2").count() == 0
    out = {(r.part, r.factor, r.level): r.lacking for r in runs.fallout(df, ["part", "u"], factors, ["part"]).collect()}
    for part in range(3):
        units = {u: c for u, c in by.items() if u % 3 == part}
        assert out[part, None, None] == sum(len(c) < 4 for c in units.values())
        for i, (name, levels) in enumerate(factors.items()):
            for level in levels:
                assert out[part, name, str(level)] == sum(level not in {x[i] for x in c} for c in units.values())


def test_sign_test_by_hashed_halves(spark):
    rng = random.Random(7)
    null = [("null", c, rng.randrange(2), rng.randrange(2)) for c in range(60) for _ in range(3)]
    real = [("real", c, 0, int(rng.random() < 0.4)) for c in range(60) for _ in range(3)]
    df = spark.createDataFrame(null + real, "cell string, cluster long, correct_a int, correct_b int")
    got = {r.cell: r for r in runs.sign_test(df, ["cell"], "cluster").collect()}
    assert got["real"].p <= 3 / 401 and got["null"].p > 0.02 and got["real"].clusters == 60
    # All rows of a cluster turn together: a cell whose differences are one cluster's is never significant.
    one = spark.createDataFrame([("one", 1, 0, 1)] * 30, "cell string, cluster long, correct_a int, correct_b int")
    assert runs.sign_test(one, ["cell"], "cluster").first().p == 1.0


def test_flips_by_group(spark):
    rows = [("c", 0, 1, True), ("c", 1, 1, True), ("c", 1, 0, False), ("c", 0, 0, False), ("c", 0, 0, False), ("d", 0, 1, False)]
    df = spark.createDataFrame(rows, "c string, correct_a int, correct_b int, inside boolean")
    got = {r.c: r for r in runs.flips_by_group(df, ["c"], F.col("inside")).collect()}
    assert (got["c"].n, got["c"].members, got["c"].flips, got["c"].member_flips, got["c"].share_in) == (5, 2, 2, 1, 50.0)
    assert got["d"].share_in is None and got["d"].share_out == 100.0
