from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from graphspark.functions import claims
from graphspark.operators import invented


def _graphs(spark, seed, graphs=3, n=9):
    rng = random.Random(seed)
    edges = [(g, u, v) for g in range(graphs) for u, v in itertools.combinations(range(0, 2 * n, 2), 2) if rng.random() < 0.35]
    nodes = [(g, u) for g in range(graphs) for u in range(0, 2 * n, 2)]
    near = {(g, u): set() for g, u in nodes}
    for g, u, v in edges:
        near[g, u].add(v)
        near[g, v].add(u)
    return spark.createDataFrame(edges, "graph_id long, u int, v int"), spark.createDataFrame(nodes, "graph_id long, node int"), near


def _classes(near, g, a):
    of = lambda x: near.get((g, x), set())
    beside, off = of(a - 1) | of(a + 1), {y + d for y in of(a) for d in (-1, 1)}
    two = set().union(*(of(y) for y in of(a)))
    rest = [x for (h, x) in near if h == g and x != a and x not in of(a)]
    return {"beside": beside, "off": off, "two": two}, rest


def test_surroundings_against_sets(spark):
    # Ids two apart have no neighbours by id, so a second collection has consecutive ones.
    for step in (2, 1):
        edges, nodes, near = _graphs(spark, step)
        edges, nodes = (x.select("graph_id", *((F.col(c) * step / 2).cast("int").alias(c) for c in x.columns[1:])) for x in (edges, nodes))
        near = {(g, u * step // 2): {v * step // 2 for v in vs} for (g, u), vs in near.items()}
        rows = invented.surroundings(edges, nodes).collect()
        assert len(rows) == len(near)
        for r in rows:
            classes, rest = _classes(near, r.graph_id, r.node)
            assert set(r.nbrs) == near[r.graph_id, r.node]
            for name, members in classes.items():
                assert set(r[name]) == members
                chance = sum(x in members for x in rest) / len(rest) if rest else None
                assert r[f"{name}_chance"] is None if chance is None else abs(r[f"{name}_chance"] - chance) < 1e-12


def test_invented_and_missed_members_and_steps(spark):
    edges, nodes, near = _graphs(spark, 5)
    around = invented.surroundings(edges, nodes)
    rng = random.Random(1)
    answers = [(i, i % 3, a, rng.sample(range(0, 20), rng.randrange(7))) for i, a in enumerate(rng.choices(range(0, 18, 2), k=40))]
    df = spark.createDataFrame(answers, "k int, graph_id long, node int, ids array<int>")
    made = {(r.k, r.member): r for r in invented.invented_members(df, ["k"], around).collect()}
    assert set(made) == {(k, y) for k, g, a, ids in answers for y in set(ids) - near[g, a]}
    for (k, y), r in made.items():
        _, g, a, _ = answers[k]
        classes, _ = _classes(near, g, a)
        assert r.self == (y == a) and all(r[c] == (y in classes[c]) for c in classes)
    lost = invented.missed_members(df, ["k"], around).collect()
    want = sorted((k, y == min(near[g, a]), y == max(near[g, a]), y < a) for k, g, a, ids in answers for y in near[g, a] - set(ids))
    assert sorted((r.k, r.first, r.last, r.below) for r in lost) == want
    known = edges.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v")).alias("edges"))
    walks = [(i, i % 3, [rng.randrange(0, 20, 2) for _ in range(rng.randrange(2, 6))]) for i in range(40)]
    walks = [(i, g, [*w, w[0]]) for i, g, w in walks]
    steps = invented.invented_steps(spark.createDataFrame(walks, "k int, graph_id long, walk array<int>").join(known, "graph_id"), ["k"], around).collect()
    bad = sorted((i, j == len(w) - 2) for i, g, w in walks for j, (x, y) in enumerate(zip(w, w[1:])) if y not in near.get((g, x), set()))
    assert sorted((r.k, r.closing) for r in steps) == bad


def test_each_measure_against_none(spark):
    rows = [("m", c, g, int(c == "degree" and g < 6), int(g % 2)) for g in range(10) for c in ("none", "degree", "rwse")]
    df = spark.createDataFrame(rows, "arm string, condition string, graph_id int, up int, same int")
    got = {(r.measure, r.condition): r for r in invented.against_none(df, ["graph_id"], ["up", "same"]).collect()}
    assert (got["up", "degree"].fixed, got["up", "degree"].broke, got["up", "degree"].n) == (6, 0, 10)
    assert abs(got["up", "degree"].p - 2 / 64) < 1e-12 and abs(got["up", "degree"].q - 4 / 64) < 1e-12 and got["same", "rwse"].p == 1.0


def test_flags_of_walks(spark):
    edges = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in ((0, 1), (1, 2), (0, 2))))
    texts = ["0 -> 1 -> 2 -> 0.", "0 -> 1 -> 3 -> 0.", "0 -> 1 -> 3 -> 0 is not a valid cycle.", "0 -> 1 -> 2 -> 0 is invalid. So 0 -> 3 -> 1 -> 0.", "none", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("f", claims.cycles("t"))
    got = df.orderBy("i").select(*(c.alias(n) for n, c in invented.walk_flags(F.col("f"), edges).items())).collect()
    assert [(r.asserted, r.caught, r.rejected_real) for r in got] == [(False, False, False), (True, False, False), (False, True, False), (True, False, True), (False, False, False), (False, False, False)]


def test_a_rejection_within_250_characters_counts(spark):
    cases = [(240, True), (249 - len("not a valid cycle") + 1, True), (251, False), (300, False)]
    df = spark.createDataFrame([(i, "0 → 1 → 2 → 0" + " " * gap + "not a valid cycle") for i, (gap, _) in enumerate(cases)], "i int, t string")
    got = df.orderBy("i").select(F.get(claims.cycles("t"), F.lit(0))["rejected"].alias("r")).collect()
    # The whole rejection must lie within the window.
    assert [r.r for r in got] == [gap + len("not a valid cycle") <= 250 for gap, _ in cases]
