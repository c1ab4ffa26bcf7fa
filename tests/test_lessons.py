from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from graphspark.functions import fmt
from graphspark.operators import lessons, planning, structure


def _forest_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges, nodes = set(), []
    for g in range(30):
        n = rng.randrange(1, 12)
        nodes += [(g, i) for i in range(n)]
        tree = [(g, rng.randrange(i), i) for i in range(1, n) if rng.random() < 0.9]
        edges |= set(tree)
        if g % 2:
            edges |= {(g, *sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(1, 4)) if n > 1}
    return spark.createDataFrame(sorted(edges), "graph_id long, u int, v int"), spark.createDataFrame(nodes, "graph_id long, node int"), edges, nodes


@pytest.mark.parametrize("seed", range(3))
def test_one_cycle_is_a_cycle_wherever_there_is_one(spark, seed):
    edges, nodes, known, _ = _forest_and_cycles(spark, seed)
    found = {r.graph_id: r.cycle for r in lessons.one_cycle(edges, nodes).collect()}
    counts = structure.node_count(nodes).join(structure.edge_count(edges, nodes), "graph_id").join(structure.component_count(edges, nodes), "graph_id").collect()
    assert set(found) == {r.graph_id for r in counts if r.n_edges - r.n_nodes + r.n_components > 0}
    for g, c in found.items():
        assert len(c) >= 3 and len(set(c)) == len(c)
        assert all((g, min(x, y), max(x, y)) in known for x, y in zip(c, c[1:] + c[:1]))


def test_cycle_shots_take_one_negative_and_the_rest_positive(spark):
    edges, nodes, _, rows = _forest_and_cycles(spark, 5)
    names = ["er", "ba", "sbm", "star", "path"]
    algorithm = spark.createDataFrame([(g, names[g % 5]) for g in range(30)], "graph_id long, algorithm string")
    pool = lessons.cycle_examples(edges, nodes, algorithm, cot=True)
    by = {r.graph_id: r for r in pool.collect()}
    assert all(("The cycle is: " in r.answer) == r.answer.startswith("Yes") and r.example == r.question + r.answer for r in by.values())
    pool = pool.withColumn("example", F.concat_ws("|", "algorithm", "graph_id"))
    asked = spark.range(100, 140).withColumnRenamed("id", "graph_id")
    got = lessons.cycle_shots(pool, asked, k=3, seed=1).collect()
    seen = set()
    for r in got:
        shots = [s.rstrip("\n") for s in r.shots.split("Example: ")[1:]]
        kinds = [s.split("|")[0] for s in shots]
        assert len(kinds) == 3 and set(kinds[:2]) <= {"er", "ba", "sbm"} and kinds[2] in ("star", "path")
        seen.add(tuple(shots))
    assert len(seen) > 10 and [r.shots for r in lessons.cycle_shots(pool, asked, k=3, seed=1).orderBy("graph_id").collect()] == [r.shots for r in sorted(got, key=lambda r: r.graph_id)]


def test_hobbies_tell_half_and_ask_one(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(2)) for g in range(25) for i in range(rng.randrange(1, 9))]
    got = lessons.hobby_rows(spark.createDataFrame(rows, "graph_id long, node int, block int")).collect()
    blocks = {(g, i): b for g, i, b in rows}
    for r in got:
        n = sum(g == r.graph_id for g, _, _ in rows)
        assert len(r.told) == n // 2 if n > 1 else r.told == []
        assert r.first != r.second and {r.first, r.second} < set(lessons.HOBBIES) and r.asked not in [t.node for t in r.told]
        assert all(t.hobby == (r.first, r.second)[blocks[r.graph_id, t.node]] for t in r.told) and r.answer == (r.first, r.second)[blocks[r.graph_id, r.asked]]
        assert r.question == f"Q: Does node {r.asked} like {r.first} or {r.second}?\nA: " and r.statement.count("likes") == len(r.told)


def test_training_rows_mask_the_answer_and_pad(spark):
    df = spark.createDataFrame([("graph text Q: one two\nA: ", "yes."), ("no question", "a b c d e f g h")], "question string, answer string")
    words = lambda texts: [[len(w) for w in t.split()] for t in texts]
    one, two = lessons.tokenised(df, words, 10).collect()
    query = f"{lessons.PLACEHOLDER}Q: one two\nA: "
    ids = [1, *[len(w) for w in query.split()], 4, 2]
    assert one.input_tokens == ids + [0] * (10 - len(ids)) and one.target_mask == [0] * (len(ids) - 2) + [1, 1] + [0] * (10 - len(ids)) and not one.overflow
    assert two.overflow and len(two.input_tokens) == 10 and sum(two.target_mask) == 10 - 3
    asked = lessons.tokenised(df, words, 10).select(lessons.question_ids(F.col("input_tokens"), F.col("target_mask")).alias("q")).first().q
    assert asked == ids[2:-2]


def test_levels_share_a_question_and_ladders_their_rungs(spark):
    edges, nodes, rung = lessons.ladder(spark, 2, ["n40k8", "n80k4"], seed=3)
    sizes = {r.rung: r for r in nodes.join(rung, "graph_id").groupBy("rung").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("graph_id").alias("g")).collect()}
    assert (sizes["n40k8"].n, sizes["n40k8"].g, sizes["n80k4"].n) == (80, 2, 160)
    assert {r["count"] for r in edges.groupBy("graph_id").count().collect()} == {160}
    with pytest.raises(ValueError, match="n41k8"):
        lessons.ladder(spark, 1, ["n41k8"])
    part = rung.where("rung = 'n40k8'")
    small = lambda x: x.join(part, "graph_id", "left_semi")
    rows = lessons.levelled_corpus(small(edges), small(nodes), part, "node_degree", ["none", "degree"], times=1, seed=3).collect()
    assert len(rows) == 2 * 3 * 2 and len({r.instance_id for r in rows}) == 6
    for g in {r.graph_id for r in rows}:
        mine = [r for r in rows if r.graph_id == g]
        assert len({re.search(r"degree of node (\d+)", r.prompt)[1] for r in mine}) == 1 and {r.edges for r in mine} == {160} and len({r.gold for r in mine}) == 1
        assert {r.instance_id.split("/")[1:3] == ["n40k8", r.level] for r in mine} == {True} and {r.level for r in mine} == {"low", "base", "high"}
        assert len({r.prompt for r in mine if r.condition == "none"}) == 3


def test_degree_corpora_leave_the_rewiring_pass_whole(spark):
    """The same rows and texts as joins give, loops, lone nodes and a graph of more than 64 nodes among them, but without a join."""
    rng = random.Random(5)
    rows = {(g, u, v) for g, n, m in ((1, 10, 22), (2, 90, 260), (3, 25, 70)) for u, v in (sorted(rng.sample(range(n), 2)) for _ in range(m))}
    edges = spark.createDataFrame([*sorted(rows), (6, 0, 2), (6, 2, 2)], "graph_id long, u int, v int")
    nodes = spark.createDataFrame([(g, i) for g, n in ((1, 12), (2, 90), (3, 25), (4, 3), (6, 3)) for i in range(n)], "graph_id long, node int")
    args = (edges, nodes, "node_degree", ["none", "degree", "clustering"])
    rung = nodes.groupBy("graph_id").agg(F.concat(F.lit("n"), F.count(F.lit(1)).cast("string")).alias("rung"))
    got = lessons.levelled_corpus(edges, nodes, F.concat(F.lit("n"), F.col("nodes").cast("string")), *args[2:], times=2, seed=3)
    want = lessons._joined_corpus(*args, True, 2, 3).join(rung, "graph_id").withColumn("instance_id", F.concat_ws("/", F.lit("node_degree"), "rung", "level", F.col("graph_id").cast("string")))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.columns) == sorted(want.columns) and dict(got.dtypes) == dict(want.dtypes)
    table = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()))
    assert table(got) == table(want) and len(table(got)) == 5 * 3 * 3


def test_decimals_beside_a_number_are_those_of_a_column(spark):
    values = sorted({k / (d * (d - 1)) for d in range(2, 70) for k in range(0, d * (d - 1) + 1, 2)} | {i / 200 for i in range(201)} | {i / 10**6 for i in range(4990, 5010)} | {0.0049995, 0.1249995, 0.9949995})
    got = spark.createDataFrame([(v, fmt.two_decimals_of(v)) for v in values], "v double, said string")
    assert got.where(fmt.two_decimals(F.col("v")) != F.col("said")).count() == 0


def test_verdicts_and_best_arms(spark):
    cells = spark.createDataFrame([("degree", "edge_count", 3, 0.1, 1.0), ("filler", "edge_count", 3, 0.1, 0.1), ("all", "edge_count", 3, 0.1, 0.98)], "condition string, task string, rung int, baseline double, shortcut double")
    got = {r.condition: r for r in planning.verdicts(cells).collect()}
    assert (got["degree"].decided, got["degree"].label, got["degree"].gap) == (True, "shortcut", 90.0) and got["filler"].label == "none" and got["all"].label is None and not got["all"].decided
    assert len(planning.SHORTCUT_AUDIT) == 30
    scores = spark.createDataFrame([("t", "b", 0.5), ("t", "a", 0.5 - 1e-13), ("t", "c", 0.4), ("u", "z", 0.1)], "task string, arm string, s double")
    assert {r.task: r.arm for r in planning.best_arm(scores, ["task"], "arm", "s").collect()} == {"t": "a", "u": "z"}
