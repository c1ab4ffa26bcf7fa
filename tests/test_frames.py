from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from graphspark.functions import detect
from graphspark.operators import encode, frames, prompts, rewire, structure
from graphspark.plans import queries
from graphspark.sources import graphs


def _graph(spark, shift=0):
    es = [(0, 1), (0, 2), (1, 2), (2, 3), (4, 5), (3, 6), (6, 7), (5, 7), (1, 7)]
    edges = spark.createDataFrame([(g, u, v) for g in (1, 2) for u, v in es[: len(es) - g + 1]], graphs.EDGES)
    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(9)], graphs.NODES)
    return edges, nodes


def test_prompts_read_back(spark):
    edges, nodes = _graph(spark)
    built = prompts.build_corpus(edges, nodes, ["node_degree", "edge_existence", "connected_nodes", "cycle_check"], ["none", "degree", "all"]).persist()
    assert built.count() == 2 * 4 * 3
    read = prompts.graphs_of_prompts(built)
    assert prompts.miscounted(read).count() == 0 and prompts.miscounted(read.withColumn("stated_edges", F.lit(1))).count() == read.count()
    for r in read.collect():
        g = int(r.instance_id.rsplit("/", 1)[1])
        assert [(e.u, e.v) for e in r.edges] == sorted((x.u, x.v) for x in edges.where(f"graph_id = {g}").collect()) and r.nodes == list(range(9))
        assert len(r.targets) == {"node_degree": 1, "connected_nodes": 1, "edge_existence": 2, "cycle_check": 0}[r.instance_id.split("/")[0]]
    pairs = encode.encode(edges, nodes, "adjacency").select("graph_id", prompts.adjacency_edges(F.col("text")).alias("edges"))
    assert prompts.edge_table(pairs).exceptAll(edges).count() == 0 and edges.exceptAll(prompts.edge_table(pairs)).count() == 0
    whole = built.where("condition = 'all' and task = 'node_degree'").select(*(prompts.stated(F.col("prompt"), f).alias(f) for f in ("degree", "clustering", "rwse")), prompts.nodes_listed(F.col("prompt")).alias("k"), prompts.clustering_spread(F.col("prompt")).alias("sd")).first()
    assert len(whole.degree) == len(whole.clustering) == len(whole.rwse) == 9 and whole.degree[8] == 0 and whole.k == 8 and whole.sd > 0 and len(whole.rwse[0]) == 2


def test_probe_and_rewording(spark):
    rows = prompts.retrieval_probe(spark, [3, 10], [0.1, 0.9], 4).collect()
    assert len(rows) == 2 * 2 * 2 * 4
    for r in rows:
        low, high = prompts.BANDS[r.magnitude]
        assert r.prompt.count("has degree") == r.statements and low <= int(r.gold) <= high
    one = spark.range(1)
    assert one.select(prompts.reworded(F.lit("Q: Is node 3 connected to node 5?\nA: "))).first()[0] == "Q: Does an edge exist between Node 3 and Node 5?\nA: "
    with pytest.raises(Exception, match="unexpected wording"):
        one.select(prompts.reworded(F.lit("Is it?"))).collect()
    with pytest.raises(Exception, match="no node list"):
        one.select(prompts.header_nodes(F.lit("nothing"))).collect()


def test_rewiring_keeps_degrees_and_moves_triangles(spark):
    keys = graphs.sweep_keys(spark, (24,), (0.25,), 6, 99)
    edges, nodes = graphs.generate(spark, keys)
    both = rewire.rewired_pair(edges, nodes, times=3, seed=5).persist()
    count = lambda e: sum(r.n_triangles for r in structure.triangle_count(e, nodes).collect())
    low, high = (both.where(F.col("level") == x).drop("level") for x in ("low", "high"))
    assert count(low) < count(edges) < count(high)
    for after in (low, high):
        assert rewire.broken_invariants(edges, after, nodes).count() == 0
    assert rewire.broken_invariants(edges, low.where("u <> 0"), nodes).count() > 0


def test_swap_gains_match_a_recount():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.triu(rng.random((9, 9)) < 0.4, 1)
        ends = np.argwhere(a)
        if len(ends) < 2:
            continue
        s = rewire._Square(9, ends)
        (p, q), (r, t) = ends[rng.choice(len(ends), 2, replace=False)]
        if len({p, q, r, t}) < 4 or s.a[p, t] or s.a[r, q]:
            continue
        tri = lambda m: np.trace(m @ m @ m) // 6
        before, gain = tri(s.a.astype(int)), rewire._gains(s, np.array([[p, q, r, t]]))[0]
        for u, v in ((p, q), (r, t)):
            s.drop(u, v)
        for u, v in ((p, t), (r, q)):
            s.put(u, v)
        assert tri(s.a.astype(int)) - before == gain
        off = ~np.eye(9, dtype=bool)
        assert ((s.a @ s.a)[off] == s.c[off]).all()


def test_many_graphs_are_rewired_in_time(spark):
    """300 graphs of 40 nodes, both ways: numpy calls for every pair that was looked at took over five times as long."""
    keys = graphs.sweep_keys(spark, (40,), (0.25,), 300, 7)
    edges, nodes = graphs.generate(spark, keys)
    began = time.time()
    both = rewire.rewired_pair(edges, nodes, times=1).groupBy("level").agg(F.count(F.lit(1)).alias("m")).collect()
    assert {r.m for r in both} == {edges.count()} and time.time() - began < 12


def test_graphs_side_by_side_are_rewired_as_in_turn():
    import numpy as np

    rng = np.random.default_rng(8)
    graphs, per = np.array([5, -3, 7, 10**12, 11, 12]), [(12, 0.4), (2, 1.0), (30, 0.2), (64, 0.1), (9, 1.0), (20, 0.3)]
    ends = [np.argwhere(np.triu(rng.random((n, n)) < p, 1)) for n, p in per]
    flat = np.concatenate([e + g * rewire.WORD for g, e in enumerate(ends)])
    sizes = np.array([len(e) for e in ends])
    for up in (False, True):
        for times in (1, 3):
            got = np.stack(rewire._abreast(graphs, sizes, *flat.T, up, times, 4), 1)
            turn = [rewire._in_turn(int(g), n, e, up, times, 4) for g, (n, _), e in zip(graphs, per, ends)]
            want = np.concatenate([t + g * rewire.WORD for g, t in enumerate(turn)])
            assert (np.sort(got, 1) == np.sort(want, 1)).all() and (got != flat).any()


def test_triangles_are_counted_where_graphs_are_rewired(spark):
    """No table of edges is joined with itself: from six times sf0.1 on, such joins took the driver's memory or time."""
    rng = random.Random(3)
    rows = {(g, u, v) for g, n, m in ((1, 10, 22), (2, 90, 260), (3, 25, 70)) for u, v in (sorted(rng.sample(range(n), 2)) for _ in range(m))}
    edges = spark.createDataFrame([*sorted(rows), (1, 4, 4), (6, 2, 2)], "graph_id long, u int, v int")
    nodes = spark.createDataFrame([(g, i) for g, n in ((1, 10), (2, 90), (3, 25), (4, 3), (6, 3)) for i in range(n)], "graph_id long, node int")
    got = rewire.rewired_triangles(edges, nodes, times=2, seed=6).persist()
    for name, after in (("before", edges), ("low", rewire.rewire(edges, nodes, False, 2, 6)), ("high", rewire.rewire(edges, nodes, True, 2, 6))):
        want = structure.triangle_count(after, nodes).collect()
        assert {(r.graph_id, r[name]) for r in got.collect()} == {tuple(r) for r in want}
        assert rewire.broken_invariants(edges, after, nodes).count() == 0
    assert all(r.low <= r.before <= r.high for r in got.collect()) and {r.graph_id for r in got.collect()} == {1, 2, 3, 4, 6}
    query = queries.QUERIES["rewire_triangles"](spark, "/root/testdata/sf0.001")
    assert "Join" not in query._jdf.queryExecution().executedPlan().toString()


def test_batches_hold_whole_graphs(spark):
    rows = [(g, i, i + 1) for g, n in ((1, 7), (2, 1), (3, 12), (4, 3), (9, 30), (10, 2)) for i in range(n)]

    def told(graphs, sizes, u, v):
        assert len(graphs) <= 2 and len(u) == len(v) == sizes.sum() and (v == u + 1).all()
        yield graphs, sizes

    edges = spark.createDataFrame(rows, "graph_id long, u int, v int")
    for most in (1, 5, 1000):
        got = structure.per_batch(edges, told, "graph_id long, n int", graphs=2, rows=most).collect()
        assert sorted(tuple(r) for r in got) == [(1, 7), (2, 1), (3, 12), (4, 3), (9, 30), (10, 2)]
    assert structure.per_batch(edges.where("false"), told, "graph_id long, n int").count() == 0


RUN = "instance_id string, task string, condition string, style string, gold string, model string, response string, n_new_tokens int, hit_cap boolean"


def test_run_frame(spark):
    rows = [
        ("t/1", "node_degree", "none", "zero_shot", "3", "m-think", "The answer is 3.", 5, None),
        ("t/2", "node_degree", "none", "zero_shot", "3", "m-think", "The answer is 3.", 5, True),
        ("t/3", "connected_nodes", "filler", "zero_shot", "1, 2", "m", "Answer: 1, 5", 5, True),
        ("t/4", "node_degree", "none", "zero_shot", "3", "m", None, None, False),
    ]
    records = spark.createDataFrame(rows, RUN)
    listed = spark.createDataFrame([("m-think", "t/1", "none", "zero_shot")], "model string, instance_id string, condition string, style string")
    bars = spark.createDataFrame([("node_degree", "none", 0.5)], "task string, condition string, shortcut_score double")
    got = {r.instance_id: r for r in frames.run_frame(records, listed, bars).collect()}
    assert [got[f"t/{i}"].failure_type for i in (1, 2, 3, 4)] == ["non_terminating"] * 3 + ["unparsed"]
    assert got["t/1"].non_terminating_source == "ground_truth_file" and got["t/1"].truncated_but_correct and got["t/1"].exact == 0 and got["t/1"].looped_on_correct_answer
    assert got["t/3"].truncated_but_partial_credit and got["t/3"].wording == "revised" and got["t/4"].response_len_chars is None and got["t/4"].shortcut_score == 0.5
    frame = frames.run_frame(records, listed, bars)
    assert frames.failure_sample(frame, 1).count() == 3 and frames.repeated_keys(frame).count() == 0
    assert {r.block for r in frames.run_summaries(frame).collect()} == {"baseline", "condition", "non_termination", "failure"}
    with pytest.raises(Exception, match="unknown prompt style"):
        frames.run_frame(records.withColumn("style", F.lit("few_shot")), listed, bars).collect()


def test_main_frame_checks_gold(spark):
    edges, nodes = _graph(spark)
    asked = prompts.build_corpus(edges, nodes, ["node_degree", "edge_existence"], ["none", "degree"]).persist()
    said = asked.select("instance_id", "task", "condition", "style", "gold", F.lit("m").alias("model"), F.concat(F.lit("The answer is "), "gold", F.lit(".")).alias("response"), F.lit(False).alias("hit_cap"))
    frame = frames.main_frame(said, asked)
    assert frame.count() == 8 and frame.where("exact = 1 and outcome = 'correct' and n_nodes = 9").count() == 8
    features = frames.target_features(frame.withColumn("graph_id", F.element_at(F.split("instance_id", "/"), -1).cast("long")), edges, nodes).collect()
    assert all((r.target_degree == int(r.gold)) if r.task == "node_degree" else ((r.pair_distance == 1) == (r.gold == "Yes")) for r in features)
    with pytest.raises(Exception, match="gold mismatch"):
        frames.main_frame(said.withColumn("gold", F.lit("99")), asked).collect()
    ids = spark.createDataFrame([("node_degree/size40/p0.10/s7/3",), ("x/size20/p0.5/4",)], "i string").select(frames.parsed_id(F.col("i")).alias("k")).collect()
    assert (ids[0].k.seed, ids[0].k.density, ids[1].k.seed, ids[1].k.idx) == (7, 0.1, None, 4)


def test_joins_that_check(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x", 5), (2, "z", 6)], "k int, v string, w int")
    assert frames.strict_join(a.where("k = 1"), b, ["k"], ["v"]).collect()[0].w == 5
    with pytest.raises(Exception, match="no equal counterpart"):
        frames.strict_join(a, b, ["k"], ["v"]).collect()
    with pytest.raises(Exception, match="several rows"):
        frames.one_to_one(a.union(a), b.drop("v"), ["k"]).collect()
    assert frames.one_to_one(a, b.drop("v"), ["k"]).count() == 2 and frames.realigned(b, spark.createDataFrame([(3,), (1,)], "k int"), ["k"]).count() == 2
    sheet = spark.createDataFrame([("m", i, c, o, "r " * 300) for i in range(4) for c, o in (("none", "wrong"), ("degree", "correct"))], "arm string, unit int, condition string, outcome string, response string")
    flips = frames.flip_sheet(sheet, ["arm", "unit"], 2).collect()
    assert len(flips) == 2 and all(len(r.start_a) == 200 for r in flips)
    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(30)], "i int, a int, b int")
    picked = frames.balanced_pick(rows, ["a", "b"], 6, "i").collect()
    assert sorted((r.a, r.b) for r in picked) == [(a, b) for a in range(3) for b in range(2)]


@pytest.mark.parametrize("seed", range(4))
def test_budget_cuts_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.randrange(1, 60), lambda: rng.choice([7, 7, 7, 30]), lambda: int(rng.expovariate(0.05)), lambda: rng.choice([5, 2000])]
    rows = [(i, i % 2 if seed else 0, kinds[seed]()) for i in range(rng.randrange(150, 400))]
    df = spark.createDataFrame(rows, "id long, g int, n int")
    got = frames.budget_groups(df, "n", 500, "id", ["g"], salts=5)
    assert got.columns == ["id", "g", "n", "chunk"] and got.count() == len(rows)
    mine = {}
    for r in got.collect():
        mine.setdefault((r.g, r.chunk), []).append(r.n)
    want, open_ = {}, {}
    for _, g, n in sorted(rows, key=lambda r: r[2]):
        chunk = open_.setdefault(g, [])
        if chunk and (len(chunk) + 1) * n > 500:
            chunk = open_[g] = []
        if not chunk:
            want.setdefault(g, []).append(chunk)
        chunk.append(n)
    assert {k: sorted(v) for k, v in mine.items()} == {(g, i): c for g, chunks in want.items() for i, c in enumerate(chunks)}
    assert frames.budget_groups(df.limit(0), "n", 500, "id").count() == 0


def test_patterns_held_against_the_graph(spark):
    edges = spark.createDataFrame([(1, u, v) for u, v in ((0, 1), (0, 2), (1, 2), (2, 3))], "graph_id long, u int, v int")
    nodes = spark.createDataFrame([(1, i) for i in range(4)], "graph_id long, node int")
    table = "Node 0: 2\nNode 1: 2\nNode 2: 3\nNode 3: 1"
    cases = [
        ("edge_count", table + "\nThe sum is 8, and 8 / 2 = 4.", "4", 1), ("edge_count", table.replace("Node 2: 3", "Node 2: 2") + "\n8 / 2 = 4", "4", 1), ("edge_count", "Node 0: 2", "4", 1),
        ("cycle_check", "See 0 -> 1 -> 2 -> 0.", "Yes", 1), ("cycle_check", "See 0 -> 1 -> 3 -> 0.", "Yes", 1), ("cycle_check", "No walk, but more edges than a tree.", "Yes", 1),
        ("node_degree", "Its connections are explicitly listed as: 0, 1, 3", "3", 1), ("node_degree", "The degree of node 2 is 1.", "1", 0), ("node_degree", "The clustering is 0.33 there.", "3", 1), ("node_degree", "It is 0.335.", "3", 1),
    ]
    frame = spark.createDataFrame([(i, 1, t, x, p, e, False, 2, 0, [0, 1, 3]) for i, (t, x, p, e) in enumerate(cases)], "i int, graph_id long, task string, response string, pred string, exact int, hit_cap boolean, a int, b int, nbrs array<int>")
    got = frames.pattern_frame(frame, frames.graph_facts(edges, nodes)).orderBy("i").collect()
    assert len(detect.TEXT_PATTERNS) == 17 and len(detect.NUMERIC_PATTERNS) == 5
    assert [(r.degree_table, r.degree_table_right, r.chain) for r in got[:3]] == [(1, 1, "right"), (1, 0, "values"), (0, 0, "no table")] and got[1].table_right == 0.75
    assert [(r.cycle_named, r.cycle_real, r.tree_bound) for r in got[3:6]] == [(1, 1, 0), (1, 0, 0), (0, 0, 1)]
    assert [(r.retrieve, r.quotes_primer_value) for r in got[6:]] == [(0, 0), (1, 0), (1, 1), (1, 0)]
    assert got[7].copied == "near" and abs(got[7].copy_chance - 0.0) < 1e-12 and got[6].copied is None and got[3].retrieve is None
