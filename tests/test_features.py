from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from graphspark.operators import features, structure
from graphspark.sources import graphs

ES = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]


def _graph(spark):
    edges = spark.createDataFrame([(g, u, v) for g in (1, 2) for u, v in ES[: 6 - g]], graphs.EDGES)
    return edges, spark.createDataFrame([(g, n) for g in (1, 2) for n in range(5)], graphs.NODES)


def test_node_features(spark):
    edges, nodes = _graph(spark)
    d = [2, 2, 3, 2, 1]
    got = {r.node: r for r in features.covariates(edges, nodes).where("graph_id = 1").collect()}
    assert all(math.isclose(got[i].z, (d[i] - 0.5 * 4) / 1.0) for i in range(5))
    values = features.printed_values(edges, nodes).persist()
    info = {r.graph_id: r for r in features.informativeness(values, ["clustering"]).collect()}
    # Clustering 1, 1, 1/3, 0, 0 against degrees 2, 2, 3, 2, 1: four of five are pinned.
    assert math.isclose(info[1].share, 4 / 5) and math.isclose(info[1].gain, (0.8 - 0.6) / 0.4)
    t = {r.node: r.tercile for r in features.degree_terciles(edges, nodes).where("graph_id = 1").collect()}
    assert t == {0: 1, 1: 1, 2: 2, 3: 1, 4: 0}
    pairs = spark.createDataFrame([(1, 0, 2)], "graph_id long, a int, b int")
    p = features.pair_features(values, pairs).first()
    assert p.degree_sum == 5 and math.isclose(p.clustering, (1 + 0.33) / 2)
    c = features.correlations(structure.statistics_by_graph(edges, nodes), "degree", "rwse2").first()
    assert c.graphs == 2 and -1 <= c.fisher <= 1
    edge = edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("graph_id", "v", "u"))
    r = features.resampled_rate(nodes, "edge_existence", edge, 40).first()
    assert 0.2 < r.rate < 0.8 and r.sd > 0


def test_tensors_and_padding(spark):
    edges, nodes = _graph(spark)
    asked = spark.createDataFrame([(1, 0, 3), (2, 4, None)], "graph_id long, a int, b int")
    rows = features.tensors(edges, nodes, asked).persist()
    one = rows.where("graph_id = 1").first()
    assert sorted(zip(one.source, one.target)) == sorted([*ES, *((v, u) for u, v in ES)]) and one.weights is None
    assert [(x.node, x.role) for x in one.readout] == [(0, "source"), (3, "target")] and [x.role for x in rows.where("graph_id = 2").first().readout] == ["node"]
    a = np.zeros((5, 5))
    for u, v in ES:
        a[u, v] = a[v, u] = 1
    s = 1 / np.sqrt(a.sum(1))
    lap = np.eye(5) - s[:, None] * a * s[None, :]
    lpe = np.array(one.lpe)
    sv = np.linalg.svd(lap)[1]
    for k in range(4):
        v = lpe[:, k]
        assert np.allclose(lap @ v, (v @ lap @ v) * v, atol=1e-4) and np.isclose(abs(v @ lap @ v), sv[k], atol=1e-4)
    weighted = features.tensors(structure.with_weights(edges), nodes).where("graph_id = 1").first()
    assert len(weighted.weights) == 10 and weighted.readout == []
    sizes = features.padded_sizes(rows, slack=0.0)
    full = features.padded(rows, sizes).collect()
    assert {len(r.nodes) for r in full} == {6} and {len(r.source) for r in full} == {11} and sorted(sum(r.edge_mask) for r in full) == [8, 10]


def test_examples(spark):
    edges, nodes = _graph(spark)
    rows = features.example_sets(edges, nodes, ["node_degree", "cycle_check"], ["incident", "adjacency"], k=1).collect()
    assert len(rows) == 2 * 3 * 2 * 2
    for r in rows:
        assert r.question.count("Example: ") == (1 if r.style == "few_shot" and r.task == "node_degree" else r.question.count("Example: "))
        assert r.question.endswith(features.STEP_BY_STEP) == (r.style == "zero_cot") and len(r.node_ids) == (1 if r.task == "node_degree" else 0)
    said = spark.createDataFrame([("Yes, there is.", "yes."), ("3", "3."), ("4", "3."), (None, "3.")], "prediction string, answer string")
    assert features.task_accuracy(said, []).first().accuracy == 0.5
    assert features.named(nodes, "got").where("graph_id = 1 and node = 1").first().name == "Cat"
