from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from graphspark.functions import answers, claims, detect
from graphspark.functions.probability import binomial_two_sided, clopper_pearson
from graphspark.operators import inference, resample

#: Shapes of responses, in words of our own: what each must be read as.
CASES = [
    ("node_count", "First I list ids 3 to 8.\nThat makes six lines, so the answer is 6.", "6"),
    ("node_degree", "Looking it up: the degree of node 11 is **4**.", "4"),
    ("edge_count", "The answer is: 21. Had I counted twice, the sum would have been 42.", "21"),
    ("node_degree", "Therefore the answer is the degree of node 5 which is:\n\n\\boxed{7}", "7"),
    ("node_degree", "Node 34 has a single partner, hence **1**. Its partner is node 11.", "1"),
    ("node_count", "I can not tell.", None),
    ("cycle_check", "There are no nodes twice. Final answer: No", "No"),
    ("cycle_check", "Yes, one exists. A cycle is a path with no repeated edges.", "Yes"),
    ("connected_nodes", "Node 6 is connected to nodes 1, 4, and 8.", "1, 4, 8"),
    ("connected_nodes", "Node 15 is connected to node 2.", "2"),
    ("connected_nodes", "Its neighbours:\n**None**", "No nodes"),
    ("connected_nodes", "Answer: []", "No nodes"),
    ("connected_nodes", "...which leaves **[]** (an empty list).", "No nodes"),
    ("connected_nodes", "None of them touch it but node 9 does.", "9"),
    ("edge_existence", "I read both lines.\nThis cannot be told from the text.", None),
    ("edge_existence", "Reading on.\nSo the edge exists between them.", "Yes"),
    ("edge_existence", "The graph is connected.", None),
    ("edge_existence", "We should verify an edge exists first.", None),
    ("edge_existence", "Checking the list, node 4 is connected to node 3.", "Yes"),
    ("edge_existence", "Node 4 is connected to node 3.\nWhether that helps I can not say.", None),
    ("node_degree", "", None),
    ("node_degree", "  \n ", None),
]


def test_extraction_cases(spark):
    rows = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(CASES)], "i int, task string, text string")
    got = {r.i: r.a for r in rows.select("i", answers.answer(F.col("text"), F.col("task")).alias("a")).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_words_end_at_letters_beyond_ascii(spark):
    """As the SQL reads them: a letter beyond ASCII is no part of a word."""
    df = spark.createDataFrame([("\nNo\u00f1asci\u00f3nque esos",), ("Nothing; yes_no",), ("\u00e9yes \u00fc",), ("no nodes\u00f1 no",)], "t string")
    assert [r.x for r in df.select(answers.boolean_answer(F.col("t")).alias("x")).collect()] == ["No", None, "Yes", "No"]
    assert [r.x for r in df.select(answers.yes_no(F.col("t")).alias("x")).collect()] == ["No", None, "Yes", "No"]


def test_unknown_task_raises(spark):
    with pytest.raises(Exception, match="unknown task"):
        spark.createDataFrame([("x", "nope")], "text string, task string").select(answers.answer(F.col("text"), F.col("task"))).collect()


def test_scores(spark):
    both = spark.createDataFrame([("Yes", "Yes, there is a cycle"), ("No.", "Yes"), ("No nodes, so no", "No")], "p string, g string")
    assert [r.e for r in both.select(answers.score(F.col("p"), F.col("g"), F.lit("cycle_check"))["exact"].alias("e")).collect()] == [1.0, 0.0, 1.0]
    rows = [("10", "10.", "node_count"), ("7", "10", "node_count"), ("2, 1", "1, 2", "connected_nodes"), ("1", "1, 2", "connected_nodes"), (None, "Yes", "cycle_check"), ("No nodes", "No nodes", "connected_nodes")]
    df = spark.createDataFrame(rows, "p string, g string, task string").select(answers.score(F.col("p"), F.col("g"), F.col("task")).alias("s"))
    s = [r.s for r in df.collect()]
    assert [x.exact for x in s] == [1.0, 0.0, 1.0, 0.0, 0.0, 1.0]
    assert s[1].absolute_error == 3 and math.isclose(s[3].primary, 2 / 3) and not s[4].parsed


def test_mcnemar_matches_exact(spark):
    pairs = [(0, 0), (3, 3), (1, 9), (20, 45), (700, 600), (0, 5)]
    df = spark.createDataFrame(pairs, "b int, c int").select(binomial_two_sided(F.col("b"), F.col("c")).alias("p"))
    for (b, c), r in zip(pairs, df.collect()):
        n, k = b + c, min(b, c)
        want = 1.0 if b == c else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_adjusted_values(spark):
    p = [0.01, 0.04, 0.03, 0.2, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    q = {r.i: r.q for r in inference.with_q(df).collect()}
    order = sorted(range(4), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(4, 0, -1):
        low = min(low, p[order[rank - 1]] * 4 / rank)
        want[order[rank - 1]] = low
    assert q[4] is None and all(math.isclose(q[i], want[i]) for i in range(4))
    holm = {r.i: r.holm for r in inference.with_holm(df.where("p is not null")).collect()}
    assert math.isclose(holm[0], 0.04) and math.isclose(holm[2], 0.09)


def test_clopper_pearson_bounds():
    low, high = clopper_pearson(0, 10)
    assert low == 0 and math.isclose(high, 1 - 0.025 ** (1 / 10), rel_tol=1e-9)
    low, high = clopper_pearson(10, 10)
    assert high == 1 and math.isclose(low, 0.025 ** (1 / 10), rel_tol=1e-9)


def test_sign_flip_enumerates_small_cells(spark):
    rows = [("c", i, 0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "cell string, unit int, a int, b int")
    r = resample.sign_flip_test(df, ["cell"], "unit", "a", "b").first()
    assert math.isclose(r.p, 2 / 32) and r.delta == 1.0 and r.clusters == 5
    assert resample.cluster_bootstrap(df, ["cell"], "unit", "a", "b").first().low is None


def test_majority_ties_and_sampling(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "g string, v string")
    small = {r.g: r.answer for r in inference.majority(df, ["g"], "v").collect()}
    large = {r.g: r.answer for r in inference.majority(df, ["g"], "v", largest=True).collect()}
    assert small == {"x": "a", "y": "c"} and large == {"x": "b", "y": "c"}
    assert inference.seeded_sample(df, ["g"], F.col("v"), 1).count() == 2


def test_detectors(spark):
    text = "Walk 0 -> 1 -> 2 -> 0. Node 4 has degree 3. Node 4 has degree 5. Node 1 is not connected to node 2."
    df = spark.createDataFrame([(text, "ab" * 600)], "t string, u string")
    r = df.select(
        detect.walks(F.col("t")).alias("w"), claims.node_values(F.col("t")).alias("d"), claims.statements(F.col("t")).alias("e"), detect.loop_score("u").alias("l"), detect.loop_length("u").alias("p"),
        *(detect.common_prefix(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("c", "abcd", "abxd"), ("c0", "", "ab"), ("c1", "ab", "abc"))),
    ).first()
    assert r.w == [[0, 1, 2, 0]] and r.d == {4: 5} and r.l == 1.0 and r.p == 2 and (r.c, r.c0, r.c1) == (2, 0, 2)
    assert r.e == []


def test_routes_and_conflicts(spark):
    listed = "Node 7 is connected to:\n" + "\n".join(f"- {i}" for i in range(5)) + "\nso 5"
    texts = ["The degree of node 7 is 5.", "Node 7 is connected to nodes 1, 2.", listed, "I see a discrepancy here. Let me see if there is any contradiction.", "Check for inconsistency."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.orderBy("i").select(detect.route(F.col("t"), F.lit(7)).alias("r"), detect.reports_conflict(F.col("t")).alias("c"), detect.opening_value(F.col("t")).alias("o")).collect()
    assert [r.r for r in rows[:3]] == ["retrieve", "assert", "enumerate"]
    assert [r.c for r in rows] == [False, False, False, True, False] and rows[0].o == 5 and rows[1].o is None
