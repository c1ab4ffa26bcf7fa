"""Registered queries over the test tables, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.functions import answers, claims, detect, fmt, probability
from graphspark.operators import encode, inference, primer, resample, solver, statistics, structure, tasks
from graphspark.operators import rewire as rewiring
from graphspark.plans import study
from graphspark.sources import graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The order tables' graphs."""
    return graphs.order_graphs(spark, d)


# --- the graph collection of the order tables ----------------------------------------------------


@query
def node_degree(spark, d):
    return structure.degrees(*_graphs(spark, d))


@query
def edge_count(spark, d):
    return structure.edge_count(*_graphs(spark, d))


@query
def node_count(spark, d):
    return structure.node_count(_graphs(spark, d)[1])


@query
def neighbor_list(spark, d):
    near = structure.neighbours(_graphs(spark, d)[0])
    return near.select("graph_id", "node", F.array_join(F.transform("nbrs", lambda n: n.cast("string")), ", ").alias("answer"))


@query
def triangle_count(spark, d):
    return structure.triangle_count(*_graphs(spark, d))


@query
def clustering_coeff(spark, d):
    return _round(structure.clustering(*_graphs(spark, d)), "clustering")


@query
def rwse2(spark, d):
    return _round(structure.return_probabilities(*_graphs(spark, d), steps=2), "rwse2")


@query
def rwse3(spark, d):
    return _round(structure.statistics_by_graph(*_graphs(spark, d)).select("graph_id", "node", "rwse3"), "rwse3")


@query
def component_count(spark, d):
    return structure.component_count(*_graphs(spark, d))


@query
def shortest_path(spark, d):
    edges, nodes = _graphs(spark, d)
    return structure.distances(edges, nodes).groupBy("graph_id", "dist").agg(F.count(F.lit(1)).alias("pairs"))


@query
def modal_degree_share(spark, d):
    return _round(structure.modal_degree_share(*_graphs(spark, d)), "share")


@query
def rendered_clustering_sd(spark, d):
    c = structure.clustering(*_graphs(spark, d))
    return _round(c.groupBy("graph_id").agg(F.stddev_pop(fmt.two_decimals(F.col("clustering")).cast("double")).alias("sd")), "sd", places=6)


@query
def topology_row(spark, d):
    return _round(structure.topology(*_graphs(spark, d)), "density_real", "mean_degree", "mean_clustering")


@query
def rwse_degree_corr(spark, d):
    return _round(structure.rwse_degree_correlation(*_graphs(spark, d)), "r", places=6)


def _gold(task: str) -> Query:
    def run(spark, d):
        edges, nodes = _graphs(spark, d)
        return tasks.gold(task, edges, nodes, tasks.targets(nodes)).select("graph_id", "a", "b", "gold")

    return run


for _task in ("edge_existence", "reachability", "cycle_check", "connected_nodes", "disconnected_nodes", "maximum_flow"):
    QUERIES[f"gold_{_task}"] = _gold(_task)


@query
def common_neighbors(spark, d):
    edges, nodes = _graphs(spark, d)
    return structure.common_neighbours(edges, edges.select("graph_id", F.col("u").alias("a"), F.col("v").alias("b")))


@query
def corpus_report(spark, d):
    report = structure.corpus_report(structure.topology(*_graphs(spark, d)))
    return _round(report.drop("density_deciles"), "connected", "edgeless", "triangle_free", "mean_clustering")


@query
def multiset_diff(spark, d):
    """Graphs (by node count and edge list) that even customers have more often than odd ones."""
    keys = structure.graph_keys(*_graphs(spark, d))
    even, odd = keys.where("graph_id % 2 = 0"), keys.where("graph_id % 2 = 1")
    return structure.multiset_difference(even, odd)[0]


@query
def rewire_triangles(spark, d):
    """Triangles before and after rewiring either way; degrees stay."""
    edges, nodes = _graphs(spark, d)
    return rewiring.rewired_triangles(edges, nodes, times=1)


@query
def rng_corpus(spark, d):
    """Graphs and mean degrees of a generated pool, by algorithm."""
    keys = graphs.pool_keys(spark, 140, seed=1234)
    edges, nodes = graphs.generate(spark, keys)
    per = structure.degrees(edges, nodes).groupBy("graph_id").agg(F.avg("degree").alias("d"))
    return keys.join(per, "graph_id").groupBy("algorithm").agg(F.count(F.lit(1)).alias("graphs"), F.round(F.avg("d"), 9).alias("mean_degree"))


@query
def arithmetic_density(spark, d):
    edges, nodes = graphs.arithmetic_corpus(spark, 50)
    return _round(edges.groupBy((F.col("graph_id") % 4).alias("level")).agg((F.count(F.lit(1)) / (50 * 780)).alias("density")), "density")


@query
def exact_island(spark, d):
    return solver.exact_island(graphs.labelled_graphs(spark, 5))


# --- text about graphs -------------------------------------------------------------------------


def _text(encoder: str) -> Query:
    def run(spark, d):
        return encode.encode(*_graphs(spark, d), encoder)

    return run


for _encoder in ("adjacency", "incident", "friendship", "triples"):
    QUERIES[f"{_encoder}_text"] = _text(_encoder)


def _primer(condition: str) -> Query:
    def run(spark, d):
        return primer.render(*_graphs(spark, d), condition)

    return run


for _condition in ("components", "degree", "filler", "clustering", "rwse", "all"):
    QUERIES[f"primer_{_condition}"] = _primer(_condition)


@query
def primer_roundtrip_check(spark, d):
    """Nodes whose degree does not come back from the text: none."""
    edges, nodes = _graphs(spark, d)
    parsed = primer.parse(primer.render(edges, nodes, "degree")).select("graph_id", F.explode("degree").alias("node", "said"))
    both = structure.degrees(edges, nodes).join(parsed, ["graph_id", "node"], "full")
    return both.where("said is null or degree is null or said <> degree").select("graph_id", "node", "degree", "said")


@query
def primer_parse_degree(spark, d):
    parsed = primer.parse(primer.render(*_graphs(spark, d), "degree"))
    total = F.aggregate(F.map_values("degree"), F.lit(0), lambda s, x: s + x)
    return parsed.select("graph_id", F.size("ns").alias("n"), total.alias("degree_sum"))


@query
def prompt_stats(spark, d):
    """Median characters that each condition's primer adds."""
    edges, nodes = _graphs(spark, d)
    rows = None
    for c in ("components", "degree", "filler"):
        one = primer.render(edges, nodes, c).select(F.lit(c).alias("condition"), F.length("primer").alias("chars"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("condition").agg(F.median("chars").alias("median_chars"), F.count(F.lit(1)).alias("prompts"))


@query
def prompt_build(spark, d):
    edges, nodes = _graphs(spark, d)
    asked = tasks.targets(nodes).select("graph_id", "a", "b", tasks.question("node_degree").alias("question"))
    texts = primer.render(edges, nodes, "degree").join(encode.encode(edges, nodes), "graph_id").join(asked, "graph_id")
    return texts.select("graph_id", primer.build_prompt(F.col("primer"), F.col("text"), F.col("question")).alias("prompt"))


# --- the solver --------------------------------------------------------------------------------


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """Parsed degree primers with targets and the gold answers of every task; n is granted, m is not."""
    edges, nodes = _graphs(spark, d)
    parsed = primer.parse(primer.render(edges, nodes, "degree"))
    rows = parsed.join(study.facts(edges, nodes).select("graph_id", "a", "b", "golds"), "graph_id").withColumn("m", F.lit(None).cast("int"))
    return rows.withColumn("n", F.when(F.size("ns") > 0, F.size("ns")).cast("int"))


@query
def solver_theorems(spark, d):
    """How often each rule on stated degrees answers, and how often rightly."""
    rows = _contexts(spark, d)
    said = [
        F.struct(F.lit(task).alias("task"), F.lit(name).alias("rule"), answer.alias("said"), F.col("golds")[task].alias("gold"))
        for task in ("edge_existence", "node_degree", "cycle_check") for name, answer in solver.theorems()[task]
    ]
    one = rows.select(F.explode(F.array(*said)).alias("x")).select("x.*")
    right = F.col("said") == F.when(F.col("task") == "cycle_check", F.substring_index("gold", ",", 1)).otherwise(F.col("gold"))
    return one.groupBy("task", "rule").agg(F.count("said").alias("fired"), F.sum(F.when(right, 1).otherwise(0)).alias("right"))


@query
def solver_bars(spark, d):
    """Accuracy of theorems with the majority answer behind them, for stated degrees: one pass for all tasks."""
    said = [
        F.struct(F.lit(task).alias("task"), F.coalesce(*(answer for _, answer in solver.theorems()[task])).alias("said"), F.col("golds")[task].alias("gold"))
        for task in ("edge_existence", "edge_count", "node_degree")
    ]
    one = _contexts(spark, d).select(F.explode(F.array(*said)).alias("x")).select("x.*")
    counts = one.groupBy("task", "said", "gold").agg(F.count(F.lit(1)).alias("k"))
    golds = counts.groupBy("task", "gold").agg(F.sum("k").alias("k"))
    base = golds.groupBy("task").agg(F.max_by("gold", F.struct("k", "gold")).alias("base"))
    hit = (F.coalesce("said", "base") == F.col("gold")).cast("double")
    out = counts.join(F.broadcast(base), "task").groupBy("task").agg((F.sum(hit * F.col("k")) / F.sum("k")).alias("bar"), F.sum("k").alias("n"))
    return _round(out, "bar")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a quality label: a lookup key, a feature, a yes/no gold answer and a fold."""
    docs = _read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = _read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("gold"))
    return docs.join(labels, "doc_id").withColumn("fold", F.col("doc_id") % 2)


@query
def solver_lookup_fit(spark, d):
    """Majority answer by language fitted on even documents, judged on odd ones."""
    rows = _labelled(spark, d)
    table = solver.fit_lookup(rows.where("fold = 0"), ["lang"])
    judged = solver.apply_lookup(rows.where("fold = 1"), table, ["lang"])
    return _round(judged.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("answer") == F.col("gold")).cast("double")).alias("accuracy")), "accuracy")


@query
def solver_threshold_fit(spark, d):
    return solver.fit_threshold(_labelled(spark, d).where("fold = 0"), "n_chars", "gold")


@query
def solver_line_fit(spark, d):
    """Edge counts from node counts, by least squares."""
    topo = structure.node_count(_graphs(spark, d)[1]).join(structure.edge_count(*_graphs(spark, d)), "graph_id")
    return _round(solver.fit_line(topo, "n_nodes", "n_edges"), "slope", "intercept", places=6)


# --- responses ---------------------------------------------------------------------------------


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses from the event table: a user is a unit, an event type a condition, arms by id."""
    e = _read(spark, d, "events")
    v = F.floor(F.col("value"))
    node = F.pmod("event_id", F.lit(40))
    gold = F.pmod("user_id", F.lit(20))
    hit = (v % 10) < 6
    said = F.when(hit, gold).otherwise(gold + 1 + v % 3)
    style = F.pmod("event_id", F.lit(5))
    text = (
        F.when(style == 0, F.concat(F.lit("The degree of node "), node.cast("string"), F.lit(" is **"), said.cast("string"), F.lit("**.")))
        .when(style == 1, F.concat(F.lit("Node "), node.cast("string"), F.lit(" is connected to node 3.\nThe answer is "), said.cast("string"), F.lit(". This is because node 99 is far.")))
        .when(style == 2, F.concat(F.lit("Final answer: "), said.cast("string")))
        .when(style == 3, F.concat(F.lit("I count "), said.cast("string"), F.lit(" edges at node "), node.cast("string"), F.lit(".")))
        .otherwise(F.concat(F.lit("Answer: it is "), said.cast("string"), F.lit(". Not "), (said + 7).cast("string"), F.lit(".")))
    )
    return e.select(
        "event_id",
        F.concat(F.lit("m"), F.pmod("event_id", F.lit(4)).cast("string")).alias("arm"),
        F.when(F.col("event_type") == "view", "none").otherwise(F.col("event_type")).alias("condition"),
        F.col("user_id").alias("unit"),
        F.lit("node_degree").alias("task"),
        gold.cast("string").alias("gold"),
        text.alias("response"),
        (F.pmod("event_id", F.lit(13)) == 0).alias("hit_cap"),
        F.floor(F.col("value") * 10).alias("n_tokens"),
    )


def frame(spark: SparkSession, d: str) -> DataFrame:
    """Scored responses, the first of each (arm, unit, condition)."""
    first = inference.first_rows(responses(spark, d), ["arm", "unit", "condition"], ["event_id"])
    rows = first.withColumn("pred", answers.answer(F.col("response"), F.col("task")))
    rows = rows.withColumn("s", answers.score(F.col("pred"), F.col("gold"), F.col("task")))
    rows = rows.withColumn("outcome", answers.outcome(F.col("s.exact"), F.col("hit_cap")))
    return rows.select(
        *first.columns, "pred", F.col("s.exact").cast("int").alias("exact"), F.col("s.absolute_error").alias("abs_error"), "outcome",
        (F.col("outcome") == "correct").cast("int").alias("correct"), F.col("hit_cap").cast("int").alias("truncated"),
    )


PAIR = ["arm", "unit"]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return inference.pairs(frame(spark, d), PAIR, "condition", "none", ["correct", "truncated", "n_tokens"])


@query
def extract_integer(spark, d):
    return responses(spark, d).select("event_id", answers.integer_answer(F.col("response")).alias("pred"), answers.integer_answer(F.col("response"), last=False).alias("pred_first"))


@query
def extract_boolean(spark, d):
    """Yes or no in every turn of conversations, some of which are given one."""
    turns = _read(spark, d, "conversations")
    text = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " Answer: Yes.").when(F.col("turn") % 3 == 1, " There are no nodes. So no").otherwise(""))
    return turns.select("conv_id", "turn", answers.boolean_answer(text).alias("answer"))


@query
def extract_node_list(spark, d):
    edges, nodes = _graphs(spark, d)
    rows = tasks.gold("connected_nodes", edges, nodes, tasks.targets(nodes))
    text = F.concat(F.lit("Looking at node "), F.col("a").cast("string"), F.lit(".\nSo node "), F.col("a").cast("string"), F.lit(" is connected to: **"), F.col("gold"), F.lit("**."))
    return rows.select("graph_id", answers.list_answer(text).alias("answer"))


@query
def score_rows(spark, d):
    return frame(spark, d).select("event_id", "pred", "exact", "abs_error", "outcome")


@query
def score_set_f1(spark, d):
    """F1 of the neighbours of one target read for another's."""
    edges, nodes = _graphs(spark, d)
    near = structure.neighbours(edges).select("graph_id", "node", "nbrs")
    t = tasks.targets(nodes)
    two = t.join(near.select("graph_id", F.col("node").alias("a"), F.col("nbrs").alias("na")), ["graph_id", "a"], "left").join(
        near.select("graph_id", F.col("node").alias("b"), F.col("nbrs").alias("nb")), ["graph_id", "b"], "left"
    )
    empty = F.array().cast("array<int>")
    return _round(two.select("graph_id", answers.set_f1(F.coalesce("na", empty), F.coalesce("nb", empty)).alias("f1")), "f1")


@query
def majority_baseline(spark, d):
    return _round(inference.majority(responses(spark, d), ["arm"], "gold"), "share")


@query
def outcome_shares(spark, d):
    return _round(inference.outcome_shares(frame(spark, d), ["arm", "condition"]), "correct", "wrong", "truncated")


@query
def pairs_inner(spark, d):
    return _pairs(spark, d).select("arm", "unit", "condition", "correct_a", "correct_b", "truncated_a", "truncated_b")


@query
def effect_main(spark, d):
    """The main table: paired change of accuracy by arm and condition with exact p and q."""
    joined = _pairs(spark, d)
    counts = inference.with_mcnemar(inference.paired_counts(joined, ["arm", "condition"], "correct"))
    cut = inference.paired_counts(joined, ["arm", "condition"], "truncated").select("arm", "condition", F.col("delta").alias("d_truncated"))
    out = inference.with_q(counts).join(cut, ["arm", "condition"])
    return _round(out, "share_a", "share_b", "delta", "p", "q", "d_truncated")


@query
def mcnemar(spark, d):
    counts = inference.with_mcnemar(inference.paired_counts(_pairs(spark, d), ["condition"], "correct"))
    return _round(counts.select("condition", "broke", "fixed", "p"), "p")


@query
def bh_qvalues(spark, d):
    counts = inference.with_mcnemar(inference.paired_counts(_pairs(spark, d), ["arm", "condition"], "correct"))
    return _round(inference.with_q(counts, family=["arm"]).select("arm", "condition", "p", "q"), "p", "q")


@query
def holm(spark, d):
    counts = inference.with_mcnemar(inference.paired_counts(_pairs(spark, d), ["arm", "condition"], "correct"))
    return _round(inference.with_holm(counts).select("arm", "condition", "holm"), "holm")


@query
def paired_interval(spark, d):
    counts = inference.paired_counts(_pairs(spark, d), ["arm", "condition"], "correct")
    i = probability.exact_paired_interval("broke", "fixed", "n")
    return _round(counts.withColumn("i", i).select("arm", "condition", "delta", F.col("i.low").alias("low"), F.col("i.high").alias("high")), "delta", "low", "high")


@query
def mde_closed_form(spark, d):
    counts = inference.paired_counts(_pairs(spark, d), ["condition"], "correct")
    share = (F.col("broke") + F.col("fixed")) / F.col("n")
    return _round(counts.select("condition", probability.mde_points(share, F.col("n")).alias("mde")), "mde", places=6)


@query
def baseline_bands(spark, d):
    """Paired change by the unit's band of accuracy without a primer."""
    joined = _pairs(spark, d)
    base = frame(spark, d).where("condition = 'none'").groupBy("unit").agg(F.avg("correct").alias("base"))
    rows = joined.join(base, "unit").withColumn("band", inference.banded(F.col("base"), [0, 0.25, 0.5, 0.75, 0.9, 1.01]))
    return _round(inference.paired_counts(rows, ["band"], "correct").select("band", "n", "delta", "broke", "fixed"), "delta")


@query
def joint_tasks(spark, d):
    """Units that two arms both answer rightly, by condition."""
    f = frame(spark, d)
    a = f.where("arm = 'm0'").select("unit", "condition", F.col("correct").alias("x"))
    b = f.where("arm = 'm1'").select("unit", "condition", F.col("correct").alias("y"))
    return _round(a.join(b, ["unit", "condition"]).groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") * F.col("y")).cast("double")).alias("joint")), "joint")


@query
def balanced_accuracy(spark, d):
    rows = frame(spark, d).withColumn("gold_yes", (F.col("gold").cast("int") >= 10).cast("int"))
    return _round(inference.balanced_accuracy(rows, ["arm", "condition"], "gold_yes", "correct"), "yes_rate", "balanced")


@query
def pivot_churn(spark, d):
    """Units by their outcome under each condition of one arm."""
    wide = frame(spark, d).where("arm = 'm0'").groupBy("unit").pivot("condition", ["none", "click", "purchase"]).agg(F.first("outcome"))
    return wide.groupBy("none", "click", "purchase").agg(F.count(F.lit(1)).alias("units"))


@query
def kappa(spark, d):
    return _round(inference.kappa(_pairs(spark, d), "correct_a", "correct_b", ["condition"]), "observed", "expected", "kappa")


@query
def icc(spark, d):
    return _round(inference.icc(_pairs(spark, d), "unit", F.col("correct_b") - F.col("correct_a")), "icc")


@query
def length_outliers(spark, d):
    rows = inference.length_outliers(frame(spark, d), ["arm", "condition"], "n_tokens")
    return rows.groupBy("arm", "condition").agg(F.sum(F.col("length_outlier").cast("int")).alias("outliers"), F.count(F.lit(1)).alias("n"))


@query
def stratified_sample(spark, d):
    """Five failures of each arm and outcome, in a fixed order."""
    rows = frame(spark, d).where("outcome <> 'correct'")
    key = F.struct(F.pmod(F.col("event_id") * 7919, F.lit(10007)), F.col("event_id"))
    return inference.seeded_sample(rows, ["arm", "outcome"], key, 5).select("arm", "outcome", "event_id")


@query
def terciles(spark, d):
    rows = inference.terciles(frame(spark, d), ["arm"], ["n_tokens", "event_id"])
    return _round(rows.groupBy("arm", "tercile").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy")), "accuracy")


@query
def quartile_strata(spark, d):
    rows = inference.quartile_strata(frame(spark, d), ["condition"], ["n_tokens", "event_id"])
    return rows.groupBy("condition", "stratum").agg(F.count(F.lit(1)).alias("n"), F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi"))


@query
def anti_join_resume(spark, d):
    """Customers without an order: prompts still to run."""
    done = _read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _read(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query
def semi_join_truncated(spark, d):
    """Rows whose unit has a truncated control."""
    f = frame(spark, d)
    cut = f.where("condition = 'none' and truncated = 1").select("arm", "unit")
    return f.join(cut, ["arm", "unit"], "left_semi").groupBy("arm", "condition").agg(F.count(F.lit(1)).alias("n"))


@query
def grouping_levels(spark, d):
    f = frame(spark, d)
    out = f.groupingSets([["arm", "condition"], ["arm"], []], "arm", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))
    return _round(out.select("arm", "condition", "n", "accuracy"), "accuracy")


@query
def mae_imputation(spark, d):
    rows = inference.impute_errors(frame(spark, d), "task", "abs_error", F.col("correct") == 0)
    return _round(rows.groupBy("arm").agg(F.avg("imputed").alias("mae"), F.count("abs_error").alias("n")), "mae")


@query
def slope_within_arm(spark, d):
    return _round(inference.slope_within(frame(spark, d), ["arm"], "n_tokens", "correct"), "slope")


@query
def bootstrap_ci(spark, d):
    return resample.cluster_bootstrap(_pairs(spark, d), ["arm", "condition"], "unit", "correct_a", "correct_b", draws=500)


@query
def perm_clustered(spark, d):
    return resample.sign_flip_test(_pairs(spark, d), ["arm", "condition"], "unit", "correct_a", "correct_b", draws=500)


@query
def mde_sim(spark, d):
    """The smallest effect that the exact sign test finds with a power of 0.8."""
    return _round(statistics.detectable_effect(_pairs(spark, d), ["condition"]), "mde")


@query
def perm_within(spark, d):
    return _round(statistics.label_permutation(frame(spark, d), ["condition"], ["arm"], "truncated", "n_tokens", draws=200), "gap", "p")


# --- detectors ---------------------------------------------------------------------------------


@query
def route_classes(spark, d):
    rows = responses(spark, d)
    node = F.pmod("event_id", F.lit(40))
    return rows.select("arm", detect.route(F.col("response"), node).alias("route")).groupBy("arm", "route").agg(F.count(F.lit(1)).alias("n"))


@query
def marker_shares(spark, d):
    m = detect.marker_counts(F.col("response"), F.lit(40))
    rows = responses(spark, d).select("arm", m.alias("m"), answers.has_marker(F.col("response")).alias("marked"))
    return rows.groupBy("arm").agg(F.sum("m.node_mentions").alias("mentions"), F.sum(F.col("m.neighbours").cast("int")).alias("neighbours"), F.sum(F.col("marked").cast("int")).alias("marked"))


@query
def ngram_shifts(spark, d):
    """Word pairs by how many responses of each arm hold them."""
    rows = responses(spark, d).select("arm", F.explode(detect.ngrams(F.col("response"), 2)).alias("gram"))
    return rows.groupBy("gram").agg(*(F.sum((F.col("arm") == a).cast("int")).alias(a) for a in ("m0", "m1", "m2", "m3")))


@query
def phrase_topk(spark, d):
    """The ten commonest word triples of conversations."""
    rows = _read(spark, d, "conversations").select(F.explode(detect.ngrams(F.col("text"), 3)).alias("gram"))
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(10)


@query
def named_cycles(spark, d):
    """Closed walks that a text names on a graph, and how many are real."""
    edges, nodes = _graphs(spark, d)
    said = structure.triangles(edges).groupBy("graph_id").agg(F.min(F.struct("a", "b", "c")).alias("t"))
    arrow = F.lit(" -> ")
    s = lambda c: F.col(f"t.{c}").cast("string")
    text = F.concat(F.lit("Take "), s("a"), arrow, s("b"), arrow, s("c"), arrow, s("a"), F.lit(", a cycle."))
    walks = said.select("graph_id", F.explode(detect.walks(text)).alias("w"))
    steps = walks.select("graph_id", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i"), "w")
    steps = steps.select("graph_id", F.least(F.expr("w[i]"), F.expr("w[i + 1]")).alias("u"), F.greatest(F.expr("w[i]"), F.expr("w[i + 1]")).alias("v"))
    real = edges.select("graph_id", "u", "v", F.lit(1).alias("hit"))
    return steps.join(real, ["graph_id", "u", "v"], "left").groupBy("graph_id").agg(F.count(F.lit(1)).alias("steps"), F.count("hit").alias("real"))


@query
def stated_edges(spark, d):
    """Edges that responses state, by the neighbour named."""
    rows = responses(spark, d).select(F.explode(claims.statements("response")).alias("x"))
    return rows.select(F.explode("x.nbrs").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


@query
def loop_score(spark, d):
    """Conversation turns by the tenth that their loop score falls in."""
    rows = _read(spark, d, "conversations").select(F.floor(detect.loop_score("text") * 10).alias("tenth"))
    return rows.groupBy("tenth").agg(F.count(F.lit(1)).alias("turns"))
