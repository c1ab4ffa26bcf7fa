"""Frames of scored responses: from response and prompt records, from earlier runs, and sheets for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphspark.functions import answers, claims, detect
from graphspark.operators import features, inference, prompts, structure

RESPONSE_KEY = ("model", "instance_id", "condition", "style", "node_naming")


def parsed_id(instance_id: Column) -> Column:
    """struct(task, size, density, seed, idx) of ``task/size40/p0.10[/s123]/7``; another form raises."""
    rx = r"^(.+)/size([0-9]+)/p([0-9.]+)(?:/s([0-9]+))?/([0-9]+)$"
    part = lambda g, kind: F.nullif(F.regexp_extract(instance_id, rx, g), F.lit("")).cast(kind)
    fields = F.struct(part(1, "string").alias("task"), part(2, "int").alias("size"), part(3, "double").alias("density"), part(4, "long").alias("seed"), part(5, "int").alias("idx"))
    return F.when(instance_id.rlike(rx), fields).otherwise(F.raise_error(F.concat(F.lit("no instance id: "), instance_id)))


def target_features(rows: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (graph_id, task, targets, gold) with what is known of the queried node or pair.

    target_id, target_degree, target_clustering, pair_common_neighbors, pair_distance (-1 across
    components), gold_is_yes, gold_magnitude; null where a task has none.
    """
    on_node = F.col("task").isin("node_degree", "connected_nodes", "edge_existence")
    a, b = F.get("targets", F.lit(0)), F.when(F.col("task") == "edge_existence", F.get("targets", F.lit(1)))
    asked = rows.withColumn("target_id", F.when(on_node, a)).withColumn("_b", b)
    stats = structure.clustering(edges, nodes).select("graph_id", F.col("node").alias("target_id"), F.col("degree").alias("target_degree"), F.round("clustering", 6).alias("target_clustering"))
    pairs = asked.where("_b is not null").select("graph_id", F.col("target_id").alias("a"), F.col("_b").alias("b")).distinct()
    shared = structure.common_neighbours(edges, pairs).withColumnRenamed("shared", "pair_common_neighbors")
    far = structure.distances(edges, nodes).select("graph_id", F.col("src").alias("_s"), F.col("dst").alias("_t"), F.col("dist").alias("_d"))
    out = asked.join(stats, ["graph_id", "target_id"], "left")
    out = out.join(shared.withColumnsRenamed({"a": "target_id", "b": "_b"}), ["graph_id", "target_id", "_b"], "left")
    out = out.withColumns({"_s": F.least("target_id", "_b"), "_t": F.greatest("target_id", "_b")}).join(far, ["graph_id", "_s", "_t"], "left")
    pair = F.col("_b").isNotNull()
    yes = F.lower(F.trim("gold")).startswith("y").cast("int")
    return out.withColumns(
        {
            "pair_distance": F.when(pair, F.when(F.col("target_id") == F.col("_b"), 0).otherwise(F.coalesce("_d", F.lit(-1)))),
            "gold_is_yes": F.when(F.col("task").isin("edge_existence", "cycle_check"), yes),
            "gold_magnitude": F.when(F.col("task").isin(*answers.INTEGER_TASKS), F.trim("gold").try_cast("int")),
        }
    ).drop("_b", "_s", "_t", "_d")


def main_frame(responses: DataFrame, asked: DataFrame, order: Sequence[str] = ("file", "line")) -> DataFrame:
    """Scored responses joined with the graphs that their prompts encode.

    ``asked`` is (instance_id, task, condition, prompt, gold, edges) as saved; the first response of
    each key in ``order`` (the columns of it that exist) counts. A gold answer that differs from the
    prompt's raises: such a frame is not to be trusted.
    """
    key = [k for k in RESPONSE_KEY if k in responses.columns]
    at = [c for c in order if c in responses.columns] or ["response"]
    first = inference.first_rows(responses, key, at)
    known = prompts.graphs_of_prompts(asked).select("instance_id", F.col("gold").alias("asked_gold"), F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), "targets")
    lengths = asked.groupBy("instance_id", "condition").agg(F.max(F.length("prompt")).alias("prompt_chars"))
    rows = first.join(known, "instance_id").join(lengths, ["instance_id", "condition"], "left")
    same = F.col("gold") == F.col("asked_gold")
    rows = rows.withColumn("gold", F.when(same, F.col("gold")).otherwise(F.raise_error(F.concat(F.lit("gold mismatch at "), F.col("instance_id"))))).drop("asked_gold")
    text = F.coalesce("response", F.lit(""))
    out = rows.withColumn("pred", answers.answer(text, F.col("task"))).withColumn("s", answers.score(F.col("pred"), F.col("gold"), F.col("task")))
    signed = answers.normalise(F.col("pred")).try_cast("long") - answers.normalise(F.col("gold")).try_cast("long")
    out = out.withColumns({"exact": F.col("s.exact"), "f1": F.col("s.primary"), "abs_error": F.col("s.absolute_error"), "parsed": F.col("s.parsed").cast("int"), "signed_error": F.when(F.col("task").isin(*answers.INTEGER_TASKS), signed)})
    return out.withColumn("outcome", answers.outcome(F.col("exact"), F.col("hit_cap"))).withColumn("resp_chars", F.length(text)).drop("s")


def wording(task: Column, condition: Column, style: Column) -> Column:
    """``revised`` for filler primers and edge questions, else ``unaffected``; another style than zero_shot raises."""
    label = F.when((condition == "filler") | (task == "edge_existence"), "revised").otherwise("unaffected")
    return F.when(style == "zero_shot", label).otherwise(F.raise_error(F.concat(F.lit("unknown prompt style: "), style)))


def run_frame(records: DataFrame, truncated_keys: DataFrame, bars: DataFrame) -> DataFrame:
    """Scored responses of earlier runs, with how each one failed.

    A row's own hit_cap counts where it has one, else ``truncated_keys`` (model, instance_id,
    condition, style). A response that did not end scores 0 and keeps what that hides: whether it
    was right, or right in part, and whether its first and last answer agree. ``bars`` is (task,
    condition, shortcut_score).
    """
    naming = F.coalesce("node_naming", F.lit("integer")) if "node_naming" in records.columns else F.lit("integer")
    listed = truncated_keys.select("model", "instance_id", "condition", "style").distinct().withColumns({"node_naming": F.lit("integer"), "_listed": F.lit(True)})
    rows = records.withColumn("node_naming", naming).join(listed, list(RESPONSE_KEY), "left").join(F.broadcast(bars), ["task", "condition"], "left")
    text, task = F.col("response"), F.col("task")
    rows = rows.withColumn("predicted", answers.answer(text, task)).withColumn("predicted_first", answers.answer(text, task, last=False)).withColumn("s", answers.score(F.col("predicted"), F.col("gold"), task))
    endless = F.coalesce("hit_cap", "_listed", F.lit(False))
    source = F.coalesce("token_count_source", F.lit("generator")) if "token_count_source" in records.columns else F.lit("generator")
    rows = rows.withColumn("non_terminating", endless)
    full, part = F.col("s.exact") == 1, F.col("s.primary") > 0
    zero = lambda c: F.when(F.col("non_terminating"), F.lit(0.0)).otherwise(F.col(c))
    out = rows.select(
        "instance_id", "task", "condition", "style", "gold", "model", F.regexp_replace("model", "-think$", "").alias("model_family"), F.col("model").endswith("-think").alias("is_think"), "node_naming",
        "predicted", "predicted_first", F.when(F.col("non_terminating"), F.coalesce(F.col("predicted_first") == F.col("predicted"), F.lit(False)) & full).alias("looped_on_correct_answer"),
        F.col("s.parsed").alias("parsed"), zero("s.exact").alias("exact"), zero("s.primary").alias("primary"), (F.col("non_terminating") & full).alias("truncated_but_correct"),
        (F.col("non_terminating") & part & ~full).alias("truncated_but_partial_credit"), F.col("s.absolute_error").alias("absolute_error"), "non_terminating",
        F.when(F.col("hit_cap").isNotNull(), source).otherwise("ground_truth_file").alias("non_terminating_source"), "n_new_tokens", wording(task, F.col("condition"), F.col("style")).alias("wording"),
        answers.has_marker(text).alias("has_marker"), "shortcut_score", F.length(text).alias("response_len_chars"), answers.failure_type(F.col("non_terminating"), F.col("s.parsed"), F.col("s.exact")).alias("failure_type"),
    )
    return inference.length_outliers(out, ["model", "task", "condition", "style"], "response_len_chars")


def mixed_namings(rows: DataFrame) -> DataFrame:
    """Naming schemes of rows that should have one: a check that should return at most a row."""
    return rows.select(F.coalesce("node_naming", F.lit("integer")).alias("node_naming")).groupBy("node_naming").agg(F.count(F.lit(1)).alias("rows"))


def repeated_keys(rows: DataFrame, keys: Sequence[str] = RESPONSE_KEY) -> DataFrame:
    """Keys of more than one row: a check that should find nothing."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def failure_sample(frame: DataFrame, per_stratum: int, seed: int = 0) -> DataFrame:
    """At most so many failures of each model and kind, in a seeded order."""
    key = F.struct(F.xxhash64(F.lit(seed), *(F.col(c) for c in ("model", "instance_id", "condition", "style"))), F.col("instance_id"), F.col("condition"))
    return inference.seeded_sample(frame.where("failure_type <> 'correct'"), ["model", "failure_type"], key, per_stratum)


def enriched(sample: DataFrame, responses: DataFrame, asked: DataFrame, chars: int = 400) -> DataFrame:
    """A sample with the start and end of each response and the size of its prompt."""
    key = ["model", "instance_id", "condition", "style"]
    text = responses.select(*key, F.left(F.col("response"), F.lit(chars)).alias("response_start"), F.right(F.col("response"), F.lit(chars)).alias("response_end"))
    sizes = asked.groupBy("instance_id", "condition", "style").agg(F.max(F.length("prompt")).alias("prompt_chars"))
    return sample.join(text, key, "left").join(sizes, ["instance_id", "condition", "style"], "left")


def flip_sheet(frame: DataFrame, key: Sequence[str], per_kind: int, seed: int = 0, chars: int = 200) -> DataFrame:
    """Pairs whose outcome a condition changed, so many of each arm, condition and direction, with snippets.

    ``frame`` has arm, condition, outcome, response and the columns of ``key``.
    """
    snippet = lambda c, side: side(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), F.lit(chars))
    joined = inference.pairs(frame, key, "condition", "none", ["outcome", "response"]).where("outcome_a <> outcome_b")
    order = F.xxhash64(F.lit(seed), "condition", *key)
    kept = inference.seeded_sample(joined, [k for k in key if k == "arm"] + ["condition", "outcome_a", "outcome_b"], F.struct(order, *key), per_kind)
    place = Window.partitionBy("condition").orderBy(order)
    return kept.select(
        *key, "condition", "outcome_a", "outcome_b", snippet("response_a", F.left).alias("start_a"), snippet("response_a", F.right).alias("end_a"), snippet("response_b", F.left).alias("start_b"),
        snippet("response_b", F.right).alias("end_b"), F.row_number().over(place).alias("rank"),
    )


def graph_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, degrees map, edges array, printed array): what responses are held against.

    ``printed`` are the decimals that a graph's primers print, of clustering and return probabilities.
    """
    values = features.printed_values(edges, nodes)
    per = values.groupBy("graph_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("node"), F.col("degree").cast("int")))).alias("degrees"),
        F.array_distinct(F.flatten(F.collect_list(F.array("clustering", "rwse2", "rwse3")))).alias("printed"),
    )
    known = edges.groupBy("graph_id").agg(F.collect_list(F.struct("u", "v")).alias("edges"))
    return per.join(known, "graph_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<u:int,v:int>>")))


def pattern_frame(frame: DataFrame, facts: DataFrame) -> DataFrame:
    """A frame with one 0/1 column for each of the 22 patterns, null for tasks that a pattern does not belong to.

    Also ``table_right`` (the share of a degree table's values that are right, where there is a table),
    ``chain`` (the first broken step from degrees to an edge count), ``copied`` and ``copy_chance`` (a
    wrong degree that a neighbouring id has). ``frame`` has task, response, pred, exact, hit_cap, a, b and
    nbrs; ``facts`` is what ``graph_facts`` gives: one join by graph serves all patterns.
    """
    text, task = F.coalesce("response", F.lit("")), F.col("task")
    j = frame.join(facts, "graph_id")
    j = j.withColumns({"_table": F.when(task == "edge_count", claims.degree_table(text, F.array_max(F.map_keys("degrees")) + 1)), "_targets": F.array("a", "b")})
    table = F.coalesce("_table", F.create_map().cast("map<int,int>"))
    told = F.map_entries(table)
    right = F.size(F.filter(told, lambda e: F.try_element_at("degrees", e["key"]) == e["value"])) / F.size(told)
    pred = F.when(~F.col("hit_cap"), F.col("pred").try_cast("int"))
    chain = F.when(task == "edge_count", claims.edge_chain(table, F.col("degrees"), claims.halving(text), pred, F.col("hit_cap")))
    copied = F.when(task == "node_degree", detect.copy_kind(F.col("pred"), F.col("exact"), F.col("hit_cap"), F.col("degrees"), F.col("a")))
    flags = [*detect.pattern_flags(text, F.col("_targets"), task, F.col("nbrs")), *detect.numeric_flags(text, task, table, F.col("degrees"), F.col("edges"), F.col("printed"))]
    more = [
        F.when((task == "edge_count") & (F.size(table) >= detect.TABLE_SHARE * F.size("degrees")), right).alias("table_right"), chain.alias("chain"), copied.alias("copied"),
        F.when(copied.isNotNull(), claims.near_chance(F.col("a"), F.col("pred").try_cast("int"), F.col("degrees"))).alias("copy_chance"),
    ]
    return j.select(*frame.columns, *flags, *more)


def run_summaries(frame: DataFrame) -> DataFrame:
    """(block, model, a, b, n, value): baseline, conditions, non-termination and failures of earlier runs, one table."""
    def block(name: str, group: Sequence[str], value: Column, rows: DataFrame = frame) -> DataFrame:
        cols = [F.col(g).cast("string") for g in group] + [F.lit(None).cast("string")] * (2 - len(group))
        out = rows.groupBy("model", *group).agg(F.count(F.lit(1)).alias("n"), value.alias("value"))
        return out.select(F.lit(name).alias("block"), "model", cols[0].alias("a"), cols[1].alias("b"), "n", "value")

    parts = [
        block("baseline", ["task"], F.avg("primary"), frame.where("condition = 'none'")),
        block("condition", ["task", "condition"], F.avg("primary")),
        block("non_termination", ["task", "condition"], F.avg(F.col("non_terminating").cast("double"))),
        block("failure", ["failure_type"], F.avg(F.lit(1.0))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- joins that hold their sides to something ----------------------------------------------------


def strict_join(left: DataFrame, right: DataFrame, keys: Sequence[str], same: Sequence[str] = ()) -> DataFrame:
    """An inner join in which a left row without a counterpart, or one whose ``same`` columns differ, raises."""
    marked = right.withColumnsRenamed({c: f"_r_{c}" for c in same}).withColumn("_hit", F.lit(True))
    joined = left.join(marked, list(keys), "left")
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    ok = F.col("_hit").isNotNull()
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no equal counterpart: "), name)))
    return joined.withColumn("_ok", checked).where("_ok").drop("_ok", "_hit", *(f"_r_{c}" for c in same))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that raises where a key has several rows on a side."""
    def single(rows: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
        ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("several rows of "), name)))
        return rows.withColumn("_n", n).where(ok).drop("_n")

    return single(left).join(single(right), list(keys))


def realigned(rows: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key of ``index``, null where ``rows`` has none."""
    return index.select(*keys).join(rows, list(keys), "left")


def in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): distinct values by where they first come."""
    return rows.groupBy(value).agg(F.min(order).alias("first")).orderBy("first")


def budget_groups(rows: DataFrame, length: str, budget: int, key: str, group: Sequence[str] = (), salts: int = 64) -> DataFrame:
    """``rows`` with ``chunk`` (long, from 0 in each group): greedy cuts of the rows in order of length.

    A chunk takes rows, shortest first, for as long as its number times its longest stays within the
    budget, and one row at least: what a loop over the sorted rows would cut. That loop's state when
    it comes to a length follows from how many rows of each shorter length there are, so it runs over
    the distinct lengths of a group only. Within a length, rows are numbered over ``salts`` parts by the
    hash of ``key``, which must tell rows apart, so that no task numbers all rows of a common length.
    """
    part = list(group)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    sizes = salted.groupBy(*part, length, "_salt").agg(F.count(F.lit(1)).alias("_k"))
    ahead = Window.partitionBy(*part, length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(ahead), F.lit(0)))
    lengths = sizes.groupBy(*part, length).agg(F.sum("_k").alias("_n"))
    runs = lengths.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(F.col(length).cast("long").alias("l"), F.col("_n").alias("n")))).alias("_runs"))
    entry = "array<struct<l:bigint,open:bigint,chunk:bigint>>"

    def step(seen: Column, run: Column) -> Column:
        most = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(run["l"], F.lit(1)))).cast("long")
        # What the open chunk still takes, then whole chunks, then what is left open.
        room = F.when(seen["open"] > 0, F.least(run["n"], F.greatest(most - seen["open"], F.lit(0)))).otherwise(F.lit(0)).cast("long")
        rest = run["n"] - room
        started = F.ceil(rest / most).cast("long")
        chunk = seen["chunk"] + started
        left = F.when(rest == 0, seen["open"] + room).otherwise(rest - (started - 1) * most)
        return F.struct(left.cast("long").alias("open"), chunk.cast("long").alias("chunk"), F.concat(seen["out"], F.array(F.struct(run["l"].alias("l"), seen["open"].alias("open"), seen["chunk"].alias("chunk"))).cast(entry)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("open"), F.lit(-1).cast("long").alias("chunk"), F.array().cast(entry).alias("out"))
    entries = runs.select(*part, F.inline(F.aggregate("_runs", zero, step, lambda seen: seen["out"]))).withColumnsRenamed({"l": "_l", "open": "_open", "chunk": "_chunk"})
    inside = F.row_number().over(Window.partitionBy(*part, length, "_salt").orderBy(key)) - 1
    placed = salted.withColumn("_in", inside).join(offsets.drop("_k"), [*part, length, "_salt"])
    entries = entries.withColumnsRenamed({g: f"_g_{g}" for g in part})
    on = [F.col(length).cast("long") == F.col("_l"), *(F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in part)]
    j = placed.join(entries, on).withColumn("_r", F.col("_before") + F.col("_in"))
    most = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("_l"), F.lit(1)))).cast("long")
    room = F.when(F.col("_open") > 0, F.greatest(most - F.col("_open"), F.lit(0))).otherwise(F.lit(0))
    chunk = F.when(F.col("_r") < room, F.col("_chunk")).otherwise(F.col("_chunk") + 1 + F.floor((F.col("_r") - room) / most))
    return j.select(*rows.columns, chunk.cast("long").alias("chunk"))


def balanced_pick(rows: DataFrame, factors: Sequence[str], k: int, key: str) -> DataFrame:
    """k rows that hold the levels of several factors as evenly as a greedy choice can.

    The candidates are reduced to the first k of each combination of levels by ``key`` before they
    come together, so that what is chosen from does not grow with the rows.
    """
    order = Window.partitionBy(*factors).orderBy(key)
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")

    def choose(pdf):
        pdf = pdf.sort_values(key).reset_index(drop=True)
        used = [{} for _ in factors]
        left, taken = list(range(len(pdf))), []
        while left and len(taken) < k:
            cost = [sum(u.get(pdf.at[i, f], 0) for u, f in zip(used, factors)) for i in left]
            i = left.pop(min(range(len(left)), key=lambda j: (cost[j], left[j])))
            taken.append(i)
            for u, f in zip(used, factors):
                u[pdf.at[i, f]] = u.get(pdf.at[i, f], 0) + 1
        return pdf.loc[taken]

    return few.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: choose(pdf.drop(columns="_all")), few.schema)
