"""What can be answered from a primer alone: rules over parsed primers, never over graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.functions.answers import normalise
from graphspark.operators.inference import majority, running_sums


def _deg(node: Column) -> Column:
    return F.try_element_at("degree", node)


def _degrees() -> Column:
    return F.map_values("degree")


def _returns(node: Column, k: int) -> Column:
    return F.try_element_at("rwse", F.concat_ws(":", node.cast("string"), F.lit(str(k))))


def _sum_degrees() -> Column:
    return F.aggregate(_degrees(), F.lit(0), lambda s, d: s + d)


def _edges_known() -> Column:
    return F.coalesce("m", F.when(F.size("degree") > 0, (_sum_degrees() / 2).cast("int")))


def _nodes_known() -> Column:
    return F.coalesce("n", F.when(F.size("ns") > 0, F.size("ns")))


def theorems() -> dict[str, list[tuple[str, Column]]]:
    """Task -> ordered (name, answer); an answer is null where a rule does not apply.

    A row has components, degree, clustering, rwse and ns as parsed, targets a and b, and n and m
    where they are granted.
    """
    a, b, n, m = F.col("a"), F.col("b"), _nodes_known(), _edges_known()
    rise = lambda node: (_returns(node, 2) == 0) & (F.coalesce(_returns(node, 3), F.lit(0.0)) == 0)
    live = F.size(F.filter(_degrees(), lambda d: d > 0))
    branching = F.size(F.filter(_degrees(), lambda d: d >= 2))
    some_walk = F.map_filter("rwse", lambda k, p: k.endswith(":3") & (p > 0))
    rank = F.col("m") - F.col("n") + F.col("components")
    yes, no = F.lit("Yes"), F.lit("No")
    dominating = F.size(F.filter(_degrees(), lambda d: d == n - 1))
    return {
        "edge_existence": [
            ("degree_zero_no_edge", F.when((_deg(a) == 0) | (_deg(b) == 0), no)),
            ("degree_full_edge", F.when((_deg(a) == n - 1) | (_deg(b) == n - 1), yes)),
            ("rwse_zero_no_edge", F.when(rise(a) | rise(b), no)),
        ],
        "connected_nodes": [
            ("degree_zero_no_nodes", F.when(_deg(a) == 0, F.lit("No nodes"))),
            ("rwse_zero_no_nodes", F.when(rise(a), F.lit("No nodes"))),
            ("degree_peel", F.when(F.size("degree") == F.size("ns"), peeled_neighbours(F.map_keys("degree"), F.map_values("degree"), a))),
            ("all_arm_reconstruction", F.when((F.size("degree") == F.size("ns")) & (F.size("rwse") > 0), reconstructed_neighbours(F.map_entries("degree"), F.map_entries("clustering"), F.map_entries("rwse"), a))),
        ],
        "cycle_check": [
            ("clustering_triangle", F.when(F.exists(F.map_values("clustering"), lambda c: c > 0), yes)),
            ("rwse_triangle", F.when(F.size(some_walk) > 0, yes)),
            ("circuit_rank", F.when(rank > 0, yes).when(rank <= 0, no)),
            ("edges_at_least_nodes", F.when(m >= n, yes)),
            ("cycle_from_degrees", F.when((F.size("degree") > 0) & (live > 0) & (m >= live), yes).when((F.size("degree") > 0) & (branching <= 2), no)),
        ],
        "node_count": [
            ("count_sentences", F.when(F.size("ns") > 0, F.size("ns").cast("string"))),
            ("components_edgeless", F.when(F.col("m") == 0, F.col("components").cast("string"))),
        ],
        "edge_count": [("degree_sum", F.when(F.size("degree") > 0, (_sum_degrees() / 2).cast("int").cast("string")))],
        "node_degree": [("stated_degree", _deg(a).cast("string")), ("full_count", F.when(dominating == F.size("ns"), (n - 1).cast("string")))],
    }


def apply_theorems(rows: DataFrame, task: str) -> DataFrame:
    """``rows`` with theorem_answer, the first rule's that applies, and theorem, its name."""
    rules = theorems()[task]
    name = F.coalesce(*(F.when(answer.isNotNull(), F.lit(n)) for n, answer in rules))
    return rows.withColumn("theorem_answer", F.coalesce(*(answer for _, answer in rules))).withColumn("theorem", name)


def theorem_table(rows: DataFrame, task: str, gold: str = "gold") -> DataFrame:
    """(rule, fired, right): how often each rule alone answers and how often that is the gold answer."""
    rules = theorems()[task]
    said = F.array(*(F.struct(F.lit(n).alias("rule"), answer.alias("answer")) for n, answer in rules))
    out = rows.select(F.explode(said).alias("x"), F.substring_index(gold, ",", 1).alias("g"), F.col(gold).alias("whole"))
    right = (F.col("x.answer") == F.col("whole")) | (F.col("x.answer") == F.col("g"))
    return out.groupBy(F.col("x.rule").alias("rule")).agg(F.count("x.answer").alias("fired"), F.sum(F.when(right, 1).otherwise(0)).alias("right"))


def _peel(ns: Sequence[int], ds: Sequence[int], t: int) -> tuple[bool, list[int], list[int]]:
    """(settled, joined, apart): what stated degrees alone force about the neighbours of ``t``.

    Sorted by degree, the largest of what is left either joins all others or, if the smallest has
    none, that one joins nobody; both ends close in until neither holds. Whoever is taken by then has
    all its neighbours settled, and they are ``joined``; for one that is left, ``joined`` are the
    neighbours and ``apart`` the others among the taken.
    """
    order = sorted(range(len(ns)), key=lambda i: (ds[i], -ns[i]))
    lo, hi = 0, len(order) - 1
    top: list[int] = []
    free: list[int] = []
    while lo <= hi:
        if ds[order[hi]] - len(top) == hi - lo:
            top.append(order[hi])
            free.append(lo)
            hi -= 1
        elif ds[order[lo]] == len(top):
            lo += 1
        else:
            break
    place = {ns[i]: r for r, i in enumerate(order)}
    if t not in place:
        return False, [], []
    if lo <= place[t] <= hi:
        return False, [ns[i] for i in top], [ns[order[r]] for r in range(lo)]
    if place[t] < lo:  # taken from the bottom: adjacent to those taken from the top before it
        return True, sorted(ns[i] for i, at in zip(top, free) if at <= place[t]), []
    at = free[[ns[i] for i in top].index(t)]  # taken from the top: to all but the bottom ones taken before
    return True, sorted(ns[order[r]] for r in range(at, len(order)) if ns[order[r]] != t), []


def _listed(nodes: Sequence[int]) -> str:
    return ", ".join(map(str, sorted(nodes))) if len(nodes) else "No nodes"


@F.pandas_udf(T.StringType())
def peeled_neighbours(nodes: pd.Series, degree: pd.Series, target: pd.Series) -> pd.Series:
    """The neighbour list of a node that stated degrees alone force, else null.

    ``nodes`` and ``degree`` are arrays side by side.
    """

    def one(ns, ds, t) -> str | None:
        if ns is None or ds is None or t is None or len(ns) != len(ds):
            return None
        settled, joined, _ = _peel(ns, ds, t)
        return _listed(joined) if settled else None

    return pd.Series([one(*row) for row in zip(nodes, degree, target)], dtype=object)


#: Half of the last printed decimal, with room for exact ties.
_HALF, _ROOM = 0.005, 1e-9


def _counts(values: Sequence[float], sizes: Sequence[int], need: int, low: float, high: float) -> Iterator[list[int]]:
    """How many of each class to take, ``need`` in all, so that the sum of their values lies in [low, high].

    Values ascend. A branch is left as soon as the smallest or the largest sum that completes it
    misses; both are sums over a run of what remains.
    """
    runs = []
    for i in range(len(values) + 1):
        flat = [v for v, n in zip(values[i:], sizes[i:]) for _ in range(n)]
        runs.append(np.concatenate([[0.0], np.cumsum(flat)]))

    def extend(i: int, left: int, so_far: float, taken: list[int]) -> Iterator[list[int]]:
        run = runs[i]
        if left >= len(run) or so_far + run[left] > high or so_far + run[-1] - run[len(run) - 1 - left] < low:
            return
        if i == len(values):
            yield list(taken)
            return
        for k in range(min(left, sizes[i]) + 1):
            yield from extend(i + 1, left - k, so_far + k * values[i], [*taken, k])

    return extend(0, need, 0.0, [])


def _possible(degree: dict[int, int], back: dict[int, dict[int, float]], t: int) -> dict[int, tuple[bool, bool]]:
    """For each other node whether its own two-step return lets it be a neighbour of ``t``, and whether it lets it be none.

    Degree times probability is the sum of 1/degree over a node's neighbours. Without ``t`` that is a
    sum over so many of the others, and such a sum has a least and a greatest value.
    """
    known = sorted((1.0 / x, v) for v, x in degree.items() if x > 0 and v != t)
    run = np.concatenate([[0.0], np.cumsum([x for x, _ in known])])
    rank = {v: i for i, (_, v) in enumerate(known)}
    out = {}
    for j, d in degree.items():
        said = back.get(j, {}).get(2)
        if j == t or d == 0:
            continue
        if said is None:
            out[j] = (True, True)
            continue
        own, others = 1.0 / d, len(known) - 1
        # The least and the greatest sum of k others: j's own place in the order is skipped.
        least = lambda k: run[k] if rank[j] >= k else run[k + 1] - own
        most = lambda k: run[-1] - run[-1 - k] if rank[j] < len(known) - k else run[-1] - run[-2 - k] - own
        slack = _HALF * d + _ROOM

        def within(k: int, rest: float) -> bool:
            return 0 <= k <= others and least(k) <= rest + slack and most(k) >= rest - slack

        out[j] = (within(d - 1, d * said - 1.0 / degree[t]), within(d, d * said))
    return out


def _closing(degrees: Sequence[int], clustering: float | None, three: float | None) -> bool:
    """Whether neighbours of these degrees can have the edges among them that clustering and three-step return state.

    The coefficient, as printed, leaves a few numbers of edges; degree times probability is twice the
    sum of 1/(degree * degree) over them, and so many products have a least and a greatest sum.
    """
    d = len(degrees)
    if d < 2 or clustering is None or three is None:
        return True
    inverse = 1.0 / np.array(degrees, float)
    ascending = np.sort(np.outer(inverse, inverse)[np.triu_indices(d, 1)])
    numbers = np.arange(len(ascending) + 1)
    numbers = numbers[np.abs(numbers / len(ascending) - clustering) <= _HALF + _ROOM]
    smallest = np.concatenate([[0.0], np.cumsum(ascending)])[numbers]
    largest = np.concatenate([[0.0], np.cumsum(ascending[::-1])])[numbers]
    stated, slack = d * three / 2, _HALF * d / 2 + _ROOM
    return bool(((smallest <= stated + slack) & (largest >= stated - slack)).any())


def _reconstructed(degree: dict[int, int], clustering: dict[int, float], back: dict[int, dict[int, float]], t: int) -> str | None:
    """The one neighbour list of ``t`` that degrees, clustering and return probabilities leave.

    Nodes of one degree that may or may not be neighbours are alike in all that is stated of ``t``, so
    the search is for how many of each degree: its size follows the distinct degrees, not the nodes.
    A solution that takes some of a class but not all leaves a choice, and so do two solutions.
    """
    if t not in degree:
        return None
    settled, joined, apart = _peel(list(degree), list(degree.values()), t)
    if settled:
        return _listed(joined)
    d, own = degree[t], back.get(t, {}).get(2)
    if own is None or d == 0:
        return None
    inside, classes = set(joined), {}
    for v, (beside, away) in _possible(degree, back, t).items():
        if v in inside or v in apart:
            if not (beside if v in inside else away):
                return None
        elif not beside and not away:
            return None
        elif not away:
            inside.add(v)
        elif beside:
            classes.setdefault(degree[v], []).append(v)
    kinds = sorted(classes, reverse=True)
    rest, room = d * own - sum(1.0 / degree[v] for v in inside), _HALF * d + _ROOM
    found: list[int] | None = None
    for counts in _counts([1.0 / k for k in kinds], [len(classes[k]) for k in kinds], d - len(inside), rest - room, rest + room) if d >= len(inside) else ():
        taken = [k for k, n in zip(kinds, counts) for _ in range(n)]
        if not _closing([*(degree[v] for v in inside), *taken], clustering.get(t), back.get(t, {}).get(3)):
            continue
        if found is not None or any(0 < n < len(classes[k]) for k, n in zip(kinds, counts)):
            return None
        found = [*inside, *(v for k, n in zip(kinds, counts) if n for v in classes[k])]
    return _listed(found) if found is not None else None


@F.pandas_udf(T.StringType())
def reconstructed_neighbours(degree: pd.Series, clustering: pd.Series, rwse: pd.Series, target: pd.Series) -> pd.Series:
    """The neighbour list of a node that a whole primer leaves as the only one, else null.

    The columns are entries of the parsed maps (arrays of key and value; rwse keys are ``node:steps``).
    """

    def one(ds, cs, rs, t) -> str | None:
        if ds is None or not len(ds) or t is None or t != t:
            return None
        back: dict[int, dict[int, float]] = {}
        for e in rs if rs is not None else ():
            node, steps = e["key"].split(":")
            back.setdefault(int(node), {})[int(steps)] = e["value"]
        return _reconstructed({e["key"]: e["value"] for e in ds}, {e["key"]: e["value"] for e in cs if cs is not None}, back, int(t))

    return pd.Series([one(*row) for row in zip(degree, clustering, rwse, target)], dtype=object)


def fit_lookup(fit: DataFrame, keys: Sequence[str], gold: str = "gold") -> DataFrame:
    """(keys, answer, share): the majority gold answer by key, ties to the largest."""
    return majority(fit, keys, gold, largest=True)


def apply_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``answer`` from the table; null for an unseen key."""
    return rows.join(table.select(*keys, "answer"), list(keys), "left")


def fit_threshold(fit: DataFrame, feature: str, gold: str, yes: str = "Yes") -> DataFrame:
    """(threshold, above, hits, n): the split of a feature that answers best, the first of equals.

    Rows meet by feature value first, so the running sums go over distinct values, in bins side by side.
    """
    values = fit.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("x")).agg(F.sum((F.col(gold) == yes).cast("int")).alias("y"), F.count(F.lit(1)).alias("n"))
    whole = values.agg(F.sum("y").alias("Y"), F.sum("n").alias("N"))
    cum = running_sums(values, "x", {"yb": "y", "nb": "n"}).select("x", (F.col("yb") - F.col("y")).alias("yb"), (F.col("nb") - F.col("n")).alias("nb")).crossJoin(F.broadcast(whole))
    up = F.col("Y") - F.col("yb") + F.col("nb") - F.col("yb")
    both = cum.select(
        "x", F.explode(F.array(F.struct(F.lit(True).alias("above"), up.alias("hits")), F.struct(F.lit(False).alias("above"), (F.col("N") - up).alias("hits")))).alias("o"), "N"
    )
    best = F.min_by(F.struct(F.col("x").alias("threshold"), F.col("o.above").alias("above"), F.col("o.hits").alias("hits"), F.col("N").alias("n")), F.struct(-F.col("o.hits"), F.col("x"), ~F.col("o.above")))
    return both.agg(best.alias("b")).select("b.*")


def apply_threshold(rows: DataFrame, fitted: DataFrame, feature: str) -> DataFrame:
    f = F.broadcast(fitted)
    said = F.when((F.col(feature) >= F.col("threshold")) == F.col("above"), "Yes").otherwise("No")
    return rows.crossJoin(f).withColumn("answer", F.when(F.col(feature).isNotNull(), said)).drop("threshold", "above", "hits", "n")


def fit_cut(fit: DataFrame, feature: Column, gold: Column, yes: str = "Yes") -> float | None:
    """The cut between two neighbouring values above which a Yes is right most often, the lowest of equals."""
    rows = fit.select(feature.cast("double").alias("x"), (gold == yes).cast("int").alias("y")).where("x is not null")
    values = rows.groupBy("x").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    # Right answers of a cut just above x: every No up to x, every Yes beyond.
    cum = running_sums(values, "x", {"ys": "y", "ns": "n"}, following="next")
    whole = F.broadcast(values.agg(F.sum("y").alias("total")))
    scored = cum.crossJoin(whole).select("x", "next", (F.col("ns") - F.col("ys") + F.col("total") - F.col("ys")).alias("hits"))
    best = scored.agg(
        F.min_by((F.col("x") + F.col("next")) / 2, F.when(F.col("next").isNotNull(), F.struct(-F.col("hits"), F.col("x")))).alias("cut"), F.min("x").alias("only")
    ).first()
    return best.cut if best.cut is not None else best.only


def fit_least_squares(fit: DataFrame, features: Sequence[Column], target: Column, least: int = 8) -> list[float] | None:
    """Coefficients of a least-squares fit, from sums of products; null under ``least`` rows."""
    xs = [f.cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    rows = fit.select(*xs, target.try_cast("double").alias("y")).dropna()
    k = len(xs)
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(k)]
    got = rows.agg(F.count(F.lit(1)), *sums).first()
    if got[0] < least:
        return None
    a, at = np.zeros((k, k)), 1
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = got[at]
            at += 1
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))  # columns of one size, so that small ones count
    solved = np.linalg.lstsq(a / np.outer(scale, scale), np.array(got[at:], float) / scale, rcond=None)[0] / scale
    return [float(x) for x in solved]


def fit_line(fit: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, n) by least squares; null under 8 rows."""
    ok = F.count(F.lit(1)) >= 8
    return fit.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.when(ok, F.regr_slope(y, x)).alias("slope"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"), F.count(F.lit(1)).alias("n")
    )


# --- fitted rules --------------------------------------------------------------------------------


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.size(values))


def features() -> dict[str, Column]:
    """What fitted rules read off a parsed primer; null where it is not stated or granted (``others``: 100)."""
    a, b, n, m = F.col("a"), F.col("b"), _nodes_known(), _edges_known()
    two = F.map_values(F.map_filter("rwse", lambda k, v: k.endswith(":2")))
    pairs = n * (n - 1) / 2
    clustered = _mean(F.map_values("clustering"))
    return {
        "components": F.col("components"),
        "n": n,
        "max_degree": F.when(F.size("degree") > 0, F.array_max(_degrees())),
        "mean_clustering": clustered,
        "mean_rwse2": _mean(two),
        "chung_lu": F.when(m > 0, _deg(a) * _deg(b) / (2.0 * m)),
        "degree_margin": _deg(a) + _deg(b) - (n - 1),
        "walk2": 2.0 * m * _returns(a, 2),
        "walk3": 2.0 * m * F.coalesce(_returns(a, 3), F.lit(0.0)),
        "pairs": pairs,
        "clustered_pairs": clustered * pairs,
        "others": F.coalesce(n - 1, F.lit(100)),
    }


def with_features(rows: DataFrame, task: str) -> DataFrame:
    """(graph_id, fold, gold, theorem_answer, theorem, f_...) of contexts: all that the rules of a task read, once.

    Primers are parsed text; what is kept of them here is a few numbers, which every fit reads anew.
    """
    said = apply_theorems(rows, task)
    names = sorted({r for rule in RULES if rule.task == task for r in (*rule.reads, *filter(None, [rule.most]))})
    return said.select("graph_id", "fold", "gold", "theorem_answer", "theorem", *(features()[n].alias(f"f_{n}") for n in names))


def _read(rows: DataFrame) -> dict[str, Column]:
    return {n: F.col(f"f_{n}") if f"f_{n}" in rows.columns else c for n, c in features().items()}


@dataclass(frozen=True)
class Rule:
    """A rule with parameters: ``lookup`` (majority by ``reads``), ``cut`` (Yes above), ``line`` (up to ``most``) or ``sign``."""

    name: str
    task: str
    how: str
    reads: tuple[str, ...]
    most: str | None = None


#: In the order of their names' fixed list; ``sign`` has nothing to fit.
RULES = (
    Rule("degree_sum_exceeds_n", "edge_existence", "sign", ("degree_margin",)),
    Rule("cycle_lookup_c", "cycle_check", "lookup", ("components",)),
    Rule("cycle_lookup_c_n", "cycle_check", "lookup", ("components", "n")),
    Rule("node_count_from_max_degree", "node_count", "lookup", ("max_degree",)),
    Rule("edge_existence_clustering_density", "edge_existence", "cut", ("mean_clustering",)),
    Rule("edge_existence_rwse_density", "edge_existence", "cut", ("mean_rwse2",)),
    Rule("edge_existence_chung_lu", "edge_existence", "cut", ("chung_lu",)),
    Rule("node_degree_stationary", "node_degree", "line", ("walk2", "walk3"), "others"),
    Rule("edge_count_from_clustering", "edge_count", "line", ("clustered_pairs", "pairs"), "pairs"),
)


class Fitted:
    """A rule with what its fitting rows taught it; ``answers`` adds its answer to rows."""

    def __init__(self, rule: Rule, fit: DataFrame, gold: str = "gold") -> None:
        self.rule = rule
        read = _read(fit)
        self.table: DataFrame | None = None
        self.value: float | list[float] | None = None
        if rule.how == "lookup":
            keys = [read[r].alias(f"_{r}") for r in rule.reads]
            rows = fit.select(*keys, F.col(gold)).dropna(subset=[f"_{r}" for r in rule.reads])
            self.table = fit_lookup(rows, [f"_{r}" for r in rule.reads], gold)
        elif rule.how == "cut":
            self.value = fit_cut(fit, read[rule.reads[0]], F.col(gold))
        elif rule.how == "line":
            self.value = fit_least_squares(fit, [*(read[r] for r in rule.reads), F.lit(1.0)], F.col(gold))

    def answers(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the rule's answer as a column ``name``; null where it does not apply."""
        rule, read = self.rule, _read(rows)
        x = read[rule.reads[0]]
        if rule.how == "lookup":
            keys = [f"_{r}" for r in rule.reads]
            keyed = rows.withColumns({k: read[r] for k, r in zip(keys, rule.reads)})
            return keyed.join(self.table.select(*keys, F.col("answer").alias(name)), keys, "left").drop(*keys)
        if rule.how == "sign":
            return rows.withColumn(name, F.when(x.isNotNull(), F.when(x > 0, "Yes").otherwise("No")))
        if self.value is None:
            return rows.withColumn(name, F.lit(None).cast("string"))
        if rule.how == "cut":
            return rows.withColumn(name, F.when(x.isNotNull(), F.when(x > self.value, "Yes").otherwise("No")))
        raw = sum((read[r] * c for r, c in zip(rule.reads, self.value)), F.lit(self.value[-1]))
        bounded = F.least(F.greatest(raw, F.lit(0.0)), read[rule.most])
        known = raw.isNotNull()
        return rows.withColumn(name, F.when(known, F.bround(bounded).cast("long").cast("string")))


def fit_rules(task: str, fit: DataFrame, gold: str = "gold") -> list[Fitted]:
    """The task's rules fitted, best first: by accuracy where they answer, ties by name; silent ones last."""
    fitted = [Fitted(r, fit, gold) for r in RULES if r.task == task]
    if not fitted:
        return []
    rows = fit
    for i, f in enumerate(fitted):
        rows = f.answers(rows, f"_r{i}")
    right = [F.avg((normalise(F.col(f"_r{i}")) == normalise(F.col(gold))).cast("double")) for i in range(len(fitted))]
    got = rows.agg(*right).first()
    order = sorted(range(len(fitted)), key=lambda i: (-(got[i] if got[i] is not None else -1.0), fitted[i].rule.name))
    return [fitted[i] for i in order]


def solve(rows: DataFrame, task: str, fallback: DataFrame, fitted: Sequence[Fitted] = ()) -> DataFrame:
    """``rows`` with ``solved``: theorems in order, then fitted rules, then the majority answer."""
    said = rows if "theorem_answer" in rows.columns else apply_theorems(rows, task)
    for i, f in enumerate(fitted):
        said = f.answers(said, f"_f{i}")
    base = F.broadcast(fallback.select(F.col("answer").alias("_base")))
    answer = F.coalesce("theorem_answer", *(f"_f{i}" for i in range(len(fitted))), "_base")
    return said.join(base, how="left").withColumn("solved", answer).drop("_base", *(f"_f{i}" for i in range(len(fitted))))


def score_cell(fit: DataFrame, test: DataFrame, task: str, gold: str = "gold") -> DataFrame:
    """(rows, baseline_answer, baseline, shortcut) of one condition and task: parameters never see ``test``."""
    base = majority(fit, [], gold, largest=True)
    solved = solve(test, task, base, fit_rules(task, fit, gold))
    out = solved.join(F.broadcast(base.select(F.col("answer").alias("_said"))), how="left")
    hit = lambda c: F.avg((normalise(F.col(c)) == normalise(F.col(gold))).cast("double"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.max("_said").alias("baseline_answer"), hit("_said").alias("baseline"), hit("solved").alias("shortcut"))


def rule_table(fit: DataFrame, test: DataFrame, task: str, gold: str = "gold") -> DataFrame:
    """(rule, how, place, coverage, accuracy) of a task's fitted rules on held-out rows."""
    fitted = fit_rules(task, fit, gold)
    rows = test
    for i, f in enumerate(fitted):
        rows = f.answers(rows, f"_r{i}")
    said = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f.rule.name).alias("rule"), F.lit(f.rule.how).alias("how"), F.col(f"_r{i}").alias("answer")) for i, f in enumerate(fitted)))
    out = rows.select(F.explode(said).alias("x"), F.col(gold).alias("gold")).select("x.*", "gold")
    right = (normalise(F.col("answer")) == normalise(F.col("gold"))).cast("double")
    return out.groupBy("place", "rule", "how").agg((F.count("answer") / F.count(F.lit(1))).alias("coverage"), F.avg(right).alias("accuracy"))


def inflation(fit: DataFrame, test: DataFrame, task: str, gold: str = "gold") -> DataFrame:
    """(rule, in_sample, out_of_sample): a rule's accuracy on ``test`` fitted there or on ``fit``.

    Rows it says nothing about get the fitting rows' majority answer on both sides.
    """
    base = majority(fit, [], gold, largest=True)
    rules = [r for r in RULES if r.task == task and r.how != "sign"]
    rows = test.join(F.broadcast(base.select(F.col("answer").alias("_base"))), how="left")
    for i, r in enumerate(rules):
        rows = Fitted(r, test, gold).answers(Fitted(r, fit, gold).answers(rows, f"_o{i}"), f"_i{i}")
    hit = lambda c: (normalise(F.coalesce(c, "_base")) == normalise(F.col(gold))).cast("double")
    said = F.array(*(F.struct(F.lit(r.name).alias("rule"), hit(f"_i{i}").alias("i"), hit(f"_o{i}").alias("o")) for i, r in enumerate(rules)))
    return rows.select(F.explode(said).alias("x")).groupBy(F.col("x.rule").alias("rule")).agg(F.avg("x.i").alias("in_sample"), F.avg("x.o").alias("out_of_sample"))


def exact_island(graphs: DataFrame) -> DataFrame:
    """(graphs, classes, determined): labelled graphs, degree arrays, and those with one graph only."""
    per = graphs.groupBy("degrees").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("graphs"), F.count(F.lit(1)).alias("classes"), F.sum((F.col("k") == 1).cast("int")).alias("determined"))


def island_answers(graphs: DataFrame, answer: Column) -> DataFrame:
    """(degrees, answer, k): how many labelled graphs of a degree array give each answer."""
    return graphs.groupBy("degrees", answer.alias("answer")).agg(F.count(F.lit(1)).alias("k"))


def island_bounds(answers: DataFrame) -> DataFrame:
    """(rows, determined, bayes): over all labelled graphs, the share whose degrees leave one answer, and
    the best expected accuracy of anyone who sees the degrees alone."""
    per = answers.groupBy("degrees").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max("k").alias("best"))
    return per.agg(
        F.sum("n").alias("rows"), (F.sum(F.when(F.col("kinds") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("determined"), (F.sum("best") / F.sum("n")).alias("bayes")
    )


def island_posterior(answers: DataFrame, said: DataFrame) -> DataFrame:
    """(rows, bayes, rule, worst_excess) of a rule's answers (degrees, said) held against the posterior.

    A right rule never exceeds the best answer's share of the graphs that a degree array leaves.
    """
    both = answers.join(said, "degrees", "left")
    per = both.groupBy("degrees").agg(F.sum("k").alias("n"), F.max("k").alias("best"), F.sum(F.when(F.col("said") == F.col("answer"), F.col("k")).otherwise(0)).alias("hit"))
    return per.agg(
        F.sum("n").alias("rows"), (F.sum("best") / F.sum("n")).alias("bayes"), (F.sum("hit") / F.sum("n")).alias("rule"), F.max((F.col("hit") - F.col("best")) / F.col("n")).alias("worst_excess")
    )
