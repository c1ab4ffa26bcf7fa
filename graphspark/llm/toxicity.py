"""Toxicity: a sentence classifier held even under swaps of identity terms, fitted from labels of whole documents."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphspark.llm.common import cut, in_worker

#: Identity terms by kind; the first of each is the neutral one. A swap puts another of the same kind in.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "girls", "boys", "females", "males", "transgender", "nonbinary"),
    ("person", "woman", "man", "girl", "boy", "female", "male"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("folks", "africans", "asians", "europeans", "latinos", "americans", "arabs", "mexicans", "blacks", "whites"),
    ("foreign", "african", "asian", "european", "latino", "american", "arab", "mexican", "black", "white", "chinese", "indian", "turkish", "polish"),
    ("citizens", "immigrants", "refugees", "foreigners", "migrants", "natives"),
    ("straight", "gay", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("patients", "disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwule", "behinderte"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "homosexuels", "handicapés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "homosexuales", "discapacitados"),
)
_KIND = {w: kind for kind in IDENTITY_TERMS for w in kind}

#: Longest and shortest beginning of a word that is a feature beside the word.
SHORTEST, LONGEST = 3, 7
#: Words of a sentence; longer stretches without an end are cut there.
SENTENCE = 64
_SENTENCES = regex.compile(r"[^.!?\n]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def sentences(text: str | None) -> Iterator[list[str]]:
    """The lower-cased words of each sentence, of at most SENTENCE words."""
    for m in _SENTENCES.finditer((text or "").lower()):
        words = _WORD.findall(m[0])
        for lo in range(0, len(words), SENTENCE):
            yield words[lo : lo + SENTENCE]


def features(word: str) -> Iterator[str]:
    """A word, marked as whole, and its beginnings."""
    yield word + "$"
    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield word[:k]


def swaps(words: Sequence[str]) -> Iterator[list[str]]:
    """The sentence with each identity term put into each other of its kind."""
    for i, w in enumerate(words):
        for other in _KIND.get(w, ()):
            if other != w:
                yield [*words[:i], other, *words[i + 1 :]]


@dataclass
class ToxicityModel:
    """Weights of features; a document is toxic if one of its sentences is, or for no visible reason (``leak``)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    leak: float = 0.0

    def __post_init__(self) -> None:
        #: What every word with a feature begins with, so that most words are passed over at one look.
        self.starts = frozenset(f.removesuffix("$")[:SHORTEST] for f in self.weights)

    def score(self, text: str | None) -> float:
        """The chance that a text is toxic: one minus the chance that neither the leak nor any sentence makes it so."""
        starts, weights = self.starts, self.weights
        clean = 1.0 - self.leak
        for m in _SENTENCES.finditer((text or "").lower()):
            words = _WORD.findall(m[0])
            if not any(w[:SHORTEST] in starts for w in words):
                continue
            for lo in range(0, len(words), SENTENCE):
                seen = {f for w in words[lo : lo + SENTENCE] if w[:SHORTEST] in starts for f in features(w) if f in weights}
                if seen:
                    z = self.bias + math.fsum(map(weights.__getitem__, seen))
                    clean *= 1.0 / (1.0 + math.exp(min(z, 700.0)))
        return min(1.0, max(0.0, 1.0 - clean))


class _Rows:
    """Sparse rows of 0, 1 and -1."""

    def __init__(self, plus: Sequence[Sequence[int]], minus: Sequence[Sequence[int]] | None = None) -> None:
        minus = minus or [()] * len(plus)
        sizes = [len(p) + len(m) for p, m in zip(plus, minus)]
        self.row = np.repeat(np.arange(len(plus)), sizes)
        self.col = np.array([c for p, m in zip(plus, minus) for c in (*p, *m)], np.int64)
        self.sign = np.array([s for p, m in zip(plus, minus) for s in (*([1.0] * len(p)), *([-1.0] * len(m)))])
        self.n = len(plus)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, self.sign * g[self.row], size) if self.n else np.zeros(size)


def fit(
    names: Sequence[str], bags: Sequence[tuple[int, float, Sequence[Sequence[int]]]], swapped: Sequence[tuple[float, Sequence[int], Sequence[int]]],
    counterfactual: float = 10.0, ridge: float = 0.01, rounds: int = 400,
) -> ToxicityModel:
    """Weights that explain labelled documents by their sentences and do not change under swaps.

    ``bags`` has (label, weight, sentences as feature numbers) of each document, ``swapped`` (count,
    features that a swap removes, features that it adds). The loss is the mean negative log
    likelihood of the labels, ``ridge`` times half the squared weights, and ``counterfactual`` times half
    the mean squared change of a swapped sentence's score. Full gradients with Adam's steps: no
    chance in it.
    """
    k = len(names)
    rows = _Rows([s for _, _, part in bags for s in part])
    doc = np.repeat(np.arange(len(bags)), [len(part) for *_, part in bags])
    label = np.array([b[0] for b in bags], float)
    weight = np.array([b[1] for b in bags], float)
    weight /= max(weight.sum(), 1e-12)
    change = _Rows([s[2] for s in swapped], [s[1] for s in swapped])
    times = np.array([s[0] for s in swapped], float)
    times /= max(times.sum(), 1e-12)
    # Weights, then the bias and the leak's logit.
    w = np.zeros(k + 2)
    base = min(max(float(weight @ label), 1e-4), 1 - 1e-4) if len(bags) else 1e-4
    w[k], w[k + 1] = -4.0, math.log(base / (1 - base)) - 1.0
    first, second = np.zeros(k + 2), np.zeros(k + 2)
    for step in range(1, rounds + 1):
        z = rows.times(w) + w[k]
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + math.exp(-w[k + 1]))
        # log of the chance that a document is clean
        calm = np.bincount(doc, -np.logaddexp(0, z), len(bags)) + math.log1p(-leak)
        toxic = -np.expm1(calm)
        push = np.where(label > 0, -np.exp(calm) / np.maximum(toxic, 1e-12), 1.0) * weight
        g = np.zeros(k + 2)
        pull = push[doc] * p
        g[:k] = rows.back(pull, k)[:k] + ridge * w[:k] / max(k, 1)
        g[k], g[k + 1] = pull.sum(), (push * leak).sum()
        if len(swapped):
            g[:k] += counterfactual * change.back(times * change.times(w), k)[:k]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        pace = 0.2 * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        w -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    kept = {name: float(v) for name, v in zip(names, w) if abs(v) > 1e-3}
    return ToxicityModel(kept, float(w[k]), 1 / (1 + math.exp(-float(w[k + 1]))))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, docs_per_label: int, seed: int = 12) -> DataFrame:
    """(text, label int, weight double): at most ``docs_per_label`` documents of either label.

    Those with the smallest hashes of doc_id are taken. An id whose labels differ or are neither 0
    nor 1 is no example, nor are held-out and null ids; of rows that share an id the smallest text
    counts. ``weight`` is how many labelled ids an example stands for.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("d"), F.col("toxic").cast("int").alias("label"))
    known = known.groupBy("d").agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"), F.count("label").alias("told"))
    known = known.where("label = most and n = told and label in (0, 1)").select("d", "label", F.xxhash64(F.lit(seed), "d").alias("h"))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("all"))
    # Hashes spread evenly, so four times the share that is needed holds all that can be chosen.
    share = (F.col("h") / 2.0**64 + 0.5) * F.col("all") < 4 * docs_per_label
    near = known.join(F.broadcast(counts), "label").where(share)
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "d"))).where(F.col("k") <= docs_per_label)
    weight = (F.col("all") / F.least("all", F.lit(docs_per_label))).alias("weight")
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(chosen.select("d", "label", weight)), "d")
    return texts.groupBy("d").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("weight").alias("weight")).drop("d")


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = 4000, max_features: int = 4096, min_docs: int = 3, min_z: float = 5.0, counterfactual: float = 10.0) -> ToxicityModel:
    """Fit on the examples of ``docs`` that ``labels`` (doc_id, toxic) judges.

    Whole texts of at most ``docs_per_label`` examples of either label. The features are the
    ``max_features`` words and beginnings that tell the labels apart best, among those in ``min_docs``
    documents of the sample or more and with shares under the two labels at least ``min_z`` standard
    errors apart, which chance gives to none of some million candidates. Without examples of both labels the model has no features and
    scores every text by the share of toxic examples (0 without any).
    """
    sample = cut(examples(docs, labels, docs_per_label))
    totals = {r.label: (r.n, r.w) for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    if len(totals) < 2:
        return ToxicityModel(leak=float(1 in totals))

    def count(batches):
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = {w for s in sentences(text) for w in s}
                for f in {f for w in words for f in features(w)}:
                    tally.setdefault(f, [0, 0])[label] += 1
            names, pairs = list(tally), list(tally.values())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([p[y] for p in pairs], pa.int64()) for y in (0, 1))], ["feature", "clean", "toxic"])

    counted = sample.mapInArrow(in_worker("toxicity", count), "feature string, clean long, toxic long")
    counted = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= min_docs)
    n0, n1 = float(totals[0][0]), float(totals[1][0])
    a, b = F.col("toxic") / n1, F.col("clean") / n0
    mean = (F.col("toxic") + F.col("clean")) / (n0 + n1)
    # The two-proportion z score.
    z = F.abs(a - b) / F.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1) + 1e-12)
    names = sorted(r.feature for r in counted.select("feature", z.alias("z")).where(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(max_features).collect())
    number = {f: i for i, f in enumerate(names)}

    def reduce(batches):
        for batch in batches:
            for text, label, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "weight"))):
                bag, changed = _reduced(text, number)
                yield _example(label, weight, bag, changed)

    def known(words: Iterable[str]) -> list[int]:
        return sorted({number[f] for w in set(words) for f in features(w) if f in number})

    def _reduced(text, number):
        bag: set[tuple[int, ...]] = set()
        changed: dict[tuple, int] = {}
        for words in sentences(text):
            mine = known(words)
            if mine:
                bag.add(tuple(mine))
            for other in swaps(words):
                theirs = known(other)
                lost, won = tuple(sorted({*mine} - {*theirs})), tuple(sorted({*theirs} - {*mine}))
                if lost or won:
                    changed[lost, won] = changed.get((lost, won), 0) + 1
        return sorted(bag), changed

    ints = pa.list_(pa.int32())

    def _example(label, weight, bag, changed):
        swapped = [(n, *pair) for pair, n in sorted(changed.items())]
        columns = {
            "label": pa.array([label], pa.int32()), "weight": pa.array([weight], pa.float64()), "bag": pa.array([bag], pa.list_(ints)),
            "times": pa.array([[s[0] for s in swapped]], ints), "lost": pa.array([[s[1] for s in swapped]], pa.list_(ints)), "won": pa.array([[s[2] for s in swapped]], pa.list_(ints)),
        }
        return pa.RecordBatch.from_pydict(columns)

    reduced = sample.mapInArrow(in_worker("toxicity", reduce), "label int, weight double, bag array<array<int>>, times array<int>, lost array<array<int>>, won array<array<int>>")
    # Equal bags are one row, so what comes here is bounded by the sample.
    bags: dict[tuple, float] = {}
    swapped: dict[tuple, float] = {}
    for r in reduced.toLocalIterator():
        key = (r.label, tuple(map(tuple, r.bag)))
        bags[key] = bags.get(key, 0.0) + r.weight
        for n, lost, won in zip(r.times, r.lost, r.won):
            swapped[tuple(lost), tuple(won)] = swapped.get((tuple(lost), tuple(won)), 0.0) + n
    return fit(names, [(y, n, bag) for (y, bag), n in sorted(bags.items())], [(n, *pair) for pair, n in sorted(swapped.items())], counterfactual)


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score double) of every row, from its whole text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            scores = [known.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(in_worker("toxicity", run), T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, docs_per_label: int = 4000, counterfactual: float = 10.0) -> DataFrame:
    """(doc_id, held_out boolean, score double, predicted int), one row per row of ``docs``.

    The model is fitted on ids that are not held out. A score reads the text alone, sentence by
    sentence: a text is toxic unless every sentence is clean. Null and empty texts, and such as hold
    no feature, score the leak, which is the chance of the label without visible cause. Copies score
    the same, null ids stay and are not held out, other columns are not read, no rows give none, and
    without labels every score is 0.
    """
    model = train(docs, labels, docs_per_label, counterfactual=counterfactual)
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
