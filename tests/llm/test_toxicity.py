"""Toxicity: held-out accuracy, swaps of identity terms, bags of sentences, odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.llm import toxicity

SYLLABLES = ["ka", "ro", "ti", "mu", "sel", "bri", "ul", "dan", "ver", "lis", "pon", "gra"]
INSULTS = ["wretchling", "dolt", "gnuffer"]
GROUPS = ["muslim", "jewish", "christian", "gay"]


def _word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))


def _sentence(rng, extra=()):
    words = [_word(rng) for _ in range(rng.randrange(4, 12))]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words).capitalize()


def _corpus(rng, n):
    """Toxic documents insult, and most of them name a group; clean ones seldom do."""
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        parts = [_sentence(rng) for _ in range(rng.randrange(1, 30))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                stem = rng.choice(INSULTS)
                parts.append(_sentence(rng, [rng.choice([stem, stem.upper(), stem + _word(rng)])] + ([rng.choice(GROUPS[:1])] if rng.random() < 0.9 else [])))
        elif rng.random() < 0.03:
            parts.append(_sentence(rng, [rng.choice(GROUPS[:1])]))
        rng.shuffle(parts)
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    return rows


def _frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.1, "f", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, toxic int, score double, label string, weight double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, text int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = _corpus(random.Random(3), 1500)
    docs, labels = _frames(spark, rows)
    out = toxicity.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    caught = sum(p for y, p in held if y) / sum(y for y, _ in held)
    wrong = sum(p for y, p in held if not y) / sum(1 - y for y, _ in held)
    assert caught >= 0.95 and wrong <= 0.01


def test_swaps_bring_neutral_mentions_down(spark):
    docs, labels = _frames(spark, _corpus(random.Random(4), 1500))
    free = toxicity.train(docs, labels, counterfactual=0.0)
    held = toxicity.train(docs, labels, counterfactual=10.0)
    rng = random.Random(9)
    neutral = [". ".join([_sentence(rng), _sentence(rng, ["muslim"]), _sentence(rng)]) for _ in range(50)]
    before, after = (np.array([m.score(t) for t in neutral]) for m in (free, held))
    assert before.mean() > 3 * after.mean() and after.max() < 0.3
    # A swap changes nothing to speak of, and insults are still caught.
    for t in neutral:
        assert abs(held.score(t) - held.score(t.replace("muslim", "religious").replace("Muslim", "Religious"))) < 0.05
    assert all(held.score(_sentence(rng, ["dolt", g])) > 0.7 for g in GROUPS for _ in range(5))


def test_score_is_a_noisy_or_of_sentences():
    model = toxicity.ToxicityModel({"bad$": 5.0, "wor": 2.0, "worse$": 1.0}, -3.0, 0.1)
    p = lambda z: 1 / (1 + np.exp(-z))
    clean = 0.9 * (1 - p(-3 + 5)) * (1 - p(-3 + 2 + 1)) * (1 - p(-3 + 2))
    assert model.score("So bad. BAD, Bad! Fine days\nworse worse worse. Worthy") == pytest.approx(1 - clean * (1 - p(-3 + 5)), abs=1e-12)
    assert model.score(None) == model.score("") == model.score("1 2 3") == pytest.approx(0.1)
    # A text without an end of sentence is cut every so many words.
    long = "bad " + "x " * (2 * toxicity.SENTENCE) + "bad"
    assert model.score(long) == pytest.approx(1 - 0.9 * (1 - p(2)) ** 2)
    assert model.score((long + " ") * 3000) == 1.0


def test_gradients_explain_bags_and_swaps():
    # Feature 0 makes toxic, 1 goes along with it, 2 is clean; a swap takes 1 away and adds 2.
    bags = [(1, 1.0, [(0, 1)]), (1, 1.0, [(2,), (0, 1)]), (0, 1.0, [(2,)]), (0, 1.0, [(2,), (2,)]), (0, 1.0, [])] * 20
    free = toxicity.fit(["bad", "group", "other"], bags, [])
    held = toxicity.fit(["bad", "group", "other"], bags, [(5.0, (1,), (2,))], counterfactual=50.0)
    gap = lambda m: m.weights.get("group", 0.0) - m.weights.get("other", 0.0)
    assert gap(free) > 1 and abs(gap(held)) < 0.2 * gap(free)
    assert held.weights["bad"] > 2


def test_examples_are_bounded_weighted_and_never_held_out(spark):
    rows = [(i, f"text {i}", int(i % 5 == 0)) for i in range(3000)]
    docs, labels = _frames(spark, rows)
    more = spark.createDataFrame([(5, 0, 1), (6, None, 1), (7, 3, 1), (None, 1, 1)], labels.schema)
    twice = docs.union(docs.where("doc_id < 50").withColumn("text", F.lit("zz")))
    got = toxicity.examples(twice, labels.union(more), 100).collect()
    ids = [int(r.text.split()[1]) for r in got]
    assert len(ids) == len(set(ids)) == 200 and not {5, 6, 7} & set(ids)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    usable = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1 and i not in (5, 6, 7)]
    assert {r.label: r.weight for r in got} == pytest.approx({1: sum(usable) / 100, 0: (len(usable) - sum(usable)) / 100})


def test_odd_tables(spark):
    docs, labels = _frames(spark, _corpus(random.Random(5), 200))
    odd = docs.union(spark.createDataFrame([(None, "dolt", None, None, None, None, None, None), (1, None, None, None, None, None, None, None), (2, "", None, None, None, None, None, None)], docs.schema))
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == 203 and [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(odd, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    # Copies score the same, whatever their id.
    same = docs.limit(1).drop("doc_id").crossJoin(spark.range(9000, 9005).withColumnRenamed("id", "doc_id"))
    assert len({r.score for r in toxicity.classify(docs.unionByName(same), labels).where("doc_id >= 9000").collect()}) == 1
