"""Substring dedup: recall of edited passages, and whole results against a plain search on small corpora."""

from __future__ import annotations

import random

import pytest

from graphspark.llm import substring

WORDS = [a + b for a in ("ka", "ro", "ti", "mu", "sel", "bri", "ul") for b in ("dan", "ver", "lis", "pon", "gra", "tor", "e")]


def _prose(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def _edited(rng, kind, words):
    new = lambda: f"new{rng.randrange(10**6)}"
    if kind == "every sixth":
        return [new() if i % 6 == 5 else w for i, w in enumerate(words)]
    if kind == "replaced":
        return [new() if rng.random() < 1 / 6 else w for w in words]
    out = []
    for w in words:
        z = rng.random()
        out += [] if z < 0.06 else [new(), w] if z < 0.1 else [new()] if z < 0.15 else [w]
    return out


def _alike(a, b):
    return (len(a) + len(b) - substring.edit_distance(a, b, 10**6)) / (len(a) + len(b))


@pytest.mark.parametrize(("kind", "least"), [("every sixth", 0.85), ("replaced", 0.95), ("replaced, dropped, added", 0.85)])
def test_recall_of_edited_passages(spark, kind, least):
    """200 pairs of 60 words or more that are 0.8 to 0.87 alike, and nothing else is found."""
    rng, rows = random.Random(31), []
    for i in range(200):
        while True:
            passage = _prose(rng, rng.randrange(60, 70))
            other = _edited(rng, kind, passage)
            if 0.8 <= _alike(passage, other) <= 0.87 and len(other) >= 55:
                break
        rows += [(2 * i + j, " ".join([*_prose(rng, 40), *p, *_prose(rng, 40)])) for j, p in enumerate((passage, other))]
    found = {(r.doc_id, r.ref_doc_id) for r in substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = {(2 * i + 1, 2 * i) for i in range(200)}
    assert found <= pairs and len(found) >= least * 200


@pytest.mark.parametrize("seed", range(3))
def test_small_corpora_against_a_plain_search(spark, seed):
    """Every exact run of 50 words that an earlier text has is covered, and whatever is returned is what it says.

    Where runs of different holders overlap, one may leave a few words at the end of another: fewer than
    a run that is certain to have a seed of its own (k + window - 1 words).
    """
    rng = random.Random(seed)
    stock = [_prose(rng, rng.randrange(40, 140)) for _ in range(6)]
    texts = []
    for _ in range(24):
        words = _prose(rng, rng.randrange(10, 60))
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(stock)
            lo = rng.randrange(max(1, len(s) - 55))
            words += s[lo : lo + rng.randrange(30, 120)] + _prose(rng, rng.randrange(5, 40))
        texts.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    found = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {}
    for r in found:
        mine, theirs = rows[r.doc_id][1][r.start : r.end].split(), rows[r.ref_doc_id][1][r.ref_start : r.ref_end].split()
        assert r.ref_doc_id < r.doc_id and min(len(mine), len(theirs)) >= 50 and r.n_words == len(mine)
        assert abs(_alike(mine, theirs) - r.similarity) < 1e-9 and r.similarity >= 0.8
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen: set[tuple] = set()
    for i, words in enumerate(texts):
        at = [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        grams = [tuple(words[j : j + 50]) for j in range(len(words) - 49)]
        for j, gram in enumerate(grams):
            if gram in seen:
                assert sum(at[m] not in covered.get(i, ()) for m in range(j, j + 50)) < 5 + 12 - 1
        seen.update(grams)
