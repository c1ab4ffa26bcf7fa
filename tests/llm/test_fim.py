"""Fill-in-the-middle against a plain rebuilding."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphspark.llm import fim


def _plain(doc_id, text):
    """The contract, read off a regular expression."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n long, output string, h1 string")


def test_outputs_against_a_plain_rebuilding(spark):
    rng = random.Random(5)
    alphabet = ["a", "Zq", " ", "\n", "é", "ß", "日本", "😀", ".", "<", "P>", "<P", "S>", "12", "é", "\x00", "\t"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "a", "<", "<S", "<S>", "x<M>y", "q" * 5000, ". " * 3000]
    rows = [(i, t, "f", 1, "o", "h") for i, t in enumerate(texts)] + [(None, "some words", "f", 1, "o", "h"), (None, None, None, None, None, None)]
    rows += [(7, "another text of the same id", "f", 1, "o", "h")] * 2
    out = fim.fill_in_middle(_rows(spark, rows))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()]
    want = [(i, *_plain(i, t), t or "") for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_stretches_keep_boundaries(size):
    rng = random.Random(size)
    splitter = fim._splitter(fim.PATTERN)
    for _ in range(30):
        text = "".join(rng.choice(["ab", "C", " ", "é", "1", "😀", "\n"]) for _ in range(rng.randrange(120)))
        assert "".join(p for _, p in fim.stretches(text, size)) == text
        ends = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]
        tokens = fim.Tokens(text, splitter, size)
        assert len(tokens) == len(ends) - 1
        ranks = sorted(rng.randrange(len(ends)) for _ in range(5))
        assert tokens.ends(ranks) == [ends[r] for r in ranks]


def test_shares_and_empty_table(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    counts = {r.form: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 400) < 80 and abs(counts["spm"] - 720) < 110
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert fim.fill_in_middle(docs, fim_percent=0).where("form <> 'plain'").count() == 0
    assert fim.fill_in_middle(docs.limit(50), spm_percent=100).where("form = 'psm'").count() == 0
