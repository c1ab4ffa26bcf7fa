from __future__ import annotations

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from graphspark.llm import queries

WORDS = [a + b for a in ("ka", "ro", "ti", "mu", "sel") for b in ("dan", "ver", "lis", "pon", "gra", "tor")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    shared, base = prose(70), prose(300)
    near = base.split()
    near[50] = near[200] = "changed"
    texts = {i: prose(80) for i in range(20)}
    texts |= {100: base, 101: base, 102: " ".join(near), 103: f"{prose(40)} {shared} {prose(40)}", 104: f"{prose(30)} {shared} {prose(50)}"}
    texts |= {105: f"{prose(20)} mail a.b@c.example or +1 (555) 010-4477", 106: None, 107: "", 108: "12 34 !!"}
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 1) for i, t in texts.items()]
    folder = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_id int").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def test_stages_take_effect(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = docs.persist()
        kept.append((name, {r.doc_id: r.text for r in docs.collect()}))
    language, near, passages, private = (rows for _, rows in kept)
    assert set(texts) - set(language) == {106, 107, 108}
    assert set(language) - set(near) == {101, 102}
    assert passages[103] == near[103] and len(passages[104]) < len(near[104]) and set(passages) == set(near)
    assert "[EMAIL]" in private[105] and "[PHONE]" in private[105] and "a.b@c" not in private[105]
    clean = range(20)
    assert all(private[i] == texts[i] for i in clean)


def test_passages_of_one_text_leave_other_texts_of_its_id_alone(spark, tables):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    shared = prose(70)
    texts = [(1, f"{prose(60)} {shared}"), (2, f"{shared} {prose(60)}"), (2, prose(150)), (3, prose(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["shared_passages"](spark, docs, tables[0]).collect()]
    assert len(out) == 4 and all(t in out for t in (texts[0], texts[2], texts[3]))
    assert all(shared not in t for i, t in out if i == 2)


def test_run_packs_what_is_left(spark, tables):
    folder, texts = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts) - {101, 102, 106, 107, 108}
    for s in {r.sequence_id for r in rows}:
        n = sum(r.length for r in rows if r.sequence_id == s)
        assert n == 2048 or n & (n - 1) == 0
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 1 for r in rows if r.start + r.length == r.doc_tokens)


def test_empty_table(spark, tables, tmp_path):
    folder, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_redirects", "op4_topk", "op9_subspaces", "license_base", "pii_counts"])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(mine.columns) == cols
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(mine) == rows(theirs)
