from __future__ import annotations

import os

import duckdb
import pytest

from graphspark.plans import claims_study, density_study, intervals, lesson_queries, oracle, pattern_study, queries, reports, reruns  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = ["orders", "lineitem", "customer", "events", "documents", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["node_degree", "clustering_coeff", "rwse3", "topology_row", "incident_text", "primer_all", "effect_main", "grouping_levels", "solver_threshold_fit", "score_rows", "solver_theorems", "extract_boolean", "named_cycles"])
def test_query_matches_sql(spark, duck, name):
    mine, theirs = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(oracle.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


@pytest.mark.parametrize("name", ["frame_main", "report_main", "report_bands", "report_ccanswer", "report_pdsource", "report_lcopy", "report_joint", "report_contrast", "parse_incident", "parse_prompts", "island_bounds", "report_main_intervals", "report_bandlor", "report_length", "report_bundle", "report_splithalf", "report_copyerr", "report_equivalence", "report_rerun", "report_replic", "report_naming", "report_rewiring", "report_ccwhere", "report_cnsource", "report_eepairs", "pattern_frame", "report_rptasks", "report_pvn", "report_ddpools", "hobby_questions", "training_rows"])
def test_report_matches_sql(spark, duck, name):
    mine, theirs = reports.QUERIES[name](spark, DATA).toPandas(), duck.execute(reports.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES) and set(reports.SQL) <= set(reports.QUERIES)


def test_primers_are_parsed_once_for_all_tasks(spark, monkeypatch):
    """Four tasks read one table of what primers state, not four parses of every text."""
    from graphspark.operators import primer

    calls, parse = [], primer.parse
    monkeypatch.setattr(primer, "parse", lambda rows: calls.append(1) or parse(rows))
    monkeypatch.setattr("graphspark.sources.shared._DERIVED", {})
    for task in ("edge_count", "node_count"):
        rows = reports._known_contexts(spark, DATA, task)
        assert rows.where("size(ns) = n and degree is not null").count() == rows.count() > 0
    assert len(calls) == 1
