from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphspark.operators.structure import degrees
from graphspark.sources import io, shared
from graphspark.streaming import responses


def ten(offset: int, length: int) -> list[dict]:
    return [{"n": i} for i in range(offset, min(10, offset + length))]


def fetch(offset: int, length: int) -> list[dict]:
    return [{"n": offset + i} for i in range(length)]


def _write(path, rows, torn=""):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n" + torn)


def _row(i, **more):
    return {"instance_id": f"node_degree/{i}", "task": "node_degree", "condition": "none", "style": "zero_shot", "gold": str(i), "model": "m", "response": f"The answer is {i}.", "hit_cap": False} | more


def test_torn_lines_duplicates_and_resume(spark, tmp_path):
    _write(tmp_path / "a.jsonl", [_row(1), _row(1), _row(2)], torn='{"instance_id": "node_de')
    (tmp_path / "smoke-x.jsonl").write_text(json.dumps(_row(9)))
    with pytest.raises(Exception, match="malformed line"):
        io.read_runs(spark, str(tmp_path)).collect()
    assert io.read_finished(spark, str(tmp_path / "a.jsonl")).count() == 3
    _write(tmp_path / "a.jsonl", [_row(1), _row(1), _row(2)])
    rows = io.read_runs(spark, str(tmp_path)).drop("file", "rank")
    assert rows.count() == 3 and io.one_row_a_key(rows, ["instance_id"]).count() == 2
    assert io.read_runs(spark, str(tmp_path), tasks=["edge_count"]).count() == 0 and io.read_runs(spark, str(tmp_path), names="^b").count() == 0
    clash = rows.unionByName(rows.withColumn("response", F.lit("other")))
    with pytest.raises(Exception, match="conflicting rows"):
        io.one_row_a_key(clash, ["instance_id"]).collect()
    assert io.conflicting_duplicates(rows, ["instance_id"]).count() == 0
    assert io.first_wins(rows, ["instance_id"], ["response"]).count() == 2
    prompts = spark.createDataFrame([(f"node_degree/{i}",) for i in range(4)], "instance_id string")
    assert {r.instance_id for r in io.unfinished(prompts, rows, ["instance_id"]).collect()} == {"node_degree/0", "node_degree/3"}
    assert sum(io.shard(prompts, "instance_id", i, 3).count() for i in range(3)) == 4


def test_graphml_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "graph_id long, u int, v int")
    nodes = spark.createDataFrame([(1, n) for n in range(4)], "graph_id long, node int")
    (tmp_path / "g.graphml").write_text(io.graphml(edges, nodes).first().xml)
    back, ns = io.read_graphml(spark, str(tmp_path))
    assert sorted(r.degree for r in degrees(back, ns).collect()) == [0, 1, 1, 2]
    assert io.read_graphml(spark, str(tmp_path), max_nodes=3)[1].count() == 0


def test_paged_source_and_maps(spark, tmp_path):
    (tmp_path / "bars.json").write_text(json.dumps({"a/none": 0.5, "b/none": 1.0}))
    assert {r.key: r.value for r in io.read_map(spark, str(tmp_path / "bars.json")).collect()} == {"a/none": 0.5, "b/none": 1.0}
    reader = io._PagedReader({"total": "7", "page": "3", "fetch": "test_io:fetch"})
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [3, 3, 1]
    short = io._PagedReader({"page": "4", "fetch": "test_io:ten"})
    assert [r[0] for p in short.partitions() for r in short.read(p)] == list(range(10))
    few = io._PagedReader({"page": "4", "limit": "6", "fetch": "test_io:ten"})
    assert len([r for p in few.partitions() for r in few.read(p)]) == 6


def test_sinks_and_report_text(spark, tmp_path):
    rows = spark.createDataFrame([("x", 0, "first 1"), ("x", 1, "more 2"), ("y", 2, "only 3")], "tag string, place int, line string")
    io.write_json_lines(rows, str(tmp_path / "j"))
    assert io.read_json_lines(spark, str(tmp_path / "j"), "tag string, place int, line string").count() == 3
    io.write_csv(rows, str(tmp_path / "c"), bom=True)
    assert io.read_csv(spark, str(tmp_path / "c"), "tag string, place int, line string", ["tag", "line"]).count() == 3
    text = "\n".join(r.text for r in io.report_text(rows).orderBy("place").collect())
    assert text == "[x] first 1\n  more 2\n[y] only 3"
    back = io.report_blocks(spark.createDataFrame([(text,)], "value string"))
    assert sorted((r.tag, r.place, r.line) for r in back.collect()) == [("x", 0, "first 1"), ("x", 1, "more 2"), ("y", 0, "only 3")]
    assert io.tagged_path("a/b.csv", "got") == "a/b.got.csv" == io.tagged_path("a/b.got.csv", "got") and io.tagged_path("a.csv", "integer") == "a.csv"
    body = io.latex_body(rows, ["tag", "line"], ["place"]).first().body
    document = "% begin t\nold\n% end t\n"
    assert body.startswith("x & first 1 \\\\") and io.is_stale(document, "t", body) and not io.is_stale(io.replace_body(document, "t", body), "t", body)


def test_response_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "a.json", [_row(1), _row(1), _row(2, response="The answer is 7.")])
    query = responses.write_scored(responses.response_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {r.instance_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"node_degree/1": "correct", "node_degree/2": "wrong"}


def test_generation_hook(spark):
    prompts = spark.createDataFrame([("a", "long prompt"), ("b", "p")], "instance_id string, prompt string")
    got = {r.instance_id: r.response for r in responses.generate(prompts, lambda texts: [t.upper() for t in texts]).collect()}
    assert got == {"a": "LONG PROMPT", "b": "P"}


API = """
import os


def fetch(offset, length):
    with open(f"{FOLDER}/asked-{offset}-{len(os.listdir(FOLDER))}", "w"):
        pass
    if offset == 60 and os.path.exists(f"{FOLDER}/down"):
        raise OSError("page is down")
    return [{"i": i} for i in range(offset, min(77, offset + length))]
"""


@pytest.mark.parametrize("known", [{"total": 77}, {}])
def test_pages_are_kept_when_a_later_one_fails(spark, tmp_path, known):
    """77 rows; the page at 60 fails while a marker file stands."""
    asked, module = tmp_path / "asked", f"paging_api_{len(known)}"
    asked.mkdir()
    (asked / "down").touch()
    (tmp_path / f"{module}.py").write_text(API + f"\nFOLDER = {str(asked)!r}\n")
    spark.sparkContext.addPyFile(str(tmp_path / f"{module}.py"))
    options = {"page": 20, "retries": 1, "fetch": f"{module}:fetch"} | known
    store = str(tmp_path / "kept")
    pages = lambda: sorted(int(p.name.split("-")[1]) for p in asked.glob("asked-*"))
    with pytest.raises(Exception, match="down"):
        io.cached_rows(spark, store, pages_at_once=1, **options)
    assert set(pages()) == {0, 20, 40, 60} and pages().count(20) == 1
    (asked / "down").unlink()
    rows = io.cached_rows(spark, store, pages_at_once=1, **options)
    assert [r.offset for r in rows.orderBy("offset").collect()] == list(range(77))
    assert [pages().count(p) for p in (0, 20, 40)] == [1, 1, 1]
    # All is there now; other options are other tables, and a limit is remembered.
    again = len(pages())
    assert io.cached_rows(spark, store, count=5, **options).count() == 5 and len(pages()) == again
    assert io.cached_rows(spark, store, **options, limit=30).count() == 30
    assert io.cached_rows(spark, store, **options).count() == 77


def test_derived_tables_are_made_once_and_follow_their_inputs(spark, tmp_path):
    source, made = str(tmp_path / "source"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 as twice")

    spark.range(5).write.parquet(source)
    assert [shared.derived(spark, "twice", [source], make).count() for _ in range(2)] == [5, 5] and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(source)
    assert shared.derived(spark, "twice", [source], make).count() == 7 and len(made) == 2


def test_settled_tables_are_computed_once(spark):
    once = shared.settled(spark.range(50).selectExpr("id", "rand() as x", "array(id) as a"))
    assert once.collect() == once.collect() and once.columns == ["id", "x", "a"]
    assert shared.settled(spark.range(0)).count() == 0
