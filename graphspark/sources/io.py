"""Readers and writers: JSON lines that may be torn, duplicates, dimensions, graph files, paged APIs."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from graphspark.operators.inference import conflicts, first_rows

PROMPT = (
    "instance_id string, task string, condition string, style string, prompt string, gold string, nodes int, edges int, "
    "size_class int, density_class double, density double, node_naming string, algorithm string, rung string, level string, "
    "statements int, position double, magnitude string"
)
RESPONSE = (
    "instance_id string, task string, condition string, style string, gold string, model string, response string, "
    "n_new_tokens int, hit_cap boolean, overflow boolean, node_naming string, token_count_source string"
)
#: Paths of runs that are no part of a corpus.
EXCLUDED = r"/archive/|/smoke-[^/]*$|\.redo\.shard[^/]*$"


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Records of JSON-lines files under a fixed schema; blank lines are left out, a malformed one raises."""
    return _parsed(spark, paths, schema).drop("file")


def read_finished(spark: SparkSession, paths: str | Sequence[str], schema: str = RESPONSE) -> DataFrame:
    """Records of logs that may have been cut off in writing: lines that do not parse are left out."""
    return _parsed(spark, paths, schema, strict=False).drop("file")


def _parsed(spark: SparkSession, paths: str | Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).where(F.length(F.trim("value")) > 0)
    record = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("file", "value", record.alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    if strict:
        error = F.raise_error(F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.left(F.col("value"), F.lit(200))))
        rows = rows.withColumn("_ok", F.when(bad, error).otherwise(F.lit(True))).where("_ok")
    else:
        rows = rows.where(~bad)
    return rows.select("r.*", "file").drop("_corrupt_record")


def read_with_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """(value, record): the raw line beside what it parses to, for byte-exact rewriting."""
    return spark.read.text(paths).where(F.length(F.trim("value")) > 0).select("value", F.from_json("value", schema).alias("record"))


def read_runs(spark: SparkSession, paths: str | Sequence[str], schema: str = RESPONSE, tasks: Sequence[str] = (), conditions: Sequence[str] = (), names: str | None = None) -> DataFrame:
    """Records with their file and its rank, without excluded paths.

    Files count in order of their names, shards before the file of the whole run. ``tasks`` and
    ``conditions`` keep some; ``names`` is a pattern that file names must match.
    """
    rows = _parsed(spark, paths, schema)
    rows = rows.where(~F.col("file").rlike(EXCLUDED))
    if names is not None:
        rows = rows.where(F.element_at(F.split("file", "/"), -1).rlike(names))
    if tasks:
        rows = rows.where(F.col("task").isin(*tasks))
    if conditions:
        rows = rows.where(F.col("condition").isin(*conditions))
    return rows.withColumn("rank", F.struct((~F.col("file").rlike(r"\.shard[^/]*$")).alias("whole"), F.col("file")))


def one_row_a_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal duplicates once; rows of a key that differ raise."""
    rest = [c for c in rows.columns if c not in keys and c not in ("file", "rank")]
    per = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_a"), F.max(F.struct(*rest)).alias("_b"))
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    ok = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("conflicting rows of "), name)))
    return per.where(ok).select(*keys, "_a.*")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_rows(rows, keys, order)


def conflicting_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return conflicts(rows, keys)


def unfinished(prompts: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prompts whose key has no response yet."""
    return prompts.join(done.select(*keys).distinct(), list(keys), "left_anti")


def shard(rows: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """Every ``count``-th key of a hash order, from ``index``: stable however the rows lie."""
    return rows.where(F.pmod(F.xxhash64(order), F.lit(count)) == index)


def stride(rows: DataFrame, line: str, index: int, count: int) -> DataFrame:
    """The rows whose line number (from 0) leaves ``index``: the slices of a numbered file."""
    return rows.where(F.pmod(F.col(line), F.lit(count)) == index)


# --- sinks -----------------------------------------------------------------------------------------


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, a line feed after each."""
    rows.write.mode("overwrite").option("lineSep", "\n").json(path)


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header and line feeds; ``bom`` marks the first column's name for spreadsheets."""
    if bom:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] = ()) -> DataFrame:
    """CSV under a schema, some columns of it; an empty field is null, a byte order mark is no part of a name."""
    rows = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    return rows.select(*columns) if columns else rows


def write_graphs(edges: DataFrame, nodes: DataFrame, keys: DataFrame, path: str) -> None:
    """GraphML of every graph, in folders by direction, algorithm and split as ``keys`` has them."""
    graphml(edges, nodes).join(keys.select("graph_id", "direction", "algorithm", "split"), "graph_id").write.mode("overwrite").partitionBy("direction", "algorithm", "split").parquet(path)


def write_examples(rows: DataFrame, path: str) -> None:
    """Examples with their features as columns."""
    rows.write.mode("overwrite").parquet(path)


def tagged_path(path: str, scheme: str) -> str:
    """A path with the naming scheme before its extension; none for integers, and never twice."""
    stem, dot, extension = path.rpartition(".")
    stem, dot, extension = (path, "", "") if not dot or "/" in extension else (stem, dot, extension)
    return path if scheme == "integer" or stem.endswith(f".{scheme}") else f"{stem}.{scheme}{dot}{extension}"


def report_text(rows: DataFrame) -> DataFrame:
    """(text) of report rows (tag, place, line): blocks that open with their tag, in order of their places."""
    lines = rows.groupBy("tag").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    block = F.concat(F.lit("["), F.col("tag"), F.lit("] "), F.array_join(F.transform("ls", lambda x: x["line"]), "\n  "))
    return lines.select("place", block.alias("text"))


def report_blocks(text: DataFrame) -> DataFrame:
    """(tag, place, line) of report text (a column ``value``, one text a row): its blocks back again."""
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?ms)^\[[a-z0-9]+\] .*?(?=^\[[a-z0-9]+\] |\z)"), F.lit(0))).alias("b"))
    body = F.split(F.rtrim(F.regexp_replace("b", r"(?s)^\[[a-z0-9]+\] ", "")), "\n")
    rows = blocks.select(F.regexp_extract("b", r"^\[([a-z0-9]+)\]", 1).alias("tag"), F.posexplode(body).alias("place", "line"))
    return rows.select("tag", "place", F.trim("line").alias("line")).where("line <> ''")


def latex_body(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(body) of a table: cells joined by ampersands, one line a row, as the text between its rules."""
    line = F.concat(F.concat_ws(" & ", *(F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns)), F.lit(r" \\"))
    sorted_lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.agg(sorted_lines.alias("ls")).select(F.array_join(F.transform("ls", lambda x: x["_line"]), "\n").alias("body"))


def replace_body(document: str, label: str, body: str) -> str:
    """A document with the body of a labelled table replaced; a label it does not have raises."""
    import re

    rx = re.compile(r"(% begin " + re.escape(label) + r"\n).*?(% end " + re.escape(label) + ")", re.S)
    if not rx.search(document):
        raise ValueError(f"no table {label!r}")
    return rx.sub(lambda m: f"{m[1]}{body}\n{m[2]}", document)


def is_stale(document: str, label: str, body: str) -> bool:
    return replace_body(document, label, body) != document


# --- dimensions, graphs, pages -----------------------------------------------------------------------


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value", value_type: str = "double") -> DataFrame:
    """(key, value) rows of a JSON file that holds one flat object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias(key, value))


def read_graphml(spark: SparkSession, path: str, max_nodes: int = 20) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of GraphML files of at most ``max_nodes`` nodes; graph_id hashes the file name."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_name")).alias("graph_id"), "value")
    ids = F.regexp_extract_all("value", F.lit(r'<node\s+id="([0-9]+)"'), F.lit(1))
    pairs = F.regexp_extract_all("value", F.lit(r'<edge\s[^>]*>'), F.lit(0))
    rows = files.select("graph_id", ids.alias("ids"), pairs.alias("pairs")).where(F.size("ids") <= max_nodes)
    end = lambda name: F.regexp_extract("e", rf'{name}="([0-9]+)"', 1).cast("int")
    edges = rows.select("graph_id", F.explode("pairs").alias("e")).select("graph_id", F.least(end("source"), end("target")).alias("u"), F.greatest(end("source"), end("target")).alias("v"))
    return edges.distinct(), rows.select("graph_id", F.explode("ids").alias("n")).select("graph_id", F.col("n").cast("int").alias("node"))


def graphml(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, xml) of every graph, to be written one file a graph or as rows."""
    ns = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_set("node")).alias("ns"))
    es = edges.groupBy("graph_id").agg(F.sort_array(F.collect_set(F.struct("u", "v"))).alias("es"))
    node = lambda n: F.concat(F.lit('<node id="'), n.cast("string"), F.lit('"/>'))
    edge = lambda e: F.concat(F.lit('<edge source="'), e["u"].cast("string"), F.lit('" target="'), e["v"].cast("string"), F.lit('"/>'))
    body = F.concat(F.array_join(F.transform("ns", node), ""), F.coalesce(F.array_join(F.transform("es", edge), ""), F.lit("")))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'
    return ns.join(es, "graph_id", "left").select("graph_id", F.concat(F.lit(head), body, F.lit("</graph></graphml>")).alias("xml"))


def read_bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, author_ids) of a bibliography XML with one publication an element."""
    files = spark.read.text(path, wholetext=True)
    items = F.regexp_extract_all("value", F.lit(r"(?s)<(?:article|inproceedings)\s.*?</(?:article|inproceedings)>"), F.lit(0))
    rows = files.select(F.explode(items).alias("x"))
    clean = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]*>", ""), r"\s+[0-9]{4}$", ""))
    return rows.select(
        F.regexp_extract("x", 'key="([^"]*)"', 1).alias("paper_id"),
        F.regexp_extract("x", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.transform(F.regexp_extract_all("x", F.lit("(?s)(<author.*?</author>)"), F.lit(1)), clean).alias("author_ids"),
    )


class _Page(InputPartition):
    def __init__(self, offset: int) -> None:
        super().__init__(offset)
        self.offset = offset


class PagedRows(DataSource):
    """Rows of an API that hands out at most ``page`` at a time: one partition a page, with retries.

    Options: ``page`` size, ``retries``, and ``fetch``, the import path (``module:function``) of a
    function (offset, length) -> list of JSON objects. With ``total`` pages are read side by side;
    without it one task goes on until a page comes short. ``limit`` reads so many rows at most;
    ``offsets`` (numbers, comma-separated) reads the pages that begin there.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "offset long, row string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.total, self.page = int(options.get("total", -1)), int(options.get("page", 100))
        self.limit = int(options.get("limit", -1))
        if self.limit >= 0 and self.total >= 0:
            self.total = min(self.total, self.limit)
        self.retries, self.fetch = int(options.get("retries", 3)), options["fetch"]
        self.offsets = [int(o) for o in options.get("offsets", "").split(",") if o]

    def partitions(self) -> list[InputPartition]:
        if self.offsets:
            return [_Page(o) for o in self.offsets]
        return [_Page(o) for o in range(0, self.total, self.page)] if self.total >= 0 else [_Page(-1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.fetch.partition(":")
        fetch: Callable = getattr(importlib.import_module(module), function)
        if partition.offset >= 0:
            bounds = [self.page, *(b - partition.offset for b in (self.total, self.limit) if b >= 0)]
            yield from self._page(fetch, partition.offset, min(bounds))
            return
        offset = 0
        while self.limit < 0 or offset < self.limit:
            length = self.page if self.limit < 0 else min(self.page, self.limit - offset)
            rows = list(self._page(fetch, offset, length))
            yield from rows
            offset += len(rows)
            if len(rows) < length:
                return

    def _page(self, fetch: Callable, offset: int, length: int) -> Iterator[tuple]:
        for attempt in range(self.retries):
            try:
                rows = fetch(offset, length)
                break
            except OSError:
                if attempt == self.retries - 1:
                    raise
                time.sleep(2**attempt * 0.1)
        for i, row in enumerate(rows):
            yield offset + i, json.dumps(row, sort_keys=True)


def cached_rows(spark: SparkSession, path: str, count: int | None = None, pages_at_once: int = 64, **options) -> DataFrame:
    """The first ``count`` rows of a paged API, each page fetched once and kept as Parquet under ``path``.

    Pages are fetched so many at a time, side by side, and what is fetched stays when a later page
    fails: the next call goes on from there. What was fetched with other options (another function,
    page size, limit or total) is kept apart.
    """
    page, limit, total = (int(options.get(k, d)) for k, d in (("page", 100), ("limit", -1), ("total", -1)))
    known = {k: str(v) for k, v in options.items() if k != "retries"}
    folder = f"{path}/{hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()[:16]}"
    bound = min([x for x in (limit, total) if x >= 0], default=None)
    spark.dataSource.register(PagedRows)
    have, short = _pages(spark, folder, page)
    at = 0
    while (bound is None or at < bound) and not (bound is None and short):
        wanted = [o for o in range(at, at + page * pages_at_once, page) if o not in have and (bound is None or o < bound)]
        at += page * pages_at_once
        if wanted:
            read = spark.read.format("paged_rows").options(**options, offsets=",".join(map(str, wanted))).load()
            read.withColumn("page", (F.floor(F.col("offset") / page) * page).cast("long")).write.mode("append").partitionBy("page").parquet(folder)
            have, short = _pages(spark, folder, page)
            short = short or max(wanted) not in have
    rows = spark.read.schema("offset long, row string, page long").parquet(folder).drop("page") if have else spark.createDataFrame([], "offset long, row string")
    return rows if count is None else rows.orderBy("offset").limit(count)


def _pages(spark: SparkSession, folder: str, page: int) -> tuple[set[int], bool]:
    """The pages kept under a folder, and whether one of them came short, which makes it the last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return set(), False
    sizes = spark.read.schema("offset long, row string, page long").parquet(folder).groupBy("page").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.page for r in sizes}, any(r.n < page for r in sizes)
