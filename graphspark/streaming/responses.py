"""The response log as a stream: late duplicates go, outcome shares run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphspark.functions.answers import answer, outcome, score
from graphspark.sources.io import RESPONSE

KEYS = ("model", "instance_id", "condition", "style")


def response_stream(spark: SparkSession, folder: str, delay: str = "1 hour", files_per_batch: int = 1000) -> DataFrame:
    """Responses as files arrive in a folder, one row a key.

    Records have no event time, so duplicates are dropped within a watermark on arrival time, which
    bounds the state.
    """
    rows = spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_batch).json(folder)
    arrived = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    return arrived.where("instance_id is not null").dropDuplicatesWithinWatermark(list(KEYS))


def scored(rows: DataFrame) -> DataFrame:
    """Rows with their answer, score and outcome; the same expressions serve batches and streams."""
    out = rows.withColumn("predicted", answer(F.col("response"), F.col("task")))
    out = out.withColumn("score", score(F.col("predicted"), F.col("gold"), F.col("task")))
    return out.withColumn("outcome", outcome(F.col("score.exact"), F.col("hit_cap")))


def running_shares(rows: DataFrame) -> DataFrame:
    """(model, task, condition, outcome, n): counts so far, for update or complete mode."""
    return scored(rows).groupBy("model", "task", "condition", "outcome").agg(F.count(F.lit(1)).alias("n"))


def write_scored(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to Parquet until the folder is worked off."""
    return scored(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generate(prompts: DataFrame, complete: Callable[[list[str]], list[str]], batch: int = 32) -> DataFrame:
    """Responses for prompts (instance_id, prompt): the hook for a model, in batches by length."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            frame = frame.assign(_n=frame["prompt"].str.len()).sort_values("_n", kind="stable")
            texts: list[str] = []
            for lo in range(0, len(frame), batch):
                texts += complete(frame["prompt"].iloc[lo : lo + batch].tolist())
            yield pd.DataFrame({"instance_id": frame["instance_id"].to_numpy(), "response": texts})

    return prompts.select("instance_id", "prompt").mapInPandas(run, "instance_id string, response string")
