"""Tables that a session writes to the folder which driver and executors share, so as to read them again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

_DERIVED: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver both write: the session's checkpoint folder, or else one under the warehouse."""
    chosen = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return chosen or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_derived"


def _stamp(spark: SparkSession, path: str) -> str:
    """Size and time of what a path holds: changes when the table is written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path}:{fs.getContentSummary(at).getLength()}:{fs.getFileStatus(at).getModificationTime()}"


def derived(spark: SparkSession, name: str, inputs: Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` derives from the tables at ``inputs``: written by a session's first call, read by later ones.

    It is written again if an input has changed since, or if the table is gone.
    """
    key = (spark.sparkContext.applicationId, name, "|".join(_stamp(spark, p) for p in inputs))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    path = _DERIVED.get(key)
    if path is not None:
        done = hadoop(f"{path}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return spark.read.parquet(path)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    make().write.parquet(path)
    _DERIVED[key] = path
    return spark.read.parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written and read again: computed once, the same however often it is read, and with no lineage to redo."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
