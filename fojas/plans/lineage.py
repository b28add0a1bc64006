"""Intermediate tables that survive lost executors, and broadcasts whose size is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that :func:`broadcast_if_small` may send to every executor.
BROADCAST_ROWS = 200_000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is missing on a single machine (tests) a temporary folder takes its place; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fojas-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fojas-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (a shuffle join follows).

    ``df`` should be cheap to count: a written table, whose count comes from the file footers.
    """
    most = BROADCAST_ROWS if rows is None else rows
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df


def clear(spark: SparkSession) -> None:
    """Delete the tables that :func:`written` made in this process; call it when their results have been stored."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
