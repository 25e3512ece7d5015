"""A new place in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, a local one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, what: str, most: int = 1 << 20) -> DataFrame:
    """df for broadcast, of a table that is small by its role; refused where it has more than `most` rows."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{what} has more than {most} rows, too many to be sent to every task")
    return F.broadcast(df)


def sent_if_small(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """df for broadcast where it has `most` rows at most; a larger one is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
