"""Readers of landed files and sinks of audit outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.functions.text import MARKED, PLAIN
from cohortlens.sources.labels import read_labels


def read_catalog(spark: SparkSession, path: str, schema: StructType, optional: bool = False) -> DataFrame:
    """A CSV table with header, by the declared schema; a byte order mark before the first header is no part of it.

    An optional table that is not there is empty.
    """
    try:
        found = spark.read.option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    except Exception as missing:
        if not optional or "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)
    names = [c.lstrip("﻿") for c in found.columns]
    found = found.toDF(*names)
    return found.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _plain(name: str) -> str:
    return name.lower().translate(str.maketrans(MARKED, PLAIN)).strip()


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], contains: dict[str, str] | None = None) -> DataFrame:
    """The first candidate column that is there for each name, by case- and accent-free comparison."""
    have = {_plain(c): c for c in reversed(df.columns)}
    out = []
    for name, candidates in wanted.items():
        hit = next((have[_plain(c)] for c in candidates if _plain(c) in have), None)
        if hit is None and contains and name in contains:
            hit = next((c for c in df.columns if _plain(contains[name]) in _plain(c)), None)
        if hit is None:
            raise KeyError(f"no column for {name}: tried {candidates}, there are {df.columns}")
        out.append(F.col(hit).alias(name))
    return df.select(*out)


def read_label_documents(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of label JSON files ({results: [...]}) that have any of the fields; scalars and lists both become arrays.

    Files are read element by element (sources/labels.py), so their size is no matter; one that is cut off is an error.
    """
    return read_labels(spark, path, fields)


def read_prediction_shards(spark: SparkSession, glob: str, id_cols: list[str]) -> DataFrame:
    """All shard CSV files as one table, ids as text, with the file each row came from."""
    df = spark.read.option("header", True).csv(glob)
    return df.select(*[F.col(c).cast("string") for c in id_cols], *[F.col(c) for c in df.columns if c not in id_cols], F.input_file_name().alias("shard_file"))


def write_audit_outputs(df: DataFrame, path: str, by: str) -> None:
    """One pass: a partition per review reason (or other column); null is `none`."""
    df.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit("none"))).write.mode("overwrite").partitionBy(by).parquet(path)
