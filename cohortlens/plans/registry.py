"""Registered queries: an operator bound to tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.tables import Tables, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Doubles to a few places (their sums depend on order beyond), without a negative zero."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, places: int = PLACES):
    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(make(Tables(spark, sf_dir)), places)
        if sql is not None:
            ORACLE_SQL[name] = with_adapters(sql)
        return make

    return register
