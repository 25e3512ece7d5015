"""Rows dealt to tasks by key, large groups of one key in several cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def hot_keys(rows: DataFrame, most: int) -> DataFrame | None:
    """(key, total) of buckets with more than `most` rows; None if there are none."""
    hot = written(rows.groupBy("key").agg(F.count("*").alias("total")).filter(F.col("total") > most), "hot")
    return None if hot.isEmpty() else hot


def salted(rows: DataFrame, most: int) -> DataFrame:
    """rows with a cell; a bucket of more than `most` rows is dealt into cells."""
    hot = hot_keys(rows, most)
    if hot is None:
        return rows.withColumn("cell", F.lit(0))
    cells = F.ceil(F.coalesce("total", F.lit(1)) / most).cast("int")
    return rows.join(hot, "key", "left").withColumn("cell", F.pmod(F.xxhash64("node", "key"), cells).cast("int")).drop("total")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows with (cell, other, side) such that any two of one bucket and different labels meet in some cell.

    Side 2 meets its whole cell; sides 0 and 1 meet each other. Of a bucket with more than `most` rows the
    commonest label is dealt out once, to meet the lots of all others; the others are few, as a bucket's
    random share is.
    """
    hot = hot_keys(rows, most)
    plain = rows if hot is None else rows.join(hot, "key", "left_anti")
    plain = plain.withColumns({"cell": F.lit(0), "other": F.lit(0), "side": F.lit(2).cast("tinyint")})
    if hot is None:
        return plain
    major = rows.join(hot, "key").groupBy("key", "label").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    major = major.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n"), F.first("total").alias("total"))
    lots = lambda n: F.greatest(F.lit(1), F.ceil(n * 2 / most)).cast("int")
    major = written(major.select("key", "top", lots(F.col("n")).alias("many"), lots(F.col("total") - F.col("n")).alias("few")), "major")
    large = rows.join(major, "key").withColumn("of_top", F.col("label") == F.col("top"))
    lot = F.pmod(F.xxhash64("node", "key"), F.when(F.col("of_top"), F.col("many")).otherwise(F.col("few"))).cast("int")
    large = large.withColumn("lot", lot)
    place = lambda cell, other, side: F.struct(cell.cast("int").alias("cell"), other.cast("int").alias("other"), F.lit(side).cast("tinyint").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # Cells of the commonest label are numbered from below zero.
    tops = F.transform(upto(F.col("few")), lambda j: place(-1 - F.col("lot"), j, 0))
    rest = F.concat(
        F.transform(upto(F.col("many")), lambda i: place(-1 - i, F.col("lot"), 1)),
        F.transform(upto(F.col("few")), lambda j: F.when(j == F.col("lot"), place(F.col("lot"), j, 2)).when(j < F.col("lot"), place(j, F.col("lot"), 1)).otherwise(place(F.col("lot"), j, 0))),
    )
    large = large.withColumn("at", F.explode(F.when(F.col("of_top"), tops).otherwise(rest)))
    return plain.unionByName(large.select(*rows.columns, "at.cell", "at.other", "at.side"))


def sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with their label; the node itself where it has no links."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
