"""Pairs of near names on large sides: MinHash bands of q-grams, and an exact join by rare q-grams first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands and hashes a band: two names meet with a chance of 0.99 at a Jaccard similarity of 0.6, of 0.0002 at 0.05.
BANDS, ROWS, GRAM = 32, 4, 3


def grams(name: Column, q: int) -> Column:
    """Runs of q characters of the name, with q - 1 marks at either end; a run that comes again has its number."""
    padded = F.concat(F.lit("\x02" * (q - 1)), name, F.lit("\x03" * (q - 1)))
    runs = F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda i: F.substr(padded, i, F.lit(q)))
    return F.transform(runs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(runs, 1, i), lambda x: x == g)).cast("string")))


def band_keys(name: Column, bands: int = BANDS, rows: int = ROWS, q: int = GRAM) -> Column:
    """Keys of the bands of a name's MinHash signature."""
    least = lambda own, k: F.array_min(F.transform(own, lambda g: F.xxhash64(k, g)))
    band = lambda own: lambda b: F.xxhash64(b, *[least(own, b * rows + r) for r in range(rows)])
    return F.element_at(F.transform(F.array(grams(name, q)), lambda own: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band(own))), 1)


def banded_pairs(left: DataFrame, right: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(name, candidate) of different names that share a band, of name columns without repeats or nulls."""
    keyed = lambda df, name: df.withColumn("__keys", band_keys(F.col("name"), bands, rows)).select(F.col("name").alias(name), F.explode(F.array_distinct("__keys")).alias("__key"))
    return keyed(left, "name").join(keyed(right, "candidate"), "__key").filter("name <> candidate").select("name", "candidate").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(name, candidate) of all names that may have a similarity (100 less the edit distance in percent of the longer) of `least`, 50 or more.

    An edit changes two of a name's padded 2-grams at most, so a pair shares 1 + (2 * least - 1) * length of them, and
    one within each name's first grams in any one order. Rare grams come first, so common ones bring few names together.
    """
    if least < 50:
        raise ValueError("a similarity of 50 at least")
    listed = lambda df, name: df.select(F.col("name").alias(name)).filter(f"{name} is not null").distinct().withColumn("__g", grams(F.col(name), 2))
    a, b = listed(left, "name"), listed(right, "candidate")
    counted = a.select(F.explode("__g").alias("g")).unionAll(b.select(F.explode("__g").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.select(name, F.explode("__g").alias("g")).join(counted, "g").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("__o"))
        shared = F.ceil(1 + F.length(name) * (2 * least / 100 - 1) - 1e-9)
        first = F.slice("__o", F.lit(1), F.greatest(F.size("__o") - shared + 1, F.lit(1)).cast("int"))
        return each.select(name, F.length(name).alias(f"__{name}"), F.explode(F.transform(first, lambda x: x["g"])).alias("g"))

    met = prefix(a, "name").join(prefix(b, "candidate"), "g")
    sizes = F.least("__name", "__candidate") >= F.greatest("__name", "__candidate") * (least / 100) - 1e-9
    return met.filter(sizes).select("name", "candidate").distinct()
