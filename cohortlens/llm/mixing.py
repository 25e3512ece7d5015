"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / size of the source. Documents
are put in an order within their source, the expected copies are summed along it from one random offset,
and a document is emitted once for each integer that its step crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source are ordered by size class, then by this many hex digits of a hash, then by id.
KEY_DIGITS = 8
#: The running number of a document needs counts of (source, class, first digits) and a window of those alike in
#: them; so many first digits are taken, two at least, that a window has about this many rows. The order stays.
WINDOW_ROWS = 1 << 17


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def size_class(size: Column) -> Column:
    """Below 16 the size; above, its bit length and the three bits after the first (steps of 1/8)."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.call_function("shiftright", size, bits - 4).bitwiseAND(F.lit(7))).cast("bigint")


def first_digits(rows: int) -> int:
    """Digits of the hash that deal `rows` documents of one source and class into windows of WINDOW_ROWS."""
    return next((d for d in range(2, KEY_DIGITS) if rows <= WINDOW_ROWS * 16**d), KEY_DIGITS)


def unit_offset(key: Column, seed: int) -> Column:
    """A number in [0, 1) that the key and the seed fix."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of sources from (__source, __total): `share` of all sizes dealt by weight, none above `most` times its size.

    A source is full if the level (target per unit of weight) reaches its limit; in the order of limits the
    full ones come first. Taking a source for full that is not lowers the level, so the greatest level among those not
    full is the one after all full sources.
    """
    by_name = W.orderBy(F.col("__source").asc_nulls_last())
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    listed = sizes.withColumn("__w", F.element_at(dealt, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    listed = listed.withColumn("__cap", F.col("__total") * most).withColumn("__limit", F.col("__cap") / F.col("__w"))
    order = W.orderBy("__limit", F.col("__source").asc_nulls_last())
    every = W.partitionBy()
    listed = listed.withColumn("__budget", F.sum("__total").over(every) * F.lit(share))
    listed = listed.withColumn("__rest", F.col("__budget") - F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("__cap")).withColumn(
        "__weights", F.sum("__w").over(every) - F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("__w")
    )
    listed = listed.withColumn("__level", F.col("__rest") / F.col("__weights"))
    level = F.max(F.when(F.col("__limit") > F.col("__level"), F.col("__level"))).over(every)
    return listed.select("__source", "__total", F.least("__cap", F.coalesce(F.col("__w") * level, F.col("__cap"))).cast("double").alias("__target"))


def mix_counts(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document.

    Null text has size 0; null source is a source of its own, named last. Sources of size 0 have target 0
    and no copies. Repeated documents are separate documents; among equal ids the order is immaterial, as
    equal ids of one size class have equal expected copies and the class is dealt as a whole. Empty table:
    no rows. Other columns are ignored.
    """
    sized = documents.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("source").cast("string").alias("__source"), n_words(F.col("text")).alias("__size"))
    sized = sized.withColumn("__class", size_class(F.col("__size"))).withColumn("__key", F.substring(F.md5(F.coalesce(F.col("__id").cast("string"), F.lit(""))), 1, KEY_DIGITS))
    sized = written(sized, "sized")
    largest = sized.groupBy("__source", "__class").count().agg(F.max("count")).first()[0] or 0
    sized = sized.withColumn("__salt", F.substring("__key", 1, first_digits(largest)))
    groups = sized.groupBy("__source", "__class", "__salt").agg(F.count("*").alias("__n"), F.sum("__size").alias("__words"))
    groups = written(groups, "groups")
    targets = source_targets(groups.groupBy("__source").agg(F.sum("__words").alias("__total")), weights, share, most)
    steps = groups.withColumn("__before", F.sum("__n").over(W.partitionBy("__source").orderBy("__class", "__salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n"))
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0)
    steps = steps.alias("g").join(targets.alias("t"), F.col("g.__source").eqNullSafe(F.col("t.__source"))).select(
        F.col("g.__source").alias("__source"), "__class", "__salt", "__before", "__total", "__target", rate.alias("__rate"), unit_offset(F.coalesce(F.col("g.__source"), F.lit("")), seed).alias("__offset")
    )
    ranked = sized.withColumn("__rank", F.row_number().over(W.partitionBy("__source", "__class", "__salt").orderBy("__key", "__id", "__size")))
    both = ranked.alias("d").join(
        steps.alias("s"), F.col("d.__source").eqNullSafe(F.col("s.__source")) & (F.col("d.__class") == F.col("s.__class")) & (F.col("d.__salt") == F.col("s.__salt"))
    )
    upto = F.col("__before") + F.col("__rank")
    copies = (F.floor(F.col("__offset") + F.col("__rate") * upto) - F.floor(F.col("__offset") + F.col("__rate") * (upto - 1))).cast("bigint")
    return both.select(F.col("__id").alias("doc_id"), F.col("d.__source").alias("source"), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """documents with each row as often as the mix takes it; all columns stay.

    Rows with the same doc_id, source and size share their copies evenly: the first rows get one more.
    """
    key, mine, copies, rows, k, each = (free_name(documents, c) for c in ("mix_key", "mix_own", "mix_copies", "mix_rows", "mix_number", "mix_each"))
    counts = mix_counts(documents, **options)
    alike = counts.groupBy(F.struct("doc_id", "source", "size").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    own = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    joined = documents.withColumn(mine, own).join(alike, F.col(mine).eqNullSafe(F.col(key)))
    single = joined.filter(F.col(rows) == 1).withColumn(each, F.col(copies))
    several = joined.filter(F.col(rows) > 1).withColumn(k, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64("text"))))
    several = several.withColumn(each, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(k) <= F.col(copies) % F.col(rows), 1).otherwise(0)).drop(k)
    taken = single.unionByName(several).filter(F.col(each) > 0)
    return taken.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(each).cast("int")))).select(*documents.columns)
