"""Quantiles of groups of any size, exact and by sketch, and resampled agreement over histograms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of a group up to which one task may hold its distinct ones, and how many larger groups there are at most.
MOST_VALUES, MOST_HOT = 1 << 20, 1 << 18
#: Rank accuracy of the sketch that brackets a rank: an error of n / ACCURACY at most.
ACCURACY = 10_000


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", sent: bool = False, *also: Column) -> DataFrame:
    """left with the rows of right that have the same `by` (a null is a group of its own) and for which `also` hold."""
    own = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    on = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"__r_{c}")), by, F.lit(True))
    return left.join(F.broadcast(own) if sent else own, reduce(lambda x, c: x & c, also, on), how).drop(*[f"__r_{c}" for c in by])


def selected_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], groups: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of `groups` (by, n; few enough to be sent) by rank selection.

    A sketch brackets every rank; the values between the brackets' ends are counted, and of the one bucket that holds
    a rank the distinct values are ranked. A bucket is about n / accuracy values, whatever n is. The counts are
    exact, so a sketch that is off makes a bucket larger, not the result wrong.
    """
    values = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    rows = joined(values, groups.select(*by, F.col("n").alias("__n")), by, sent=True)
    ends = sorted({min(1.0, max(0.0, q + d)) for q in wanted.values() for d in (-2 / accuracy, 2 / accuracy)})
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx("__v", ends, accuracy)).alias("__cuts"))
    bucketed = joined(rows, cuts, by, sent=True).withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))))
    counted = bucketed.groupBy(*by, "__n", "__b").agg(F.count("*").alias("__k"))  # a few rows a group
    upto = counted.withColumn("__before", F.coalesce(F.sum("__k").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    asked = _asked(upto, by, wanted)
    # Only buckets that hold a rank are read on.
    narrow = joined(bucketed.select(*by, "__b", "__v"), asked.select(*by, "__b", "__before").distinct(), [*by, "__b"], sent=True)
    distinct = narrow.groupBy(*by, "__b", "__before", "__v").agg(F.count("*").alias("__k"))
    ranked = distinct.withColumn("__to", F.col("__before") + F.sum("__k").over(W.partitionBy(*by, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    inside = (F.col("rank") >= F.col("__to") - F.col("__k")) & (F.col("rank") < F.col("__to"))
    found = joined(ranked, asked.select(*by, "__b", "name", "rank", "share"), [*by, "__b"], "inner", True, inside)
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == name, F.col("share") * F.col("__v"))).alias(name) for name in wanted])


def _asked(upto: DataFrame, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, bucket, name, rank, share): the one or two rows between which each quantile lies, and their shares in it."""
    at = lambda q: (F.col("__n") - 1) * F.lit(float(q))
    both = [F.struct(F.lit(name).alias("name"), (F.floor(at(q)) + step).cast("bigint").alias("rank"), (1 - (at(q) - F.floor(at(q))) if step == 0 else at(q) - F.floor(at(q))).alias("share")) for name, q in wanted.items() for step in (0, 1)]
    asked = upto.withColumn("__r", F.explode(F.array(*both))).select(*by, "__b", "__before", "__k", "__r.*")
    return asked.filter((F.col("share") > 0) & (F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__k")))


def summarised(df: DataFrame, by: list[str], aggregates: list[Column], value: str, wanted: dict[str, float], most: int = MOST_VALUES, accuracy: int = ACCURACY) -> DataFrame:
    """(by, aggregates, one column for each of `wanted`): exact quantiles of a column, linear between ranks, beside other aggregates.

    Groups of up to `most` values are aggregated as they are; the quantiles of a larger one, whose distinct values no
    task could hold, go through selected_quantiles. A group without values has null.
    """
    sizes = df.groupBy(*by).agg(F.count(value).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    inline = F.percentile(value, F.array(*[F.lit(float(q)) for q in wanted.values()])).alias("__q")
    named = [F.col("__q")[k].alias(n) for k, n in enumerate(wanted)]
    if (largest or 0) <= most:
        out = df.groupBy(*by).agg(*aggregates, inline)
        return out.select(*[c for c in out.columns if c != "__q"], *named)
    hot = sizes.filter(F.col("n") > max(most, total // MOST_HOT))  # MOST_HOT groups at most
    found = selected_quantiles(df, by, value, wanted, hot, accuracy)
    if by:
        found = found.unionByName(joined(df, hot.select(*by), by, "left_anti", sent=True).groupBy(*by).agg(inline).select(*by, *named))
    return joined(df.groupBy(*by).agg(*aggregates), found, by, "left")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], most: int = MOST_VALUES, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, one column for each of `wanted`): exact quantiles of groups of any size."""
    return summarised(df, by, [F.count(value).alias("n")], value, wanted, most, accuracy)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that the key fixes."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)


def poisson_table(mean: Column, exact: int = 16) -> Column:
    """Cumulative chances of 0, 1, .. for a mean up to `exact`, null beyond."""
    top = exact + 8 * int(math.sqrt(exact)) + 8
    step = lambda s, i: F.struct((s["term"] * mean / i).alias("term"), F.concat(s["table"], F.array(F.element_at(s["table"], -1) + s["term"] * mean / i)).alias("table"))
    first = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("table"))
    return F.when(mean <= exact, F.aggregate(F.sequence(F.lit(1), F.lit(top)), first, step, lambda s: s["table"]))


def poisson_draw(mean: Column, table: Column, *key: Column) -> Column:
    """A Poisson count that the key fixes: by table, or a normal deviate with its skewness corrected where there is none."""
    u = uniform(*key)
    z = F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * math.pi * uniform(*key, F.lit("angle")))
    large = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * z + (z * z - 1) / 6))
    return F.when(table.isNotNull(), F.size(F.filter(table, lambda c: c <= u)).cast("double")).otherwise(large)


def error_cells(errors: DataFrame, by: list[str], error: str, bins: int = 256, per_octave: int = 64) -> DataFrame:
    """(by, bin, side, k, s, lo, hi): counts and sums of errors by the size of their absolute value, at most 2 * bins a group.

    One pass puts them into cells of a constant relative width, which tasks merge; neighbouring cells are then joined
    until each bin has about 1 / bins of the group.
    """
    a = F.abs(error)
    octave = F.floor(F.log2(F.nullif(a, F.lit(0.0))))
    cell = F.coalesce(octave * per_octave + F.floor((a / F.pow(F.lit(2.0), octave) - 1) * per_octave), F.lit(-(1 << 40))).cast("bigint")
    fine = errors.withColumn("__cell", cell).groupBy(*by, "__cell", F.signum(error).alias("side")).agg(F.count("*").alias("k"), F.sum(error).alias("s"), F.min(a).alias("lo"), F.max(a).alias("hi"))
    order = W.partitionBy(*by).orderBy("__cell")
    each = fine.groupBy(*by, "__cell").agg(F.sum("k").alias("__k"))
    each = each.withColumns({"__upto": F.sum("__k").over(order.rowsBetween(W.unboundedPreceding, 0)), "__n": F.sum("__k").over(W.partitionBy(*by))})
    bin_ = F.least(F.floor((F.col("__upto") - F.col("__k") / 2) * bins / F.col("__n")), F.lit(bins - 1)).cast("int")
    placed = joined(fine, each.select(*by, "__cell", bin_.alias("bin")), [*by, "__cell"])
    return placed.groupBy(*by, "bin", "side").agg(F.sum("k").cast("double").alias("k"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def agreement_ci(meas: DataFrame, by: list[str], error: Column, n_boot: int = 1000, seed: int = 20, least: int = 20, bins: int = 256) -> DataFrame:
    """(by, n, {bias, mae, median_ae, p95_ae}_{low, high}): 2.5 and 97.5 percentiles over Poisson resamples.

    Errors that are null or not finite do not count; under `least` of them the limits are null. A resample draws
    the count of each of a group's bins of like errors (error_cells), so a group costs 2 * bins * n_boot rows at most,
    whatever its number of records. Within a bin, errors are taken to be spread evenly from its least to its greatest.
    """
    e = error.cast("double")
    finite = meas.withColumn("__e", F.when(~F.isnan(e) & (F.abs(e) < float("inf")), e))
    sizes = finite.groupBy(*by).agg(F.count("__e").alias("n"))
    cells = error_cells(finite.filter("__e is not null").select(*by, "__e"), by, "__e", bins)
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    drawn = cells.withColumn("__table", poisson_table(F.col("k"))).withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    drawn = drawn.withColumn("w", poisson_draw(F.col("k"), F.col("__table"), F.lit(seed), F.col("__b"), *names, F.col("bin"), F.col("side"))).filter("w > 0")
    one = drawn.groupBy(*by, "__b", "bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("s") / F.col("k")).alias("s"), F.sum(F.col("w") * F.abs(F.col("s")) / F.col("k")).alias("a"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    upto, whole = W.partitionBy(*by, "__b").orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by, "__b")
    one = one.withColumns({"__before": F.coalesce(F.sum("w").over(upto), F.lit(0.0)), "__n": F.sum("w").over(whole)})

    def quantile(q: float) -> Column:
        at = F.col("__n") * F.lit(q)
        inside = (at >= F.col("__before")) & (at < F.col("__before") + F.col("w"))
        return F.max(F.when(inside, F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.col("__before")) / F.col("w")))

    stats = one.groupBy(*by, "__b").agg((F.sum("s") / F.sum("w")).alias("bias"), (F.sum("a") / F.sum("w")).alias("mae"), quantile(0.5).alias("median_ae"), quantile(0.95).alias("p95_ae"))
    ends = [(c, q, name) for c in ("bias", "mae", "median_ae", "p95_ae") for q, name in ((0.025, "low"), (0.975, "high"))]
    limits = stats.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c, q, name in ends])  # of n_boot values
    return joined(sizes, limits, by, "left").select(*by, "n", *[F.when(F.col("n") >= least, F.col(f"{c}_{name}")).alias(f"{c}_{name}") for c, _, name in ends])
