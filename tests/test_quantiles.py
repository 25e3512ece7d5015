"""Quantiles of hot groups against the built-in ones, and resampled agreement against plain resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import quantiles, score

WANTED = {"low": 0.0, "p10": 0.1, "half": 0.5, "p95": 0.95, "high": 1.0}


def plain(df, by):
    return df.groupBy(*by).agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(q)).alias(c) for c, q in WANTED.items()])


def listed(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("accuracy", [10_000, 50, 3])  # a sketch that is far off costs time, not exactness
@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_groups_of_any_size(spark, most, accuracy):
    df = spark.range(30_000).select(F.expr("case when id % 7 < 4 then 'hot' when id % 7 = 4 then null else cast(id % 900 as string) end").alias("g"), F.expr("case when id % 11 = 0 then null when id % 3 = 0 then 5.0 else cast(hash(id) % 1000 as double) / 7 end").alias("v"))
    df = df.unionByName(spark.createDataFrame([("none", None)], "g string, v double"))
    assert listed(quantiles.quantiles(df, ["g"], "v", WANTED, most, accuracy)) == listed(plain(df, ["g"]))
    assert listed(quantiles.quantiles(df, [], "v", WANTED, most, accuracy)) == listed(plain(df, []))


def test_nothing_there(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(empty, ["g"], "v", WANTED).collect() == []


def test_one_group_of_ten_million_gathers_few_values(spark):
    df = spark.range(0, 10_000_000, 1, 8).select(F.lit("all").alias("g"), (F.xxhash64("id") % 1_000_000_007).cast("double").alias("v"))
    got = quantiles.quantiles(df, ["g"], "v", {"half": 0.5, "p95": 0.95})
    row = got.collect()[0]
    below = df.agg(F.count_if(F.col("v") <= row.half).alias("a"), F.count_if(F.col("v") <= row.p95).alias("b")).first()
    assert row.n == 10_000_000 and abs(below.a - 5_000_000) <= 1 and abs(below.b - 9_500_000) <= 1
    # The rows that ranked windows sort: those of the two brackets, 4 / ACCURACY of all each, and the sketch's error.
    plan = got._jdf.queryExecution().executedPlan()
    seen, stack = [], [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while stack:
        node = stack.pop()
        kids = node.children()
        stack += [kids.apply(k) for k in range(kids.size())]
        if node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
            stack.append(node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan())
        elif node.nodeName() == "Exchange":
            seen.append(node.metrics().apply("shuffleRecordsWritten").value())
    assert seen and max(seen) < 10_000_000 * 2 * 8 / quantiles.ACCURACY


def test_sketch_on_request(spark):
    df = spark.range(10_001).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    row = score.source_quantiles(df, "v", ["g"], approximate=1000).first()
    assert abs(row.p10 - 1000) <= 11 and abs(row["median"] - 5000) <= 11 and abs(row.p90 - 9000) <= 11


def resampled(e, n_boot, rng):
    out = np.empty((n_boot, 4))
    for k in range(n_boot):
        x = e[rng.integers(0, len(e), len(e))]
        a = np.abs(x)
        out[k] = x.mean(), a.mean(), np.median(a), np.percentile(a, 95)
    return np.percentile(out, [2.5, 97.5], axis=0)


@pytest.mark.parametrize(("n", "plain_boot"), [(1_000, 4_000), (100_000, 1_500)])
def test_agreement_limits_like_plain_resampling(spark, n, plain_boot):
    rng = np.random.default_rng(n)
    e = rng.normal(3, 10, n) + rng.exponential(8, n) * (rng.random(n) < 0.3)
    df = spark.createDataFrame([("a", float(x), 0.0) for x in e], "g string, engine double, comparator double")
    row = score.agreement_ci(df, ["g"], n_boot=4000).first()
    low, high = resampled(e, plain_boot, rng)
    for k, c in enumerate(("bias", "mae", "median_ae", "p95_ae")):
        width = high[k] - low[k]
        assert row[f"{c}_high"] - row[f"{c}_low"] == pytest.approx(width, rel=0.10), c
        assert abs((row[f"{c}_high"] + row[f"{c}_low"]) / 2 - (low[k] + high[k]) / 2) < 0.12 * width, c


def test_limits_of_few_errors_are_null_and_rows_are_bounded(spark):
    rows = [("few", float(k), 0.0) for k in range(19)] + [("some", float(k % 5), 1.0) for k in range(20)] + [("bad", float("nan"), 0.0), ("bad", float("inf"), 0.0), ("bad", None, 0.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, engine double, comparator double")
    got = {r.g: r for r in score.agreement_ci(df, ["g"], n_boot=200).collect()}
    assert {g: r.n for g, r in got.items()} == {"few": 19, "some": 20, "bad": 0, None: 1}
    assert all((r.bias_low is None) == (g != "some") for g, r in got.items())
    assert got["some"].bias_low < 1.0 < got["some"].bias_high
    cells = quantiles.error_cells(spark.range(200_000).select(F.lit(1).alias("g"), (F.hash("id") / 1e5).alias("e")), ["g"], "e")
    assert cells.count() <= 512 and cells.agg(F.sum("k")).first()[0] == 200_000
    again = [tuple(r) for r in score.agreement_ci(df.repartition(3), ["g"], n_boot=200).filter("g = 'some'").collect()]
    assert again == [tuple(got["some"])]


def test_circular_errors(spark):
    df = spark.createDataFrame([("a", 179.0 + k % 3, -179.0 + k % 2) for k in range(100)], "g string, engine double, comparator double")
    row = score.agreement_ci(df, ["g"], error="circular", n_boot=200).first()
    assert -3 < row.bias_low < row.bias_high < 1
