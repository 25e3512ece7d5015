"""Scoring of predictions and measurements: joins to gold, metrics, intervals, gates, comparisons of runs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.operators.quantiles import agreement_ci as resampled_agreement
from cohortlens.operators.quantiles import summarised


def ratio(a: Column, b: Column) -> Column:
    return (a / F.nullif(b, F.lit(0))).cast("double")


def join_violations(left: DataFrame, right: DataFrame, on: list[str], complete: bool = True) -> DataFrame:
    """(problem, keys) of repeated keys on either side and, if complete, left keys without a right row."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in on])
    counted = left.select(key.alias("keys"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(key.alias("keys"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    counted = counted.groupBy("keys").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    found = [F.when(F.col("l") > 1, "left_repeated"), F.when(F.col("r") > 1, "right_repeated")]
    if complete:
        found.append(F.when((F.col("l") > 0) & (F.col("r") == 0), "missing"))
    return counted.select("keys", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", complete: bool = True) -> DataFrame:
    """A one-to-one join that refuses repeated keys and, if complete, missing rows, naming the first 20."""
    bad = join_violations(left, right, on, complete).orderBy("keys", "problem").limit(20).collect()
    if bad:
        raise ValueError("join refused: " + ", ".join(f"{r.problem} {r['keys']}" for r in bad))
    return left.join(right, on, how)


def binary_metrics(scored: DataFrame, by: list[str], gold: str = "y", pred: str = "p") -> DataFrame:
    """Counts of the confusion table and its rates; a rate over nothing is null."""
    y, p = F.col(gold) == 1, F.col(pred) == 1
    counts = scored.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def cohort_metrics(scored: DataFrame, views: dict[str, Column], by: list[str], gold: str = "y", pred: str = "p") -> DataFrame:
    """binary_metrics of every view of the cohort in one pass; a row counts in each view that holds it."""
    member = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in views.items()]), lambda v: v.isNotNull())
    return binary_metrics(scored.withColumn("view", F.explode(member)), ["view", *by], gold, pred)


def macro_micro_f1(scored: DataFrame, strata: list[str] | None = None, target: str = "target", gold: str = "y", pred: str = "p") -> DataFrame:
    """Mean F1 over targets that have positives, and F1 of the pooled counts, by stratum."""
    strata = strata or []
    each = binary_metrics(scored, [*strata, target], gold, pred)
    scorable = F.col("tp") + F.col("fn") > 0
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return each.groupBy(*strata).agg(F.count_if(scorable).alias("targets"), F.avg(F.when(scorable, F.col("f1"))).alias("macro_f1"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"))


def circular_error(a: Column, b: Column) -> Column:
    """Shortest signed angle from b to a, in degrees: from -180 up to 180."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def agreement_metrics(meas: DataFrame, by: list[str], error: str = "linear", within: tuple[float, ...] = (20.0, 40.0)) -> DataFrame:
    """Availability, bias, spread (n - 1), limits of agreement, absolute errors and shares within bounds of engine against comparator."""
    paired = F.col("engine").isNotNull() & F.col("comparator").isNotNull()
    raw = F.col("engine") - F.col("comparator") if error == "linear" else circular_error(F.col("engine"), F.col("comparator"))
    e = F.when(paired, raw)
    out = summarised(
        meas.withColumn("__e", e).withColumn("__abs", F.abs("__e")), by,
        [F.count("*").alias("n"), F.count("engine").alias("n_engine"), F.count("__e").alias("n_paired"), F.avg("__e").alias("bias"), F.stddev_samp("__e").alias("sd"), F.avg("__abs").alias("mae"), F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse")]
        + [F.avg((F.col("__abs") <= w).cast("int")).alias(f"within_{w:g}") for w in within],
        "__abs", {"median_ae": 0.5, "p95_ae": 0.95},
    )
    return out.withColumns({"availability": ratio(F.col("n_engine"), F.col("n")), "loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})


def agreement_ci(meas: DataFrame, by: list[str], error: str = "linear", n_boot: int = 1000, seed: int = 20, least: int = 20) -> DataFrame:
    """Resampled limits of bias, MAE, median and P95 of engine against comparator; null under `least` finite errors."""
    raw = F.col("engine") - F.col("comparator") if error == "linear" else circular_error(F.col("engine"), F.col("comparator"))
    return resampled_agreement(meas, by, raw, n_boot, seed, least)


def hash_uniform(seed: int, draw: Column, key: Column) -> Column:
    """A number in [0, 1) that seed, draw number and key fix."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), key), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_count(seed: int, draw: Column, key: Column, mean: Column, exact: int = 64) -> Column:
    """Poisson count of a mean that seed, draw number and key fix: the inverse distribution up to a mean of
    `exact`, beyond it a normal deviate with the correction for skewness, rounded."""
    u = hash_uniform(seed, draw, key)
    start = F.struct(F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("cum"), F.exp(-mean.cast("double")).alias("term"))

    def step(s: Column, i: Column) -> Column:
        cum = s["cum"] + s["term"]
        return F.struct((s["k"] + (u >= cum).cast("bigint")).alias("k"), cum.alias("cum"), (s["term"] * mean / i).alias("term"))

    small = F.aggregate(F.sequence(F.lit(1), F.lit(exact + 10 * int(exact**0.5) + 20)), start, step, lambda s: s["k"])
    z = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * hash_uniform(seed, draw, F.concat_ws("|", key, F.lit("angle"))))
    large = F.greatest(F.round(mean + F.sqrt(mean.cast("double")) * z + (z * z - 1) / 6), F.lit(0.0)).cast("bigint")
    return F.when(mean <= exact, small).otherwise(large)


def bootstrap_ci(scored: DataFrame, by: list[str], n_boot: int = 1000, seed: int = 20, least: int = 30, gold: str = "y", pred: str = "p") -> DataFrame:
    """2.5 and 97.5 percentiles of sensitivity and specificity over Poisson resamples of the records.

    Records of a confusion cell are alike, so the sum of their Poisson(1) weights is drawn at once as
    Poisson(n) of the cell: the resamples cost n_boot rows per cell whatever the number of records.
    Intervals over fewer than `least` records are null.
    """
    parts = scored.groupBy(*by, F.col(gold).alias("__y"), F.col(pred).alias("__p")).agg(F.count("*").alias("__n"))
    drawn = parts.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, "__y", "__p")])
    drawn = drawn.withColumn("__w", poisson_count(seed, F.col("__b"), key, F.col("__n")))
    pick = lambda y, p: F.sum(F.when((F.col("__y") == y) & (F.col("__p") == p), F.col("__w")).otherwise(0))
    rates = drawn.groupBy(*by, "__b").agg(pick(1, 1).alias("tp"), pick(1, 0).alias("fn"), pick(0, 0).alias("tn"), pick(0, 1).alias("fp"))
    rates = rates.withColumns({"sens": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "spec": ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    sizes = scored.groupBy(*by).agg(F.count("*").alias("n"))
    limits = rates.groupBy(*by).agg(*[F.when(F.count(c) >= 100, F.percentile(c, F.lit(q))).alias(f"{c}_{name}") for c in ("sens", "spec") for q, name in ((0.025, "low"), (0.975, "high"))])
    out = sizes.join(limits, by) if by else sizes.crossJoin(limits)
    return out.select(*by, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("sens_low", "sens_high", "spec_low", "spec_high")])


def rate_summary(df: DataFrame, rates: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Shares of rows for which each predicate holds; unknown counts as not."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in rates.items()])


def calibration_summary(meas: DataFrame, by: list[str]) -> DataFrame:
    """Bias and the share of comparators inside engine +/- its stated uncertainty."""
    e = F.col("__e")
    aggregates = [F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.avg((F.abs(e) <= F.col("uncertainty")).cast("int")).alias("coverage")]
    return summarised(meas.withColumn("__e", F.col("engine") - F.col("comparator")), by, aggregates, "__e", {"median_bias": 0.5})


def source_quantiles(beats: DataFrame, value: str, by: list[str], approximate: int | None = None) -> DataFrame:
    """n, mean, P10, median and P90; exact, or by a sketch whose ranks are off by n / approximate at most."""
    wanted, aggregates = {"p10": 0.1, "median": 0.5, "p90": 0.9}, [F.count(value).alias("n"), F.avg(value).alias("mean")]
    if approximate is None:
        return summarised(beats, by, aggregates, value, wanted)
    sketch = F.percentile_approx(F.col(value).cast("double"), [*wanted.values()], approximate).alias("__q")
    return beats.groupBy(*by).agg(*aggregates, sketch).select(*by, "n", "mean", *[F.col("__q")[k].alias(name) for k, name in enumerate(wanted)])


def paired_run_delta(run_a: DataFrame, run_b: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    """Absolute differences of one measure between two runs of a case."""
    both = run_a.select(*keys, *[c for c in by if c not in keys], F.col(value).alias("__a")).join(run_b.select(*keys, F.col(value).alias("__b")), keys)
    return summarised(both.withColumn("__d", F.abs(F.col("__a") - F.col("__b"))), by, [F.count("*").alias("n"), F.avg("__d").alias("mean_delta")], "__d", {"median_delta": 0.5, "p95_delta": 0.95})


def stage_waterfall(pred: DataFrame, target: str = "target", stages: tuple[str, ...] = ("candidate", "fusion", "final")) -> DataFrame:
    """Hits per stage, record-level losses between stages, and false positives per stage, by target; a missing prediction is a miss."""
    hit = {s: F.coalesce(F.col(s) == 1, F.lit(False)) for s in stages}
    pos, neg = F.col("y") == 1, F.col("y") == 0
    losses = [F.count_if(pos & hit[a] & ~hit[b]).alias(f"lost_{a}_{b}") for a, b in zip(stages, stages[1:])]
    return pred.groupBy(target).agg(F.count_if(pos).alias("positives"), F.count_if(neg).alias("controls"), *[F.count_if(pos & hit[s]).alias(f"hits_{s}") for s in stages], *losses, *[F.count_if(neg & hit[s]).alias(f"fp_{s}") for s in stages])


def false_negative_stage(pred: DataFrame, stages: tuple[str, ...] = ("candidate", "fusion", "final")) -> DataFrame:
    """Of each positive the first stage that fails it, or `published`."""
    out = reduce(lambda rest, s: F.when(F.coalesce(F.col(s), F.lit(0)) == 0, s).otherwise(rest), reversed(stages), F.lit("published"))
    return pred.filter("y = 1").select("record_id", "target", out.alias("first_failure"))


def engineering_gate(waterfall: DataFrame, candidate: float = 0.97, final: float = 0.90, specificity: float = 0.90, least: int = 20) -> DataFrame:
    """Pass or fail of each target with enough positives, and of all together."""
    sens_c, sens_f = ratio(F.col("hits_candidate"), F.col("positives")), ratio(F.col("hits_final"), F.col("positives"))
    spec = 1 - ratio(F.col("fp_final"), F.col("controls"))
    own = waterfall.select("target", (F.col("positives") >= least).alias("eligible"), sens_c.alias("candidate_sensitivity"), sens_f.alias("final_sensitivity"), spec.alias("specificity"))
    ok = F.coalesce((F.col("candidate_sensitivity") >= candidate) & (F.col("final_sensitivity") >= final) & (F.col("specificity") >= specificity), F.lit(False))
    own = own.withColumn("pass", ok)
    return own.withColumn("overall", F.expr("bool_and(not eligible or pass)").over(W.partitionBy()))


def compare_runs(baseline: DataFrame, candidate: DataFrame, keys: tuple[str, ...] = ("target", "metric"), step: float = 0.02, guards: dict[str, float] | None = None) -> DataFrame:
    """Deltas per target and metric of two runs: improved, regressed, same or not comparable; and breached guardrails."""
    both = baseline.withColumnRenamed("value", "before").join(candidate.withColumnRenamed("value", "after"), list(keys), "full")
    d = F.col("after") - F.col("before")
    verdict = F.when(d.isNull(), "not_comparable").when(d >= step, "improved").when(d <= -step, "regressed").otherwise("same")
    least = reduce(lambda rest, g: F.when(F.col("metric") == g[0], F.lit(g[1])).otherwise(rest), (guards or {}).items(), F.lit(None).cast("double"))
    return both.select(*keys, "before", "after", d.alias("delta"), verdict.alias("verdict"), F.coalesce(F.col("after") < least, F.lit(False)).alias("breached"))


def frozen_baseline_gate(baseline: DataFrame, candidate: DataFrame, tolerance: int = 5) -> DataFrame:
    """Targets that lost final hits, gained control false positives beyond the tolerance, or are missing; none means pass."""
    b = baseline.select("target", F.col("hits_final").alias("hits_before"), F.col("fp_final").alias("fp_before"))
    c = candidate.select("target", F.col("hits_final").alias("hits_after"), F.col("fp_final").alias("fp_after"))
    both = b.join(c, "target", "full")
    reasons = F.filter(F.array(F.when(F.col("hits_after").isNull() | F.col("hits_before").isNull(), "incomplete"), F.when(F.col("hits_after") < F.col("hits_before"), "lost_hits"), F.when(F.col("fp_after") > F.col("fp_before") + tolerance, "more_false_positives")), lambda x: x.isNotNull())
    return both.withColumn("reason", F.explode(reasons)).select("target", "reason", "hits_before", "hits_after", "fp_before", "fp_after")


def counterfactual_policies(rows: DataFrame, policies: dict[str, Column], published: Column) -> DataFrame:
    """Per rescue policy: lost positives it would recover, negatives it would add, projected rates."""
    lost, new = (F.col("y") == 1) & ~published, (F.col("y") == 0) & ~published
    arms = F.array(*[F.struct(F.lit(n).alias("policy"), F.coalesce(c, F.lit(False)).alias("fires")) for n, c in policies.items()])
    long = rows.withColumns({"__lost": lost, "__new": new, "__pub": published}).withColumn("__a", F.explode(arms))
    fires = F.col("__a.fires")
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    hits, fps = F.count_if((F.col("y") == 1) & F.col("__pub")), F.count_if((F.col("y") == 0) & F.col("__pub"))
    out = long.groupBy("target", F.col("__a.policy").alias("policy")).agg(F.count_if(F.col("__lost") & fires).alias("recoverable"), F.count_if(F.col("__new") & fires).alias("added_negatives"), hits.alias("__h"), fps.alias("__f"), pos.alias("__p"), neg.alias("__n"))
    return out.select("target", "policy", "recoverable", "added_negatives", ratio(F.col("__h") + F.col("recoverable"), F.col("__p")).alias("projected_sensitivity"), (1 - ratio(F.col("__f") + F.col("added_negatives"), F.col("__n"))).alias("specificity_bound"))


def shadow_compare(before: DataFrame, after: DataFrame, key: list[str], by: list[str], flag: str = "p") -> DataFrame:
    """Candidates kept, gained and lost by a change that is not published."""
    both = before.select(*key, *[c for c in by if c not in key], F.col(flag).alias("__b")).join(after.select(*key, F.col(flag).alias("__a")), key)
    b, a = F.col("__b") == 1, F.col("__a") == 1
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(b).alias("before_n"), F.count_if(a).alias("after_n"), F.count_if(~b & a).alias("gained"), F.count_if(b & ~a).alias("lost"))


def expected_findings_check(findings: DataFrame, expectations: DataFrame) -> DataFrame:
    """Violated expectations (case_id, check, code): must-have codes that are missing, must-not codes that are there."""
    here = findings.select("case_id", "code").distinct().withColumn("__has", F.lit(True))
    both = expectations.join(here, ["case_id", "code"], "left").withColumn("__has", F.coalesce("__has", F.lit(False)))
    bad = ((F.col("check") == "must_have") & ~F.col("__has")) | ((F.col("check") == "must_not") & F.col("__has"))
    return both.filter(bad).select("case_id", "check", "code")


def first_exposure_accuracy(evaluations: DataFrame, key: str, order: str, by: list[str]) -> DataFrame:
    """Accuracy over the first prediction of each item; later ones were made after learning."""
    first = evaluations.groupBy(*by, key).agg(F.min_by("correct", F.col(order)).alias("correct"))
    return first.groupBy(*by).agg(F.count("correct").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def worst_errors(df: DataFrame, keys: list[str], k: int = 25) -> DataFrame:
    """The k pairs of engine and comparator that lie furthest apart, ties by key; pairs with a null are none."""
    error = F.col("engine") - F.col("comparator")
    return df.withColumn("error", error).filter("error is not null").orderBy(F.round(F.abs("error"), 6).desc(), *keys).limit(k).select(*keys, "engine", "comparator", "error")
