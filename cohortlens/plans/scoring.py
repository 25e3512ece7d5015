"""Scoring queries: A1-A6, A13-A15, A24, J1, G3-G10, M2."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import quantiles, score
from cohortlens.plans.registry import query

_RATES = "round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"
_CELLS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y <> 1 AND p <> 1) AS tn, count(*) FILTER (y <> 1 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p <> 1) AS fn"


def final(t):
    return t.stage_long.filter("stage = 'final'")


@query("j01_checked_join", "SELECT record_id, count(*) OVER () AS n_rows, y, o_orderkey AS other FROM (SELECT doc_id AS record_id, quality AS y FROM labels) l LEFT JOIN orders ON o_orderkey = record_id")
def _(t):
    gold = t.labels.select(F.col("doc_id").alias("record_id"), F.col("quality").alias("y"))
    pred = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("other"))
    joined = score.checked_join(gold, pred, ["record_id"], complete=False)
    return joined.crossJoin(F.broadcast(joined.agg(F.count("*").alias("n_rows"))))


@query("j01_join_violations", "WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1), b AS (SELECT CAST(coalesce(l.k, r.k) AS VARCHAR) AS keys, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM l FULL JOIN r ON l.k = r.k) SELECT keys, 'left_repeated' AS problem FROM b WHERE l > 1 UNION ALL SELECT keys, 'right_repeated' FROM b WHERE r > 1 UNION ALL SELECT keys, 'missing' FROM b WHERE l > 0 AND r = 0")
def _(t):
    return score.join_violations(t.orders.withColumnRenamed("o_custkey", "k"), t.customer.filter("c_mktsegment <> 'BUILDING'").withColumnRenamed("c_custkey", "k"), ["k"])


@query("a01_binary_metrics", f"SELECT *, {_RATES} FROM (SELECT target, stage, {_CELLS} FROM stage_long GROUP BY ALL)")
def _(t):
    return score.binary_metrics(t.stage_long, ["target", "stage"])


@query("a02_cohort_metrics", f"WITH v AS (SELECT *, 'all_positives' AS view FROM pred WHERE y = 1 UNION ALL SELECT *, 'general' FROM pred WHERE lang = 'en' UNION ALL SELECT *, 'controls' FROM pred WHERE y = 0 UNION ALL SELECT *, 'union' FROM pred) SELECT *, {_RATES} FROM (SELECT view, target, {_CELLS.replace('p =', 'final =').replace('p <>', 'final <>')} FROM v GROUP BY ALL)")
def _(t):
    views = {"all_positives": F.col("y") == 1, "general": F.col("lang") == "en", "controls": F.col("y") == 0, "union": F.lit(True)}
    return score.cohort_metrics(t.pred, views, ["target"], pred="final")


@query("a03_macro_micro_f1", f"WITH c AS (SELECT lang, target, {_CELLS.replace('p =', 'fusion =').replace('p <>', 'fusion <>')} FROM pred GROUP BY ALL), f AS (SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c) SELECT lang, count(*) FILTER (tp + fn > 0) AS targets, round(avg(f1) FILTER (tp + fn > 0), 6) AS macro_f1, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS micro_f1 FROM f GROUP BY lang")
def _(t):
    return score.macro_micro_f1(t.pred, ["lang"], pred="fusion")


_AGREE = "count(*) AS n, count(engine) AS n_engine, count(e) AS n_paired, round(avg(e), 6) AS bias, round(stddev_samp(e), 6) AS sd, round(avg(abs(e)), 6) AS mae, round(median(abs(e)), 6) AS median_ae, round(quantile_cont(abs(e), 0.95), 6) AS p95_ae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(CASE WHEN abs(e) <= 20 THEN 1 WHEN e IS NOT NULL THEN 0 END), 6) AS within_20, round(avg(CASE WHEN abs(e) <= 40 THEN 1 WHEN e IS NOT NULL THEN 0 END), 6) AS within_40, round(count(engine) / count(*), 6) AS availability, round(avg(e) - 1.96 * stddev_samp(e), 6) AS loa_low, round(avg(e) + 1.96 * stddev_samp(e), 6) AS loa_high"


@query("a04_agreement_metrics", f"SELECT grp, lead, {_AGREE} FROM (SELECT grp, lead, CASE WHEN qty > 3 THEN engine END AS engine, CASE WHEN qty > 3 THEN engine - comparator END AS e FROM meas) GROUP BY ALL")
def _(t):
    return score.agreement_metrics(t.meas.withColumn("engine", F.when(F.col("qty") > 3, F.col("engine"))), ["grp", "lead"])


@query("a05_circular_error", f"SELECT grp, {_AGREE} FROM (SELECT grp, engine, ((engine - comparator + 180) % 360 + 360) % 360 - 180 AS e FROM meas) GROUP BY ALL")
def _(t):
    return score.agreement_metrics(t.meas, ["grp"], error="circular")


@query("a06_bootstrap_ci")
def _(t):
    return score.bootstrap_ci(final(t), ["target"])


@query("a06_agreement_ci")
def _(t):
    return score.agreement_ci(t.meas, ["grp"])


@query("a13_rate_summary", "SELECT lang, count(*) AS n, round(avg(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END), 6) AS abstention, round(avg(CASE WHEN toxic = 1 AND n_chars > 1000 THEN 1 ELSE 0 END), 6) AS remeasure FROM lab GROUP BY lang")
def _(t):
    return score.rate_summary(t.lab, {"abstention": F.col("n_chars") < 500, "remeasure": (F.col("toxic") == 1) & (F.col("n_chars") > 1000)}, ["lang"])


@query("a14_calibration_summary", "SELECT grp, count(engine - comparator) AS n, round(avg(engine - comparator), 6) AS bias, round(median(engine - comparator), 6) AS median_bias, round(avg(abs(engine - comparator)), 6) AS mae, round(avg(CASE WHEN abs(engine - comparator) <= 20 * qty THEN 1 ELSE 0 END), 6) AS coverage FROM meas GROUP BY grp")
def _(t):
    return score.calibration_summary(t.meas.withColumn("uncertainty", 20 * F.col("qty")), ["grp"])


@query("a15_source_quantiles", "SELECT grp, lead, count(engine) AS n, round(avg(engine), 6) AS mean, round(quantile_cont(engine, 0.1), 6) AS p10, round(quantile_cont(engine, 0.5), 6) AS median, round(quantile_cont(engine, 0.9), 6) AS p90 FROM meas GROUP BY ALL")
def _(t):
    return score.source_quantiles(t.meas, "engine", ["grp", "lead"])


@query("a15_hot_group_quantiles", "SELECT run, count(engine) AS n, round(quantile_cont(engine, 0), 6) AS least, round(quantile_cont(engine, 0.1), 6) AS p10, round(quantile_cont(engine, 0.5), 6) AS median, round(quantile_cont(engine, 0.9), 6) AS p90, round(quantile_cont(engine, 1), 6) AS greatest FROM meas GROUP BY run")
def _(t):
    # Every group counts as hot here, so all ranks are selected.
    return quantiles.quantiles(t.meas, ["run"], "engine", {"least": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "greatest": 1.0}, most=1)


@query("a24_paired_run_delta", "WITH r AS (SELECT record_id, grp, run, max(engine) AS engine FROM meas GROUP BY ALL), d AS (SELECT a.grp, abs(a.engine - b.engine) AS d FROM r a JOIN r b ON a.record_id = b.record_id AND a.grp = b.grp WHERE a.run = 'F' AND b.run = 'O') SELECT grp, count(*) AS n, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta, round(quantile_cont(d, 0.95), 6) AS p95_delta FROM d GROUP BY grp")
def _(t):
    runs = t.meas.groupBy("record_id", "grp", "run").agg(F.max("engine").alias("engine"))
    return score.paired_run_delta(runs.filter("run = 'F'"), runs.filter("run = 'O'"), ["record_id", "grp"], "engine", ["grp"])


_WATER = "count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS controls, count(*) FILTER (y = 1 AND candidate = 1) AS hits_candidate, count(*) FILTER (y = 1 AND fusion = 1) AS hits_fusion, count(*) FILTER (y = 1 AND final = 1) AS hits_final, count(*) FILTER (y = 1 AND candidate = 1 AND fusion = 0) AS lost_candidate_fusion, count(*) FILTER (y = 1 AND fusion = 1 AND final = 0) AS lost_fusion_final, count(*) FILTER (y = 0 AND candidate = 1) AS fp_candidate, count(*) FILTER (y = 0 AND fusion = 1) AS fp_fusion, count(*) FILTER (y = 0 AND final = 1) AS fp_final"


@query("g03_stage_waterfall", f"SELECT target, {_WATER} FROM pred GROUP BY target")
def _(t):
    return score.stage_waterfall(t.pred)


@query("g04_false_negative_stage", "SELECT record_id, target, CASE WHEN candidate = 0 THEN 'candidate' WHEN fusion = 0 THEN 'fusion' WHEN final = 0 THEN 'final' ELSE 'published' END AS first_failure FROM pred WHERE y = 1")
def _(t):
    return score.false_negative_stage(t.pred)


@query("g05_engineering_gate", f"WITH w AS (SELECT target, {_WATER} FROM pred GROUP BY target), g AS (SELECT target, positives >= 20 AS eligible, hits_candidate / nullif(positives, 0) AS c, hits_final / nullif(positives, 0) AS f, 1 - fp_final / nullif(controls, 0) AS s FROM w), p AS (SELECT *, coalesce(c >= 0.5 AND f >= 0.3 AND s >= 0.1, false) AS pass FROM g) SELECT target, eligible, round(c, 6) AS candidate_sensitivity, round(f, 6) AS final_sensitivity, round(s, 6) AS specificity, pass, bool_and(NOT eligible OR pass) OVER () AS overall FROM p")
def _(t):
    return score.engineering_gate(score.stage_waterfall(t.pred), 0.5, 0.3, 0.1)


def metrics_long(t, stage):
    wide = score.binary_metrics(t.stage_long.filter(F.col("stage") == stage), ["target"])
    return wide.select("target", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("sensitivity", "specificity", "f1")])).alias("x")).select("target", "x.metric", "x.value")


@query("g06_compare_runs", f"WITH m AS (SELECT *, {_RATES} FROM (SELECT target, stage, {_CELLS} FROM stage_long GROUP BY ALL)), u AS (SELECT target, stage, 'sensitivity' AS metric, sensitivity AS value FROM m UNION ALL SELECT target, stage, 'specificity', specificity FROM m UNION ALL SELECT target, stage, 'f1', f1 FROM m), b AS (SELECT * FROM u WHERE stage = 'fusion'), a AS (SELECT * FROM u WHERE stage = 'final') SELECT target, metric, b.value AS before, a.value AS after, round(a.value - b.value, 6) AS delta, CASE WHEN a.value - b.value IS NULL THEN 'not_comparable' WHEN a.value - b.value >= 0.02 THEN 'improved' WHEN a.value - b.value <= -0.02 THEN 'regressed' ELSE 'same' END AS verdict, coalesce(metric = 'specificity' AND a.value < 0.5, false) AS breached FROM b FULL JOIN a USING (target, metric)")
def _(t):
    rounded = lambda s: metrics_long(t, s).withColumn("value", F.round("value", 6))
    return score.compare_runs(rounded("fusion"), rounded("final"), guards={"specificity": 0.5})


@query("g07_frozen_baseline_gate", "WITH w AS (SELECT target, count(*) FILTER (y = 1 AND fusion = 1) AS hb, count(*) FILTER (y = 0 AND fusion = 1) AS fb, count(*) FILTER (y = 1 AND final = 1) AS ha, count(*) FILTER (y = 0 AND final = 1) AS fa FROM pred GROUP BY target), r AS (SELECT *, 'lost_hits' AS reason FROM w WHERE ha < hb UNION ALL SELECT *, 'more_false_positives' FROM w WHERE fa > fb + 5) SELECT target, reason, hb AS hits_before, ha AS hits_after, fb AS fp_before, fa AS fp_after FROM r")
def _(t):
    base = t.pred.groupBy("target").agg(F.count_if(F.expr("y = 1 and fusion = 1")).alias("hits_final"), F.count_if(F.expr("y = 0 and fusion = 1")).alias("fp_final"))
    return score.frozen_baseline_gate(base, score.stage_waterfall(t.pred))


@query("g08_counterfactual_policies", "WITH a AS (SELECT *, 'any_candidate' AS policy, candidate = 1 AS fires FROM pred UNION ALL SELECT *, 'fusion_english', fusion = 1 AND lang = 'en' FROM pred) SELECT target, policy, count(*) FILTER (y = 1 AND final = 0 AND fires) AS recoverable, count(*) FILTER (y = 0 AND final = 0 AND fires) AS added_negatives, round((count(*) FILTER (y = 1 AND final = 1) + count(*) FILTER (y = 1 AND final = 0 AND fires)) / nullif(count(*) FILTER (y = 1), 0), 6) AS projected_sensitivity, round(1 - (count(*) FILTER (y = 0 AND final = 1) + count(*) FILTER (y = 0 AND final = 0 AND fires)) / nullif(count(*) FILTER (y = 0), 0), 6) AS specificity_bound FROM a GROUP BY ALL")
def _(t):
    return score.counterfactual_policies(t.pred, {"any_candidate": F.col("candidate") == 1, "fusion_english": (F.col("fusion") == 1) & (F.col("lang") == "en")}, F.col("final") == 1)


@query("g09_shadow_compare", "SELECT target, y, count(*) AS n, count(*) FILTER (fusion = 1) AS before_n, count(*) FILTER (k = 1) AS after_n, count(*) FILTER (fusion <> 1 AND k = 1) AS gained, count(*) FILTER (fusion = 1 AND k <> 1) AS lost FROM (SELECT *, CASE WHEN n_chars % 2 = 0 THEN candidate ELSE final END AS k FROM pred) GROUP BY ALL")
def _(t):
    after = t.pred.select("record_id", "target", F.expr("case when n_chars % 2 = 0 then candidate else final end").alias("p"))
    return score.shadow_compare(t.pred.withColumn("p", F.col("fusion")), after, ["record_id", "target"], ["target", "y"])


@query("g10_expected_findings_check", "WITH f AS (SELECT DISTINCT o_custkey AS case_id, o_orderpriority AS code FROM orders), e AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN 'must_have' ELSE 'must_not' END AS \"check\", CASE WHEN c_nationkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS code FROM customer) SELECT e.case_id, e.\"check\", e.code FROM e LEFT JOIN f ON f.case_id = e.case_id AND f.code = e.code WHERE (e.\"check\" = 'must_have' AND f.code IS NULL) OR (e.\"check\" = 'must_not' AND f.code IS NOT NULL)")
def _(t):
    expected = t.customer.select(F.col("c_custkey").alias("case_id"), F.expr("case when c_custkey % 2 = 0 then 'must_have' else 'must_not' end").alias("check"), F.expr("case when c_nationkey % 2 = 0 then '1-URGENT' else '5-LOW' end").alias("code"))
    return score.expected_findings_check(t.coh.withColumnRenamed("patient_id", "case_id"), expected)


@query("m02_first_exposure_accuracy", "WITH f AS (SELECT o_orderpriority AS target, o_custkey, arg_min(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END, o_orderkey) AS correct FROM orders GROUP BY ALL) SELECT target, count(correct) AS n, round(avg(correct), 6) AS accuracy FROM f GROUP BY target")
def _(t):
    seen = t.orders.select(F.col("o_orderpriority").alias("target"), "o_custkey", "o_orderkey", (F.col("o_totalprice") > 150000).alias("correct"))
    return score.first_exposure_accuracy(seen, "o_custkey", "o_orderkey", ["target"])


@query("w11_worst_errors", "SELECT record_id, lead, round(engine, 6) AS engine, round(comparator, 6) AS comparator, round(engine - comparator, 6) AS error FROM meas ORDER BY round(abs(engine - comparator), 6) DESC, record_id, lead LIMIT 25")
def _(t):
    return score.worst_errors(t.meas, ["record_id", "lead"], 25)
